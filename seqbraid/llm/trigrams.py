"""Boolean trigram queries from regular expressions."""

from __future__ import annotations

import re._constants as op
import re._parser as parser

#: More alternatives than this, or a class of more characters, end a literal run.
MAX_ALTERNATIVES, MAX_CLASS = 64, 8

_Alternative = tuple  # of characters and None, which stands for unknown text


def _members(items: list) -> set[str] | None:
    out = set()
    for kind, value in items:
        if kind is not op.LITERAL:
            return None
        out.add(chr(value).lower())
    return out if len(out) <= MAX_CLASS else None


def _walk(nodes) -> list[_Alternative]:
    out: list[_Alternative] = [()]
    for kind, value in nodes:
        if kind is op.LITERAL:
            more = [(chr(value).lower(),)]
        elif kind is op.IN and (found := _members(value)):
            more = [(c,) for c in sorted(found)]
        elif kind is op.SUBPATTERN:
            more = _walk(value[3])
        elif kind is op.BRANCH:
            more = [x for branch in value[1] for x in _walk(branch)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            once = _walk(inner)
            if (low, high) == (0, 1):
                more = [(), *once]
            elif low and low == high and low <= 4:
                more = [()]
                for _ in range(low):
                    more = list(dict.fromkeys(a + b for a in more for b in once))
                    if len(more) > MAX_ALTERNATIVES:
                        more = [(None,)]
                        break
            elif low:
                once = list(dict.fromkeys(once))
                if low == 1:
                    more = [(*x, None) for x in once]
                else:
                    more = [(*x, None, *y) for x in once for y in once] if len(once) ** 2 <= MAX_ALTERNATIVES else [(None,)]
            else:
                more = [(None,)]
        elif kind is op.AT:
            more = [()]
        else:
            more = [(None,)]
        more = list(dict.fromkeys(more))
        if len(more) * len(out) > MAX_ALTERNATIVES:
            more = [(None,)]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that a match must hold.

    None: some alternative has no mandatory trigram, so the rule scans all text.
    The query may admit texts that don't match, but never leaves out one that does.
    """
    found = []
    for alternative in _walk(parser.parse(pattern)):
        grams, run = set(), ""
        for c in (*alternative, None):
            run = run + c if c is not None else ""
            if len(run) >= 3:
                grams.add(run[-3:])
        if not grams:
            return None
        found.append(frozenset(grams))
    return list(dict.fromkeys(found))
