"""Statistics of a whole text that rules and classifiers share."""

from __future__ import annotations

_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?.,;:"
_SYMBOLS = "#*$%&|<>"
#: Words in which different ones are counted, so that the ratio doesn't fall with length.
WINDOW = 200

#: Ratios of ``ratios``, none of which depends on language or length alone.
RATIOS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "adjacent", "single")


def counts(text: str) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the ratios.

    A word is a run of characters other than space and 0x09-0x0D.
    """
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    repeats = _repeat_words(words)
    size = max(len(data), 1)
    ratios = (
        chars / max(n, 1),
        symbols / max(chars, 1),
        dup_lines / max(len(lines), 1),
        repeats / max(n, 1),
        (len(data) - len(data.translate(None, _UPPER))) / size,
        (len(data) - len(data.translate(None, _DIGITS))) / size,
        (len(data) - len(data.translate(None, _MARKS))) / size,
        _distinct(words),
        sum(map(bytes.__eq__, words, words[1:])) / max(n, 1),
        sum(1 for x in words if len(x) == 1) / max(n, 1),
    )
    return (n, chars, symbols, dup_lines, repeats), ratios


def _distinct(words: list[bytes]) -> float:
    """Share of different words in windows of WINDOW words, on average over all words.

    The last window ends with the text and weighs as many words as it adds.
    """
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / max(n, 1)
    full = n - n % WINDOW
    found = sum(len(set(words[i : i + WINDOW])) for i in range(0, full, WINDOW))
    return (found + len(set(words[-WINDOW:])) * (n - full) / WINDOW) / n


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in some 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    again: set = set()
    for w in windows:
        if w in seen:
            again.add(w)
        else:
            seen.add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered
