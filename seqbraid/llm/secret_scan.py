"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression becomes a Boolean query over trigrams.  One pass
over the texts writes the postings (trigram, document) of all trigrams that a
query names; intersecting them gives each rule's candidates, and only these meet
the expression itself.  A rule with no mandatory trigram scans every text.

Spans come from ``split`` and ``regexp_extract_all``: the pieces between matches
and the matches, end to end, are the text, so running sums of their lengths are
the matches' places in code points and in bytes.  The sums are taken by blocks of
``BLOCK`` matches, so that a text with a million matches takes seconds.  A row meets
its candidate rules by one join and is then worked on alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seqbraid.llm.trigrams import trigram_query
from seqbraid.plans.shared import bounded, materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 0  # code points it must have


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules of our own, for further kinds of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
)
_SPAN = "array<struct<start:int,kind_no:int,end:int,from_byte:int,to_byte:int>>"
#: Matches whose places are summed up together.
BLOCK = 256


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _blocks(rows: Column) -> Column:
    """An array that isn't empty as an array of arrays of up to BLOCK."""
    count = F.floor((F.size(rows) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule, leftmost and not overlapping, failing matches dropped."""
    matches, pieces = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else F.array().cast("array<string>")
    none = F.array().cast(_SPAN)

    def sizes(x: Column) -> Column:
        good = F.length(x["v"]) >= rule.least if rule.least else F.lit(True)
        return F.struct(F.length(x["p"]).alias("p"), F.octet_length(x["p"]).alias("pb"), F.length(x["m"]).alias("m"), F.octet_length(x["m"]).alias("mb"), good.alias("ok"))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("c"), F.lit(0).alias("b")), lambda acc, x: F.struct((acc["c"] + x["p"] + x["m"]).alias("c"), (acc["b"] + x["pb"] + x["mb"]).alias("b")))

    def before(totals: Column) -> Column:
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast("array<struct<c:int,b:int>>").alias("out"))
        return F.aggregate(totals, zero, lambda acc, x: F.struct((acc["c"] + x["c"]).alias("c"), (acc["b"] + x["b"]).alias("b"), F.concat(acc["out"], F.array(F.struct(acc["c"].alias("c"), acc["b"].alias("b")))).alias("out")), lambda acc: acc["out"])

    def placed(block: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start, first = acc["c"] + x["p"], acc["b"] + x["pb"]
            end, last = start + x["m"], first + x["mb"]
            span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), first.alias("from_byte"), last.alias("to_byte"))
            return F.struct(end.alias("c"), last.alias("b"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(base["c"].alias("c"), base["b"].alias("b"), none.alias("out")), step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, before(F.transform(blocks, total)), placed))

    found = _with(matches, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<p:string,m:string,v:string>>")).otherwise(F.arrays_zip(F.slice(pieces, 1, F.size(m)).alias("p"), m.alias("m"), values.alias("v"))))
    return _with(F.transform(found, sizes), lambda rows: F.when(F.size(rows) == 0, none).otherwise(_with(_blocks(rows), of_blocks)))


def postings(docs: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, trigram): the inverted index over ``terms``, of lower-cased text."""
    low = docs.select(*keys, F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in terms)))
    return low.select(*keys, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, keys: list[str], queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(keys, rules): the numbers of the rules whose query a document's postings meet."""
    wanted = [(n, a, t, len(grams)) for n, query in queries.items() for a, grams in enumerate(query) for t in sorted(grams)]
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(a).alias("alternative"), F.lit(t).alias("trigram"), F.lit(need).alias("need")) for n, a, t, need in wanted]
    table = index.sparkSession.range(1).select(F.inline(F.array(*rows)))
    met = index.join(F.broadcast(table), "trigram").groupBy(*keys, "rule", "alternative", "need").agg(F.count("*").alias("got")).where("got = need")
    return met.groupBy(*keys).agg(F.collect_set("rule").alias("rules"))


def _met(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, dict[int, list[frozenset[str]]]]:
    """``docs`` as d, joined with the numbers of the rules that each row is a candidate of; and those rules' queries."""
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    if not queries:
        return docs.alias("d"), queries
    keys = ["doc_id", "text_hash"]
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    terms = sorted({t for q in queries.values() for alt in q for t in alt})
    index = materialize(postings(own, keys, terms).distinct(), "postings")
    found = materialize(candidates(index, keys, queries), "candidates")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("c.text_hash"))
    return docs.alias("d").join(bounded(found).alias("c"), same, "left"), queries


def _all_spans(text: Column, rules: tuple[Rule, ...], queries: dict[int, list[frozenset[str]]]) -> Column:
    """Spans of a row of ``_met``, by start, then rule."""
    none = F.array().cast(_SPAN)
    each = [_spans(text, r, n) if n not in queries else F.when(F.array_contains("c.rules", n), _spans(text, r, n)).otherwise(none) for n, r in enumerate(rules)]
    return F.array_sort(F.concat(*each))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: doc_id, text_hash, spans (start, kind_no, end, from_byte, to_byte).

    Null text counts as empty and has no spans; a null id is kept.  Spans are
    ordered by start, then by the rule's number.  Rows that repeat an id are told
    apart by their text; equal rows get equal results, each its own row.  Only the
    two named columns are read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met, queries = _met(own, "doc_id", "text", rules)
    return met.select("d.doc_id", F.xxhash64("d.text").alias("text_hash"), _all_spans(F.col("d.text"), rules, queries).alias("spans"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"], s["end"])), ",")


def _count(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_no"] == number))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    rules = BASE + MORE
    found = find_secrets(docs, id_col, text_col, rules)
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    counts = [_count(n).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(base, rules).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all other columns unchanged.

    Overlapping spans become one mark.  Texts without spans, null ones included,
    stay as they are; so do rows without an id, but for their secrets.  Equal rows
    stay equal; other columns may have any name.
    """
    rules = BASE + MORE
    met, queries = _met(docs, id_col, text_col, rules)
    text = F.col(f"d.`{text_col}`")
    none = F.array().cast("array<struct<from_byte:int,to_byte:int>>")

    def gaps_of(block: Column, ended: Column) -> Column:
        """What stands before the block's marks, one for each run of overlapping spans."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("from_byte"), s["from_byte"].alias("to_byte")))
            out = F.when(s["from_byte"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["to_byte"]).alias("at"), out.alias("out"))

        return F.aggregate(block, F.struct(ended.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def ends(blocks: Column) -> Column:
        """Where the spans before each block end."""
        last = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["to_byte"])))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(last, zero, lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def gaps(spans: Column) -> Column:
        found = _with(_blocks(spans), lambda blocks: F.flatten(F.zip_with(blocks, ends(blocks), gaps_of)))
        return F.struct(F.array_max(F.transform(spans, lambda s: s["to_byte"])).alias("at"), found.alias("gaps"))

    def rebuilt(x: Column) -> Column:
        cut = lambda first, last: F.substring(x["b"], first + 1, last - first).cast("string")
        parts = F.transform(x["g"]["gaps"], lambda g: cut(g["from_byte"], g["to_byte"]))
        return F.concat(F.array_join(parts, mark), F.lit(mark), cut(x["g"]["at"], F.octet_length(x["b"])))

    clean = _with(_all_spans(F.coalesce(text, F.lit("")), rules, queries), lambda spans: F.when(F.size(spans) == 0, text).otherwise(_with(F.struct(text.cast("binary").alias("b"), gaps(spans).alias("g")), rebuilt)))
    return met.select(*((clean if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def report_sql(table: str = "documents") -> str:
    """``secret_report`` as DuckDB SQL, by plain scans with the same expressions."""
    rules = BASE + MORE
    parts = []
    for n, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        ok = f"length(vs[i]) >= {r.least}" if r.least else "true"
        parts.append(
            f"select doc_id, t, list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::bigint, 'k': {n}, 'l': length(ms[i])::bigint, 'ok': {ok}}}), lambda x: x.ok) as spans "
            f"from (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{p}', 0) as ms, regexp_extract_all(coalesce(text, ''), '{p}', {r.group}) as vs, string_split_regex(coalesce(text, ''), '{p}') as ps from {table})"
        )
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    said = f"{names}[x.k + 1] || ':' || x.s || ':' || (x.s + x.l)"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = {n}))::bigint as n_{r.kind}" for n, r in enumerate(BASE))
    return (
        f"with each_rule as ({' union all '.join(parts)}), "
        "merged as (select doc_id, list_sort(flatten(list(spans))) as spans from each_rule group by doc_id) "
        f"select doc_id, {counts}, sha256(coalesce(list_aggregate(list_transform(list_filter(spans, lambda x: x.k < {len(BASE)}), lambda x: {said}), 'string_agg', ','), '')) as base_sha256, "
        f"coalesce(list_aggregate(list_transform(spans, lambda x: {said}), 'string_agg', ','), '') as spans from merged"
    )
