"""Near-duplicate groups by HyperMinHash.

Every text becomes the set of its k-word shingles (64-bit hashes).  A sketch
deals the set over ``REGISTERS`` buckets and keeps, for the least hash of each,
its leading-zero count and ten mantissa bits (16 bits together).  Empty buckets
borrow a full one, chosen by a fixed table, before the registers are banded.

1. Equal sets collapse to one representative (partial aggregation, so a group of
   any size costs one row per task).
2. Representatives that share a band key meet.  Within a key, the
   collision-corrected estimate of Jaccard similarity says which may be linked;
   those that may are joined by a spanning forest of stars.
3. The forests' components are families: no link crosses them.  Each family's
   full sets are compared, and give a spanning forest of exact links.
4. That forest's components are the result.

Steps 2 and 3 compare the members of a group.  A group that fits a chunk is one
task's work.  The members of a larger one are dealt into chunks, which first meet
a few leaders each: whoever is linked with a leader is in its class, and needs no
comparison within it.  Distance is a metric, so a member farther than twice the
limit from a leader is linked with nobody of its class; one nearer than that, but
not linked, visits the class and is compared with those of its members that are
far enough from the leader.  What no leader reaches meets the next, more numerous
leaders, and what is left after three rounds is compared chunk by chunk.  So a
group of near copies of any size costs a few comparisons a member; only members
that are unlike all leaders are compared with each other.

A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands;
rows and bands are chosen so that a pair exactly at the threshold is missed once
in 10,000.  The estimate rejects only what is four standard deviations under the
threshold, and the limits for leaders allow for three such errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqbraid.llm import textkit
from seqbraid.operators.components import connected_components
from seqbraid.plans.shared import bounded, materialize

REGISTERS = 128
MANTISSA = 10
MISS = 1e-4
#: Members of a band key, and of a family, that a chunk holds.
KEY_CHUNK, FAMILY_CHUNK = 512, 256
#: Leaders of each round in groups that don't fit a chunk.
LEADERS = (2, 16, 64)
_TRIES = 64

_rng = np.random.default_rng(20240501)
_DONORS = _rng.integers(0, REGISTERS, (_TRIES, REGISTERS))
_BAND_SEED = _rng.integers(1, 1 << 62, REGISTERS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def banding(threshold: float) -> tuple[int, int]:
    """Rows and bands: the most rows that still find a pair at the threshold."""
    for rows in range(16, 1, -1):
        if (1 - threshold**rows) ** (REGISTERS // rows) <= MISS:
            return rows, REGISTERS // rows
    return 1, REGISTERS


def least(hashes: np.ndarray) -> np.ndarray:
    """The least mixed hash of each bucket, all ones where there is none."""
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, (hashes % np.uint64(REGISTERS)).astype(np.int64), textkit.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1))
    return low


def compress(low: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of 63-bit values as 16 bits; 0xFFFF: empty."""
    empty = low == np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(empty, np.uint64(1), np.maximum(low, np.uint64(1)))
    top = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    top -= (value >> top.astype(np.uint64)) == 0  # log2 may round up
    zeros = 62 - top
    below = np.where(top >= MANTISSA, value >> np.maximum(top - MANTISSA, 0).astype(np.uint64), value << np.maximum(MANTISSA - top, 0).astype(np.uint64))
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (below & np.uint64((1 << MANTISSA) - 1))
    return np.where(empty, 0xFFFF, out).astype(np.uint16)


def densify(registers: np.ndarray) -> np.ndarray:
    """Each empty register takes the first full one in its own row of donors."""
    out, empty = registers.copy(), registers == 0xFFFF
    if empty.all():
        return out
    for donors in _DONORS:
        wanting = np.flatnonzero(out == 0xFFFF)
        if not len(wanting):
            return out
        given = donors[wanting]
        out[wanting] = np.where(empty[given], 0xFFFF, registers[given])
    out[out == 0xFFFF] = registers[~empty][0]
    return out


def band_keys(registers: np.ndarray, rows: int, bands: int) -> np.ndarray:
    used = densify(registers)[: rows * bands].astype(np.uint64) + np.uint64(1)
    key = (textkit.mix(used * _BAND_SEED[: rows * bands])).reshape(bands, rows).sum(axis=1, dtype=np.uint64)
    return textkit.mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def collisions(sizes: np.ndarray, other: float) -> np.ndarray:
    """The chance that two unequal bucket minima get the same register.

    Minima of b values fall under 2**-z with chance 1 - (1 - 2**-z)**b; two that
    share a leading-zero count share the mantissa once in 2**MANTISSA.
    """
    edge = np.ldexp(1.0, -np.arange(0, 40))

    def zeros(n):
        at = 1 - (1 - edge) ** np.maximum(np.atleast_1d(n)[:, None] / REGISTERS, 1.0)
        return at[:, :-1] - at[:, 1:]

    return (zeros(sizes) * zeros(other)).sum(axis=1) / (1 << MANTISSA)


def estimate(one: np.ndarray, many: np.ndarray, n_one: float, n_many: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of a sketch with many."""
    full = (many != 0xFFFF) | (one != 0xFFFF)
    held = np.maximum(full.sum(axis=1), 1)
    equal = ((many == one) & full).sum(axis=1) / held
    chance = collisions(n_many, n_one)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def spread(threshold: float, held: np.ndarray | float = REGISTERS) -> np.ndarray | float:
    """Four standard deviations of an estimate at the threshold."""
    return 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(held, 1))


def _sketches(text_col: str, k: int, fold: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, text_col):
            table = textkit.words(part.column(text_col), lower=fold)
            every = textkit.runs(table.hashes, k)
            n, sig, sketch = np.zeros(part.num_rows, np.int64), [], []
            for i in range(part.num_rows):
                found = textkit.shingles(table, i, k, every)
                n[i] = len(found)
                if len(found):
                    again = textkit.mix(found ^ np.uint64(0xD6E8FEB86659FD93))
                    sig.append(found.sum(dtype=np.uint64).tobytes() + again.sum(dtype=np.uint64).tobytes() + len(found).to_bytes(4, "little"))
                    sketch.append(compress(least(found)).tobytes())
                else:
                    sig.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])

    return run


def _keys(rows: int, bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = [band_keys(np.frombuffer(x, np.uint16), rows, bands) for x in part.column("data").to_pylist()]
            at = pa.array(np.repeat(np.arange(part.num_rows), bands))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), part.column("rep").take(at)], ["key", "rep"])

    return run


def _sets(k: int, fold: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, "text"):
            table = textkit.words(part.column("text"), lower=fold)
            every = textkit.runs(table.hashes, k)
            found = [textkit.shingles(table, i, k, every) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["rep", "size", "data"])

    return run


def trees(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[list[int]]:
    """The members that links join; near(i, others) says which of the others are linked with i.

    Each member is compared with those that no tree has reached yet, so a group
    whose members are all linked with one costs a comparison a member.
    """
    out, rest = [], np.arange(n)
    while len(rest):
        tree, rest = [int(rest[0])], rest[1:]
        for i in tree:
            if not len(rest):
                break
            linked = near(i, rest)
            tree += rest[linked].tolist()
            rest = rest[~linked]
        out.append(tree)
    return out


class Sketched:
    """Members of a group with their sketches; a link is what the estimate doesn't rule out."""

    def __init__(self, sizes: np.ndarray, data: list[bytes], threshold: float):
        self.size, self.threshold = sizes, threshold
        self.sketch = np.frombuffer(b"".join(data), np.uint16).reshape(-1, REGISTERS)
        self.held = (self.sketch != 0xFFFF).sum(axis=1)

    def similarity(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With each of the others (at most that, where sizes alone rule out a link), and whether it is a link."""
        small, large = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        value = small / large
        fits = np.flatnonzero(value >= self.threshold - 1e-9)
        linked = np.zeros(len(others), bool)
        if len(fits):
            near = others[fits]
            value[fits] = estimate(self.sketch[i], self.sketch[near], self.size[i], self.size[near])
            linked[fits] = value[fits] >= self.threshold - spread(self.threshold, np.minimum(self.held[near], self.held[i]))
        return value, linked


class Exact:
    """Members of a group with their full sets; a link is exact."""

    def __init__(self, sizes: np.ndarray, data: list[bytes], num: int, den: int):
        self.size, self.num, self.den = sizes, num, den
        every = np.frombuffer(b"".join(data), np.uint64)
        self.flat = np.unique(every, return_inverse=True)[1]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(every) else 1, bool)

    def similarity(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of sketches; the similarity of texts whose sizes fit is exact."""
        small, large = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        value = small / large
        fits = np.flatnonzero(self.den * small >= self.num * large)
        linked = np.zeros(len(others), bool)
        if len(fits):
            near = others[fits]
            mine = self.flat[self.at[i] : self.at[i + 1]]
            self.mark[mine] = True
            if 4 * len(near) > len(self.size):
                upto = np.concatenate([[0], np.cumsum(self.mark[self.flat], dtype=np.int64)])
                both = upto[self.at[near + 1]] - upto[self.at[near]]
            else:
                both = np.array([np.count_nonzero(self.mark[self.flat[self.at[j] : self.at[j + 1]]]) for j in near], np.int64)
            self.mark[mine] = False
            union = self.size[near] + self.size[i] - both
            value[fits], linked[fits] = both / union, self.den * both >= self.num * union
        return value, linked


Group = Callable[[np.ndarray, list[bytes]], "Sketched | Exact"]


def _group(table: pa.Table, kind: Group) -> Sketched | Exact:
    return kind(table.column("size").to_numpy(), table.column("data").to_pylist())


def _edges(ids: list, pairs: list[tuple[int, int]], id_type: pa.DataType) -> pa.Table:
    return pa.table({c: pa.array([ids[p[n]] for p in pairs], id_type) for n, c in enumerate("ab")})


def _forest(kind: Group, id_type: pa.DataType) -> Callable:
    """Links of a whole group, or of two chunks, as stars around the smallest of each tree."""

    def run(table: pa.Table) -> pa.Table:
        group, ids = _group(table, kind), table.column("rep").to_pylist()
        pairs = []
        for tree in trees(table.num_rows, lambda i, others: group.similarity(i, others)[1]):
            least = min(tree, key=ids.__getitem__)
            pairs += [(i, least) for i in tree if i != least]
        return _edges(ids, pairs, id_type)

    return run


def _meet_leaders(kind: Group, reach: float, id_type: pa.DataType) -> Callable:
    """A chunk's members with the leaders they are linked with, their class, and the classes they visit."""

    def run(table: pa.Table) -> pa.Table:
        leads = table.column("leads").to_numpy(zero_copy_only=False)
        group, lead, member = _group(table, kind), np.flatnonzero(leads), np.flatnonzero(~leads)
        order = lead[np.argsort(table.column("nth").to_numpy()[lead], kind="stable")]
        ids = table.column("rep").to_pylist()
        links: list[list] = [[] for _ in member]
        visits: list[list] = [[] for _ in member]
        own = np.full(len(member), -1)
        away = np.full(len(member), np.nan)
        for n, i in enumerate(order):
            value, linked = group.similarity(i, member)
            for j in np.flatnonzero(linked):
                links[j].append(ids[i])
            new = linked & (own < 0)
            for j in np.flatnonzero(~linked & (own < 0) & (1 - value <= reach)):
                visits[j].append((ids[i], 1 - value[j]))
            own[new], away[new] = n, 1 - value[new]
        at = pa.array(member)
        leader = pa.array([ids[order[n]] if n >= 0 else None for n in own], id_type)
        return pa.table({
            **{c: table.column(c).take(at) for c in ("key", "rep", "size", "data")},
            "leader": leader,
            "away": pa.array(away, pa.float64(), from_pandas=True),
            "links": pa.array(links, pa.list_(id_type)),
            "visits": pa.array([[{"leader": x, "away": d} for x, d in v] for v in visits], pa.list_(pa.struct([("leader", id_type), ("away", pa.float64())]))),
        })

    return run


def _visit(kind: Group, id_type: pa.DataType) -> Callable:
    """Visitors and members of a chunk of a class: a link of each visitor, if it has one."""

    def run(table: pa.Table) -> pa.Table:
        visits = table.column("visits").to_numpy(zero_copy_only=False)
        group, host = _group(table, kind), np.flatnonzero(~visits)
        pairs = []
        for i in np.flatnonzero(visits):
            linked = np.flatnonzero(group.similarity(i, host)[1])
            pairs += [(int(i), int(host[j])) for j in linked[:1]]
        return _edges(table.column("rep").to_pylist(), pairs, id_type)

    return run


def _chunk(n: str, chunk: int):
    return F.ceil(F.col(n) / chunk).cast("int")


def _dealt(rows: DataFrame, into: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("rep", F.lit(7)), F.col(into)).cast("int"))


def _in_chunks(members: DataFrame, chunk: int, run: Callable, out: str) -> DataFrame:
    """``run`` over every pair of chunks of every key; keys of one member are left out."""
    count = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", _chunk("n", chunk).alias("_c")), "chunks")
    dealt = _dealt(members.join(count, "key"), "_c", "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    dealt = dealt.withColumn("_lo", F.least("_i", "_j")).withColumn("_hi", F.greatest("_i", "_j")).drop("_c", "_i", "_j")
    return dealt.groupBy("key", "_lo", "_hi").applyInArrow(run, out)


def _visits(met: DataFrame, slack: float, limit: float, chunk: int, run: Callable, out: str) -> DataFrame:
    """Each class's visitors against those of its members that are far enough from the leader."""
    guests = met.select("key", "rep", "size", "data", F.explode("visits").alias("v")).select("key", F.col("v.leader").alias("leader"), "rep", "size", "data", F.col("v.away").alias("away"))
    need = materialize(guests.groupBy("key", "leader").agg(F.min("away").alias("_low"), F.count("*").alias("_guests")), "visited")
    hosts = met.where("leader is not null").select("key", "leader", "rep", "size", "data", "away").join(need, ["key", "leader"]).where(F.col("away") >= F.col("_low") - limit - slack)
    count = hosts.groupBy("key", "leader", "_guests").agg(F.count("*").alias("_hosts"))
    count = materialize(count.select("key", "leader", _chunk("_hosts", chunk).alias("_h"), _chunk("_guests", chunk).alias("_g")), "chunks")
    names = ["key", "leader", "_i", "_j", "rep", "size", "data", "visits"]
    left = _dealt(hosts.join(count, ["key", "leader"]), "_h", "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).withColumn("visits", F.lit(False))
    right = _dealt(guests.join(count, ["key", "leader"]), "_g", "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_h") - 1))).withColumn("visits", F.lit(True))
    return left.select(*names).unionByName(right.select(*names)).groupBy("key", "leader", "_i", "_j").applyInArrow(run, out)


def group_links(pairs: DataFrame, payload: Callable[[DataFrame], DataFrame], chunk: int, kind: Group, limit: float, slack: float) -> DataFrame:
    """(a, b): links that join all members of a key that links join.

    ``pairs``: key, rep, read more than once; ``payload`` gives rep, size and data of
    a table's reps.  ``limit``: the distance of a link, ``slack`` what measured
    distances may be off over a chain of two links.
    """
    id_kind = pairs.schema["rep"].dataType
    name, arrow = id_kind.simpleString(), to_arrow_type(id_kind)
    out = f"a {name}, b {name}"
    counts = materialize(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "group_sizes")

    def members(keys: DataFrame) -> DataFrame:
        some = pairs.join(keys.select("key"), "key")
        return some.join(payload(some.select("rep").distinct()), "rep").select("key", "rep", "size", "data")

    found = [members(counts.where(F.col("n") <= chunk)).groupBy("key").applyInArrow(_forest(kind, arrow), out)]
    large = counts.where(F.col("n") > chunk)
    if large.isEmpty():
        return found[0]
    left = materialize(members(large), "large_groups")
    met_schema = f"key {pairs.schema['key'].dataType.simpleString()}, rep {name}, size long, data binary, leader {name}, away double, links array<{name}>, visits array<struct<leader:{name},away:double>>"
    for turn, many in enumerate(LEADERS):
        count = materialize(left.groupBy("key").agg(F.count("*").alias("n")).select("key", _chunk("n", chunk).alias("_c")), "chunks")
        slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(many)).alias("nth")
        heads = left.groupBy("key", slot).agg(F.min_by(F.struct("rep", "size", "data"), F.struct(F.xxhash64("rep"), "rep", "data")).alias("x")).select("key", "nth", "x.*")
        heads = heads.join(count, "key").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).withColumn("leads", F.lit(True))
        rows = _dealt(left.join(count, "key"), "_c", "_i").withColumn("leads", F.lit(False)).withColumn("nth", F.lit(0).cast("long"))
        names = ["key", "_i", "rep", "size", "data", "leads", "nth"]
        meeting = _meet_leaders(kind, 2 * limit + slack, arrow)
        met = materialize(heads.select(*names).unionByName(rows.select(*names)).groupBy("key", "_i").applyInArrow(meeting, met_schema), "met_leaders")
        found.append(met.select(F.col("rep").alias("a"), F.explode("links").alias("b")).where("a <> b"))
        if not met.where("size(visits) > 0").isEmpty():
            found.append(_visits(met, slack, limit, chunk, _visit(kind, arrow), out))
        left = met.where("leader is null").select("key", "rep", "size", "data")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
    found.append(_in_chunks(left, chunk, _forest(kind, arrow), out))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 85, den: int = 100, fold_case: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are linked when ``den * intersection >= num * union`` of their sets of
    k-word shingles (a text of fewer words is one shingle).  A null, empty or
    wordless text has an empty set, is linked with nothing and is kept.  Equal
    texts are always linked; ties go to the smaller id, so results don't depend
    on row order.  Only the two named columns are read; a repeated id gives a row
    for each of its rows.  A row whose id is null can't be named by others: it is
    linked with nothing, has no component and is kept.  Ids are of any type that
    can be ordered.
    """
    threshold = num / den
    rows, bands = banding(threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = materialize(own.mapInArrow(_sketches("text", k, fold_case), f"doc_id {kind}, n_shingles long, sig binary, sketch binary"), "sketches")
    known = every.where("sig is not null and doc_id is not null")
    reps = materialize(known.groupBy("sig").agg(F.min("doc_id").alias("rep")), "representatives")
    # A repeated id may carry two texts, so a representative is an id and a signature.
    sketch = known.withColumnRenamed("doc_id", "rep").join(reps, ["sig", "rep"], "left_semi").dropDuplicates(["sig", "rep"]).select("rep", F.col("n_shingles").alias("size"), F.col("sketch").alias("data"))
    sketch = materialize(sketch, "rep_sketches")
    keys = materialize(sketch.mapInArrow(_keys(rows, bands), f"key long, rep {kind}"), "bands")
    may = group_links(keys, lambda reps: sketch, KEY_CHUNK, partial(Sketched, threshold=threshold), 1 - threshold, 3 * float(spread(threshold)))
    family = materialize(connected_components(may).withColumnRenamed("node", "rep").withColumnRenamed("component", "key"), "families")
    texts = own.withColumnRenamed("doc_id", "rep")

    def sets(reps: DataFrame) -> DataFrame:
        # By a hash of the id, whose size is known; a few other texts may come along.
        wanted = bounded(materialize(reps.select(F.xxhash64("rep").alias("h")), "wanted"))
        some = texts.join(wanted, F.xxhash64("rep") == F.col("h"), "left_semi")
        return some.mapInArrow(_sets(k, fold_case), f"rep {kind}, size long, data binary").where("size > 0").distinct()

    links = group_links(family, sets, FAMILY_CHUNK, partial(Exact, num=num, den=den), 1 - threshold, 1e-9)
    found = connected_components(links).withColumnRenamed("node", "rep")
    final = reps.join(found, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    joined = known.select("doc_id", "n_shingles", "sig").join(final, "sig", "left").select("doc_id", "n_shingles", "component_id")
    alone = every.where("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns unchanged.

    Of rows that repeat an id, all are kept if the id is; rows without an id are
    kept.  Other columns may have any name.
    """
    gone = materialize(near_duplicates(docs, id_col, text_col, k, num, den).where("not kept").select("doc_id").distinct(), "gone")
    return docs.alias("_docs").join(bounded(gone).alias("_gone"), F.col(f"_docs.{id_col}") == F.col("_gone.doc_id"), "left_anti")


def near_duplicates_sql(table: str = "documents", k: int = 3, num: int = 85, den: int = 100) -> str:
    """``near_duplicates`` as DuckDB SQL: all pairs that share a shingle, then reachability.

    For tables small enough to join the shingles with themselves.
    """
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return (
        f"with recursive words as (select doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') as w from {table}), "
        f"sets as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < {k} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {k - 2}), lambda i: {run}) end) as s from words), "
        "shingles as (select doc_id, unnest(s) as g from sets where doc_id is not null), "
        "shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all), "
        f"links as (select x, y from shared join sets sx on sx.doc_id = x join sets sy on sy.doc_id = y where {den} * c >= {num} * (len(sx.s) + len(sy.s) - c)), "
        "both_ways as (select x, y from links union all select y, x from links), "
        "reach(node, got) as (select doc_id, doc_id from sets where doc_id is not null union select r.node, b.y from reach r join both_ways b on b.x = r.got), "
        "least as (select node, min(got) as low from reach group by node) "
        "select s.doc_id, len(s.s)::bigint as n_shingles, l.low as component_id, coalesce(l.low = s.doc_id, true) as kept "
        "from sets s left join least l on l.node = s.doc_id"
    )
