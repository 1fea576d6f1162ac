"""Registered queries over the driver's tables, with the same in DuckDB SQL.

The tables hold no sequences.  A user's barcode is the digest of a number in four
letters.  Four users in a row share the number, and each differs from the one before
in two letters, so that centres form chains within reach of the next but not of the
one after.  Of a hundred events some read the barcode with one letter changed, two,
one lost, one more, an unknown letter, or half of the way to the next user, which
is as near to both.  Every fifth event counts twice.

Message passing and spheres decide strings one after another; their SQL does the
same in a recursion that carries what has been decided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqbraid import api
from seqbraid.functions import strings
from seqbraid.operators import collapse, components, message_passing, pairs, spheres
from seqbraid.plans import ship
from seqbraid.plans.shared import materialize, new_path
from seqbraid.sources import reads as sources, render
from seqbraid.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

_HEX, _DNA = "0123456789abcdef", "ACGTACGTACGTACGT"


def _code(key: str, start: int, length: int, text: str = "string") -> str:
    return f"substr(translate(md5(cast({key} as {text})), '{_HEX}', '{_DNA}'), {start}, {length})"


def _plain(text: str = "string") -> str:
    """A user's barcode, every seventh event with one letter changed: centres far apart with variants around them."""
    code, at = _code("user_id", 1, 20, text), "cast(event_id % 20 as int)"
    return f"case when event_id % 7 = 0 then concat(substr({code}, 1, {at}), 'A', substr({code}, {at} + 2)) else {code} end"


def _barcode(text: str = "string") -> str:
    """As the module says."""
    group, kind = _code("cast(floor(user_id / 4) as int)", 1, 20, text), "(event_id * 31 + user_id) % 100"
    half, two = f"(case when {kind} >= 98 then 1 else 0 end)", f"(case when {kind} between 81 and 86 then 1 else 0 end)"
    # Letters are turned to the next one where a user has gone so far, or is half on the way; or for a second change.
    turned = {5: f"user_id % 4 + {half} >= 1", 7: f"user_id % 4 + {half} >= 2", 9: f"user_id % 4 + {half} >= 3", 12: f"{two} = 1", 15: "user_id % 4 >= 1", 17: "user_id % 4 >= 2", 19: "user_id % 4 >= 3"}
    letters, last = [], 0
    for at, when in turned.items():
        letters += [f"substr({group}, {last + 1}, {at - last - 1})", f"translate(substr({group}, {at}, 1), 'ACGT', case when {when} then 'CGTA' else 'ACGT' end)"]
        last = at
    code = f"concat({', '.join([*letters, f'substr({group}, {last + 1})'])})"
    at = "cast(1 + (event_id * 7) % 20 as int)"
    changed = f"translate(substr({code}, {at}, 1), 'ACGT', 'CGTA')"
    put = f"case when {kind} < 71 or {kind} >= 98 then substr({code}, {at}, 1) when {kind} < 87 then {changed} when {kind} < 91 then '' when {kind} < 95 then concat(substr({code}, {at}, 1), 'G') else 'N' end"
    return f"concat(substr({code}, 1, {at} - 1), {put}, substr({code}, {at} + 1))"


def _tagged(text: str = "string") -> str:
    """A tag of eight letters by the value's parity, then the barcode and a tail of six."""
    return f"concat({_code('cast(event_id % 3 as int)', 1, 8, text)}, {_plain(text)}, {_code('user_id', 21, 6, text)})"


def _mate(text: str = "string") -> str:
    return _code("user_id", 13, 18, text)


_COUNT = "case when event_id % 5 = 0 then 2 else 1 end"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    ship.true_sizes(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").fillna(-1, ["user_id"])


def _reads(spark: SparkSession, sf_dir: str, seq: str | None = None, mate: str | None = None, cnt: str = _COUNT) -> DataFrame:
    empty = F.lit(None).cast("string")
    columns = {"read_id": F.col("event_id"), "seq": F.expr(seq or _barcode()), "cnt": F.expr(cnt).cast("long"), "header": F.col("event_type"), "seq2": F.expr(mate) if mate else empty}
    return _events(spark, sf_dir).select(*(columns.get(c, empty).alias(c) for c in sources.COLUMNS))


def _uniq(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return materialize(collapse.ranked(collapse.collapse(_reads(spark, sf_dir, **how))), "uniq")


def _named(found: DataFrame, uniq: DataFrame, **columns: str) -> DataFrame:
    """``found`` with the strings of the uids in its columns, in their place."""
    for column, name in columns.items():
        found = found.join(uniq.select(F.col("uid").alias(column), F.col("key").alias(f"_{name}")), column).drop(column).withColumnRenamed(f"_{name}", name)
    return found


def normalize_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _reads(spark, sf_dir, seq=f"lower({_barcode()})")
    return sources.normalize(low).select("read_id", "seq", F.length("seq").cast("long").alias("len"))


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(_reads(spark, sf_dir)).select("seq", "cnt", "first_read_id")


def dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(_reads(spark, sf_dir), with_ids=True).select("seq", F.array_join("read_ids", ",").alias("read_ids"))


def first_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(_reads(spark, sf_dir), with_info=True).select("seq", "header")


def ranked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uniq(spark, sf_dir).select("uid", "seq", F.col("len").cast("long").alias("len"))


def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    names = sources.from_dataframe(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", id_col="p_partkey")
    return spark.createDataFrame(strings.length_histogram(collapse.ranked(collapse.collapse(names))), "len long, n long")


def auto_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = strings.median_length(strings.length_histogram(_uniq(spark, sf_dir)))
    return spark.createDataFrame([(median, strings.auto_distance(median))], "median long, distance long")


def _pairs(most: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        uniq = _uniq(spark, sf_dir)
        return _named(pairs.similar_pairs(uniq, most), uniq, a="seq_a", b="seq_b").withColumn("dist", F.col("dist").cast("long"))

    return query


def pairs_parts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship.ensure(spark)
    names = sources.from_dataframe(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", id_col="p_partkey")
    uniq = materialize(collapse.ranked(collapse.collapse(names)), "uniq")
    return _named(pairs.similar_pairs(uniq, 3, wildcard=None), uniq, a="seq_a", b="seq_b").withColumn("dist", F.col("dist").cast("long"))


def pairs_two_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir)
    users = _events(spark, sf_dir).select("user_id").distinct()
    queries = users.select(F.col("user_id").alias("uid"), F.expr(_code("cast(floor(user_id / 4) as int)", 1, 20)).alias("seq"))
    found = _named(pairs.pairs_against(queries, uniq, 2), uniq, target="seq")
    return found.select(F.col("query").alias("user_id"), "seq", F.col("dist").cast("long").alias("dist"))


def paired_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir, seq=_plain(), mate=_mate())
    return _named(pairs.similar_pairs(uniq, 3, paired=True), uniq, a="seq_a", b="seq_b").withColumn("dist", F.col("dist").cast("long"))


def paired_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _events(spark, sf_dir).select("event_id", F.expr(_plain()).alias("s"), F.expr(_code("user_id", 1, 20)).alias("t"), F.expr(_mate()).alias("m"), F.expr(_code("user_id", 12, 18)).alias("n"))
    return read.select("event_id", strings.pair_distance(F.col("s"), F.col("m"), F.col("t"), F.col("n"), 8, None).cast("long").alias("dist"))


def mp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir)
    edges = message_passing.oriented(pairs.similar_pairs(uniq, 2, ratio=5.0), uniq, 5.0)
    return _named(edges, uniq, child="child_seq", parent="parent_seq").withColumn("dist", F.col("dist").cast("long"))


def mp_direct_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir)
    edges = message_passing.oriented(pairs.similar_pairs(uniq, 2, ratio=2.0), uniq, 2.0)
    return _named(message_passing.direct_parents(edges), uniq, child="child_seq", parent="parent_seq").withColumn("dist", F.col("dist").cast("long"))


def neighbor_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir)
    return _named(spheres.neighbour_weight(uniq, pairs.similar_pairs(uniq, 2)), uniq, uid="seq")


def cc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    uniq = _uniq(spark, sf_dir)
    return _named(components.connected_components(pairs.similar_pairs(uniq, 2)), uniq, node="seq", component="label")


def _clustered(algorithm: str, look: Callable[[api.Clustering], DataFrame], seq: str | None = None, mate: str | None = None, ratio: float = 5.0, info: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return look(api.cluster(_reads(spark, sf_dir, seq, mate), None, ratio, algorithm, with_info=info))

    return query


def _sizes(found: api.Clustering) -> DataFrame:
    return found.clusters().select("canonical", "size", "n_unique")


def _lists(found: api.Clustering) -> DataFrame:
    return found.clusters(ids=True).select("canonical", F.array_join("members", ",").alias("members"), F.array_join("read_ids", ",").alias("read_ids"))


def _layout(lines: Callable[[api.Clustering], DataFrame], algorithm: str = "mp", info: bool = False) -> Query:
    """The lines of an output file, numbered as they stand in it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "layout")
        reads = _reads(spark, sf_dir).withColumns({"header": F.concat(F.lit("@"), F.col("read_id")), "qual": F.lit("I")})
        render.write(lines(api.cluster(reads, None, 5.0, algorithm, with_info=info)), path)
        return sources.lines(spark, path).select("line_no", "value")

    return query


def umi_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.cluster_tags(_reads(spark, sf_dir, _tagged(), cnt="1"), 8, 0, 2, 20, with_ids=True)
    return found.select("canonical", "tag_canonical", "seq_canonical", "size", F.array_join("read_ids", ",").alias("read_ids"))


def umi_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.cluster_tags(_reads(spark, sf_dir, _tagged(), _mate(), cnt="1"), 8, 0, 2, 0)
    return found.select("canonical", "size")


def layout_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "layout")
    render.write(render.tag_lines(api.cluster_tags(_reads(spark, sf_dir, _tagged(), cnt="1"), 8, 0, 2, 20)), path)
    return sources.lines(spark, path).select("line_no", "value")


def _file_round_trip(fmt: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        reads = _reads(spark, sf_dir, _plain())
        header = F.concat(F.lit(">" if fmt == "fasta" else "@"), F.col("read_id"), F.lit(" "), F.col("header"))
        rows = reads.select("seq", header.alias("header"), F.lit("I" * 20).alias("qual"), F.col("seq").alias("canonical"), F.col("read_id").alias("size"))
        path = new_path(spark, fmt)
        render.write(render.unique_lines(rows, fmt) if fmt != "raw" else render.cluster_lines(rows), path)
        return sources.read(spark, path, fmt=fmt).select("read_id", "seq", "cnt", "header")

    return query


def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir, _plain(), _mate())
    header = F.concat(F.lit("@"), F.col("read_id").cast("string"))
    rows = reads.select("seq", "seq2", header.alias("header"), header.alias("header2"), F.lit("I").alias("qual"), F.lit("J").alias("qual2"), F.col("seq").alias("canonical"), F.col("read_id").alias("size"))
    one, two = new_path(spark, "mate1"), new_path(spark, "mate2")
    render.write(render.unique_lines(rows, "fastq", 1), one)
    render.write(render.unique_lines(rows, "fastq", 2), two)
    return sources.read(spark, one, two).select("read_id", "seq", "seq2", "header2")


def stream_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ship.ensure(spark)
    return incremental.collapse_files(spark, f"{sf_dir}/events.parque?", schema, _barcode().replace("user_id", "coalesce(user_id, -1)"), "event_id")


def queries() -> dict[str, Query]:
    plain = (normalize_reads, dedup_counts, dedup_ids, first_info, ranked_order, length_hist, auto_distance, pairs_parts_text, pairs_two_table, paired_pairs, paired_distance, mp_edges, mp_direct_parents, neighbor_weight, cc_labels, umi_clusters, umi_paired, layout_tags, paired_files, stream_collapse)
    found = {f.__name__: f for f in plain}
    found |= {"pairs_d1": _pairs(1), "pairs_d2": _pairs(2), "pairs_d3": _pairs(3)}
    found |= {f"{fmt}_round_trip": _file_round_trip(fmt) for fmt in sources.FORMATS}
    found |= {
        "mp_clusters": _clustered("mp", _sizes),
        "mp_lists": _clustered("mp", _lists),
        "mp_tidy": _clustered("mp", api.Clustering.tidy),
        "mp_nonredundant": _clustered("mp", lambda c: c.non_redundant().select("canonical", "size", "header"), info=True),
        "mp_paired": _clustered("mp", _sizes, _plain(), _mate()),
        "sphere_clusters": _clustered("spheres", _sizes),
        "sphere_tidy": _clustered("spheres", api.Clustering.tidy),
        "cc_clusters": _clustered("components", _sizes),
        "layout_clusters": _layout(lambda c: render.cluster_lines(c.clusters())),
        "layout_members": _layout(lambda c: render.cluster_lines(c.clusters(), members=True), "spheres"),
        "layout_ids": _layout(lambda c: render.cluster_lines(c.clusters(ids=True), ids=True), "components"),
        "layout_members_ids": _layout(lambda c: render.cluster_lines(c.clusters(ids=True), members=True, ids=True)),
        "layout_tidy": _layout(lambda c: render.tidy_lines(c.tidy())),
        "layout_unique_raw": _layout(lambda c: render.unique_lines(c.non_redundant(), "raw")),
        "layout_unique_fasta": _layout(lambda c: render.unique_lines(c.non_redundant(), "fasta"), info=True),
        "layout_unique_fastq": _layout(lambda c: render.unique_lines(c.non_redundant(), "fastq"), "spheres", info=True),
    }
    return found


_SQL_EVENTS = "(select * replace (coalesce(user_id, -1) as user_id) from events)"


def _sql_reads(seq: str | None = None, mate: str | None = None, cnt: str = _COUNT) -> str:
    return f"reads as (select event_id as read_id, {seq or _barcode('varchar')} as seq, {mate or 'null'} as mate, event_type as header, ({cnt})::bigint as n from {_SQL_EVENTS})"


_SQL_UNIQ = (
    "uniq as (select *, row_number() over (order by length(key), key) as uid from (select seq, mate, case when mate is null then seq else concat(seq, '---------', mate) end as key, "
    "case when mate is null then seq else concat(seq, '/', mate) end as name, sum(n)::bigint as cnt, min(read_id) as first_read_id, arg_min(header, read_id) as header, list(read_id order by read_id) as ids from reads group by seq, mate))"
)


def _sql_pairs(most: int, paired: bool = False, wildcard: str = "N") -> str:
    lev = lambda c: f"levenshtein(translate(x.{c}, '{wildcard}', '#'), y.{c})" if wildcard else f"levenshtein(x.{c}, y.{c})"
    dist = lev("seq") + (f" + {lev('mate')}" if paired else "")
    return f"pairs as materialized (select x.uid as a, y.uid as b, x.key as seq_a, y.key as seq_b, x.cnt as ca, y.cnt as cb, {dist} as dist from uniq x join uniq y on x.uid < y.uid and abs(length(x.key) - length(y.key)) <= {most} where {dist} <= {most})"


def _sql_edges(ratio: float) -> str:
    return f"edges as (select case when ca >= cb then b else a end as child, case when ca >= cb then a else b end as parent, dist from pairs where greatest(ca, cb) >= {ratio} * least(ca, cb))"


_SQL_DIRECT = "direct as materialized (select child, parent, dist from (select *, min(dist) over (partition by child) as low from edges) where dist = low)"
_SQL_CHAIN = "chain(uid, root) as (select uid, uid from uniq where uid not in (select child from direct) union select d.child, c.root from direct d join chain c on d.parent = c.uid)"
#: What parents agree on; a string whose parents don't is open, and so are its children here.  Then what the agreed ones handed on, and
#: the open ones in turn.  The data's open strings have counts under the ratio, so none of them has children, and they come by uid.
_SQL_MP = (
    "sure as materialized (select uid, min(root) as canonical from chain group by uid having count(distinct root) = 1), "
    "fans as (select parent as uid, count(*) as fan from direct group by parent), "
    "held as materialized (select s.canonical, sum(u.cnt)::bigint as c, sum(case when s.uid <> s.canonical then 1 + coalesce(f.fan, 0) else 0 end)::bigint as s from sure s join uniq u on u.uid = s.uid left join fans f on f.uid = s.uid group by s.canonical), "
    "waiting as materialized (select row_number() over (order by d.child) as step, d.child as uid, any_value(u.cnt) as cnt, list(d.parent) as ps, list(s.canonical) as cs from direct d join uniq u on u.uid = d.child join sure s on s.uid = d.parent where d.child not in (select uid from sure) group by d.child), "
    "turns(step, uid, canonical, counts) as (select 0::bigint, null::bigint, null::bigint, (select map_from_entries(list((canonical, {'c': c, 's': s}))) from held) "
    "union all select step, uid, pick, map_concat(counts, map([pick], [{'c': counts[pick].c + cnt, 's': counts[pick].s + 1}])) from ("
    "select w.step, w.uid, w.cnt, t.counts, coalesce(case when len(list_filter(own, lambda p: t.counts[p] = top)) = 1 then list_filter(own, lambda p: t.counts[p] = top)[1] end, "
    "list_sort(list_transform(w.cs, lambda c: {'n': -t.counts[c].c, 'c': c}))[1].c) as pick from turns t join (select *, list_distinct(list_filter(ps, lambda p: list_contains(cs, p))) as own from waiting) w on w.step = t.step + 1, "
    "lateral (select list_max(list_transform(own, lambda p: t.counts[p])) as top))), "
    "canon as materialized (select uid, canonical from sure union all select uid, canonical from turns where uid is not null)"
)
_SQL_BOTH = "both_ways as materialized (select a, b, ca as own, cb as cnt, dist from pairs union all select b, a, cb, ca, dist from pairs)"
_SQL_REACH = "reach(node, got) as (select uid, uid from uniq union select r.node, e.b from reach r join both_ways e on r.got = e.a)"
_SQL_LABEL = "label as materialized (select node, min(got) as component from reach group by node)"
_SQL_CENTRE = "canon as (select l.node as uid, first_value(l.node) over (partition by l.component order by u.cnt desc, coalesce(d.n, 0) desc, u.uid) as canonical from label l join uniq u on u.uid = l.node left join (select a, count(*) as n from both_ways group by a) d on d.a = l.node)"
#: Visits in order; a string that none of the centres so far is next to becomes one.
_SQL_SPHERE = (
    "visits as materialized (select row_number() over (order by any_value(own) desc, sum(cnt) desc, a) as step, a as uid, list(b) as near from both_ways group by a), "
    "walk(step, uid, centre, centres) as (select 0::bigint, null::bigint, false, []::bigint[] union all "
    "select v.step, v.uid, not list_has_any(v.near, w.centres), case when list_has_any(v.near, w.centres) then w.centres else list_append(w.centres, v.uid) end from walk w join visits v on v.step = w.step + 1), "
    "centres as materialized (select uid, step from walk where centre), "
    "canon as materialized (select uid, uid as canonical from uniq where uid not in (select uid from walk where not centre and uid is not null) "
    "union all select e.a, arg_min(e.b, {'d': e.dist, 's': c.step}) from both_ways e join centres c on c.uid = e.b where e.a in (select uid from walk where not centre) group by e.a)"
)


def _with(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


def oracle_sql() -> dict[str, str]:
    reads = _sql_reads()
    base = _with(reads, _SQL_UNIQ)
    mp = _with(reads, _SQL_UNIQ, _sql_pairs(2), _sql_edges(5.0), _SQL_DIRECT, _SQL_CHAIN, _SQL_MP)
    cc = _with(reads, _SQL_UNIQ, _sql_pairs(2), _SQL_BOTH, _SQL_REACH, _SQL_LABEL, _SQL_CENTRE)
    sphere = _with(reads, _SQL_UNIQ, _sql_pairs(2), _SQL_BOTH, _SQL_SPHERE)
    mates = _sql_reads(_plain("varchar"), _mate("varchar"))
    paired = _with(mates, _SQL_UNIQ, _sql_pairs(3, True))
    paired_mp = _with(mates, _SQL_UNIQ, _sql_pairs(3, True), _sql_edges(5.0), _SQL_DIRECT, _SQL_CHAIN, _SQL_MP)
    sizes = "select c.name as canonical, sum(u.cnt)::bigint as size, count(*) as n_unique from canon a join uniq u on u.uid = a.uid join uniq c on c.uid = a.canonical group by c.name"
    lists = "select c.name as canonical, sum(u.cnt)::bigint as size, string_agg(u.name, ',' order by u.name) as members, array_to_string(list_sort(flatten(list(u.ids))), ',') as read_ids from canon a join uniq u on u.uid = a.uid join uniq c on c.uid = a.canonical group by c.name"
    tidy = "select r.read_id, u.name as seq, c.name as canonical from reads r join uniq u on u.seq = r.seq join canon a on a.uid = u.uid join uniq c on c.uid = a.canonical"
    kept = f"select s.canonical, s.size, concat('@', u.first_read_id) as header from ({sizes}) s join uniq u on u.name = s.canonical"
    pair = "select seq_a, seq_b, dist::bigint as dist from pairs where dist > 0"
    named = "select x.key as child_seq, y.key as parent_seq, dist::bigint as dist from {t} join uniq x on x.uid = child join uniq y on y.uid = parent"
    ordered = "row_number() over (order by read_id desc)"

    def layout(query: str, *columns: str, order: str = "size desc, canonical") -> str:
        return f"select row_number() over (order by {order}) as line_no, concat_ws(chr(9), {', '.join(columns)}) as value from ({query})"

    def unique(*lines: str) -> str:
        each = ", ".join(f"{{'i': {i}, 'x': {x}}}" for i, x in enumerate(lines))
        return f"select row_number() over (order by size desc, canonical, l.i) as line_no, l.x as value from (select *, unnest([{each}]) as l from ({kept}))"

    tagged = f"tagged as (select event_id as read_id, substr(s, 1, 8) as tag, substr(s, 9, 20) as seq, substr(s, 29) as tail from (select event_id, {_tagged('varchar')} as s from {_SQL_EVENTS}))"
    tag_reads = "reads as (select read_id, seq, null as mate, null as header, 1::bigint as n from tagged)"
    tails = "tails as (select canonical, arg_min(tail, {'n': -n, 'pos': pos}) as tail from (select canonical, tail, count(*) as n, max(read_id) as pos from assigned group by canonical, tail) group by canonical)"
    assigned = "assigned as materialized (select t.*, c.seq as canonical from tagged t join uniq u on u.seq = t.seq join canon a on a.uid = u.uid join uniq c on c.uid = a.canonical)"
    umi = _with(tagged, tag_reads, _SQL_UNIQ, _sql_pairs(2), _sql_edges(3.0), _SQL_DIRECT, _SQL_CHAIN, _SQL_MP, assigned, tails)
    umi_groups = "select concat(tag, a.canonical, t.tail) as canonical, tag as tag_canonical, concat(a.canonical, t.tail) as seq_canonical, count(*) as size, string_agg(read_id, ',' order by read_id) as read_ids from assigned a join tails t on t.canonical = a.canonical group by tag, a.canonical, t.tail"
    # Of a pair, both mates' first eight letters are the tag and all that follows, end to end, is the sequence.
    two = f"tagged as (select event_id as read_id, concat(substr(s, 1, 8), substr(m, 1, 8)) as tag, concat(substr(s, 9), substr(m, 9)) as seq, length(s) - 8 as brk from (select event_id, {_tagged('varchar')} as s, {_mate('varchar')} as m from {_SQL_EVENTS}))"
    umi_two = _with(two, tag_reads, _SQL_UNIQ, _sql_pairs(2), _sql_edges(3.0), _SQL_DIRECT, _SQL_CHAIN, _SQL_MP, assigned)
    breaks = "select canonical, arg_min(brk, read_id) as brk from assigned group by canonical"
    return {
        "normalize_reads": _with(reads) + "select read_id, seq, length(seq) as len from reads",
        "dedup_counts": base + "select seq, cnt, first_read_id from uniq",
        "dedup_ids": base + "select seq, array_to_string(ids, ',') as read_ids from uniq",
        "first_info": base + "select seq, header from uniq",
        "ranked_order": base + "select uid, seq, length(seq) as len from uniq",
        "length_hist": "select length(p_name) as len, count(distinct p_name) as n from part where p_name is not null group by len",
        "auto_distance": base + ", h as (select length(key) as len, count(*) as n from uniq group by len), m as (select min(len) as median from (select len, sum(n) over (order by len) as upto, sum(n) over () as total from h) where upto >= total // 2) select median, case when median > 160 then 8 else 2 + median // 30 end as distance from m",
        "pairs_d1": _with(reads, _SQL_UNIQ, _sql_pairs(1)) + pair,
        "pairs_d2": _with(reads, _SQL_UNIQ, _sql_pairs(2)) + pair,
        "pairs_d3": _with(reads, _SQL_UNIQ, _sql_pairs(3)) + pair,
        "pairs_parts_text": _with("reads as (select p_partkey as read_id, p_name as seq, null as mate, null as header, 1::bigint as n from part where p_name is not null)", _SQL_UNIQ, _sql_pairs(3, wildcard="")) + pair,
        "pairs_two_table": _with(reads, _SQL_UNIQ, f"users as (select distinct user_id, {_code('cast(floor(user_id / 4) as int)', 1, 20, 'varchar')} as code from {_SQL_EVENTS})") + "select user_id, seq, levenshtein(code, seq)::bigint as dist from users, uniq where levenshtein(code, seq) <= 2",
        "paired_pairs": paired + pair,
        "paired_distance": f"select event_id, case when d <= 8 then d else -1 end::bigint as dist from (select event_id, levenshtein({_plain('varchar')}, {_code('user_id', 1, 20, 'varchar')}) + levenshtein({_mate('varchar')}, {_code('user_id', 12, 18, 'varchar')}) as d from {_SQL_EVENTS})",
        "mp_edges": _with(reads, _SQL_UNIQ, _sql_pairs(2), _sql_edges(5.0)) + named.format(t="edges"),
        "mp_direct_parents": _with(reads, _SQL_UNIQ, _sql_pairs(2), _sql_edges(2.0), _SQL_DIRECT) + named.format(t="direct"),
        "neighbor_weight": _with(reads, _SQL_UNIQ, _sql_pairs(2), _SQL_BOTH) + "select key as seq, sum(b.cnt)::bigint as weight, count(*) as degree from both_ways b join uniq on uid = a group by key",
        "cc_labels": _with(reads, _SQL_UNIQ, _sql_pairs(2), _SQL_BOTH, _SQL_REACH, _SQL_LABEL) + "select x.key as seq, y.key as label from label join uniq x on x.uid = node join uniq y on y.uid = component where node in (select a from both_ways)",
        "mp_clusters": mp + sizes,
        "mp_lists": mp + f"select canonical, members, read_ids from ({lists})",
        "mp_tidy": mp + tidy,
        "mp_nonredundant": mp + f"select s.canonical, s.size, u.header from ({sizes}) s join uniq u on u.name = s.canonical",
        "mp_paired": paired_mp + sizes,
        "sphere_clusters": sphere + sizes,
        "sphere_tidy": sphere + tidy,
        "cc_clusters": cc + sizes,
        "umi_clusters": umi + umi_groups,
        "umi_paired": umi_two + f"select concat(substr(tag, 1, 8), substr(a.canonical, 1, b.brk), '/', substr(tag, 9), substr(a.canonical, b.brk + 1)) as canonical, count(*) as size from assigned a join ({breaks}) b on b.canonical = a.canonical group by tag, a.canonical, b.brk",
        "layout_clusters": mp + layout(lists, "canonical", "size"),
        "layout_members": sphere + layout(lists, "canonical", "size", "members"),
        "layout_ids": cc + layout(lists, "canonical", "size", "read_ids"),
        "layout_members_ids": mp + layout(lists, "canonical", "size", "members", "read_ids"),
        "layout_tidy": mp + layout(tidy, "seq", "canonical", order="read_id"),
        "layout_unique_raw": mp + unique("canonical"),
        "layout_unique_fasta": mp + unique("header", "canonical"),
        "layout_unique_fastq": sphere + unique("header", "canonical", "'+'", "'I'"),
        "layout_tags": umi + layout(umi_groups, "canonical", "size"),
        "raw_round_trip": _with(_sql_reads(_plain("varchar"))) + f"select {ordered} as read_id, seq, read_id as cnt, null as header from reads",
        "fasta_round_trip": _with(_sql_reads(_plain("varchar"))) + f"select {ordered} as read_id, seq, 1::bigint as cnt, concat('>', read_id, ' ', header) as header from reads",
        "fastq_round_trip": _with(_sql_reads(_plain("varchar"))) + f"select {ordered} as read_id, seq, 1::bigint as cnt, concat('@', read_id, ' ', header) as header from reads",
        "paired_files": _with(mates) + f"select {ordered} as read_id, seq, mate as seq2, concat('@', read_id) as header2 from reads",
        "stream_collapse": base + "select seq, count(*) as cnt, min(read_id) as first_read_id from reads group by seq",
    }
