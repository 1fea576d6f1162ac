import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from seqbraid.llm import near_dedup as nd


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute_force(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc)
    return sorted((doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, corpus, k, num):
    got = sorted(map(tuple, nd.near_duplicates(docs, k=k, num=num, den=100).collect()))
    assert got == brute_force([(i, t) for i, t, _ in corpus], k, num, 100)


@pytest.mark.parametrize(("key_chunk", "family_chunk", "leaders"), [(8, 5, (2, 16, 64)), (4, 3, (1, 2)), (6, 4, ())])
def test_large_groups_lose_no_link(spark, monkeypatch, key_chunk, family_chunk, leaders):
    """Near copies, chains of them that drift apart, and texts that share only half: groups far over a chunk."""
    monkeypatch.setattr(nd, "KEY_CHUNK", key_chunk)
    monkeypatch.setattr(nd, "FAMILY_CHUNK", family_chunk)
    monkeypatch.setattr(nd, "LEADERS", leaders)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    words = [f"c{i}" for i in range(80)]
    for i in range(80, 130):
        words = list(words)
        words[rng.randrange(80)] = f"d{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join([*base[:30], *(f"e{i % 12}_{j}" for j in range(30))])) for i in range(130, 170)]
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_force(rows, 3, 85, 100)


@pytest.mark.parametrize("kind", ["sketch", "set"])
def test_groups_of_any_size_are_joined_by_their_links(spark, monkeypatch, kind):
    """The links found join just those members that all links of the group join."""
    monkeypatch.setattr(nd, "LEADERS", (1, 3, 5))
    rng = np.random.default_rng(5)
    sets = []
    for n in (40, 25, 10, 1, 1, 1):
        centre = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        for _ in range(n):
            own = centre.copy()
            change = rng.integers(0, 60)
            own[rng.integers(0, 300, change)] = rng.integers(1, 1 << 62, change).astype(np.uint64)
            sets.append(np.unique(own))
    size = np.array([len(x) for x in sets])
    data = [nd.compress(nd.least(x)).tobytes() if kind == "sketch" else x.tobytes() for x in sets]
    group = nd.Sketched(size, data, 0.85) if kind == "sketch" else nd.Exact(size, data, 85, 100)
    maker, slack = (nd.partial(nd.Sketched, threshold=0.85), 3 * nd.spread(0.85)) if kind == "sketch" else (nd.partial(nd.Exact, num=85, den=100), 1e-9)
    want = {frozenset(t) for t in _trees(len(sets), [(i, j) for i in range(len(sets)) for j in np.flatnonzero(group.similarity(i, np.arange(len(sets)))[1])])}
    pairs = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(len(sets))] + [(3, 0)], "key long, rep long")
    rows = spark.createDataFrame([(i, int(n), bytearray(d)) for i, (n, d) in enumerate(zip(size, data, strict=True))], "rep long, size long, data binary")
    for chunk in (7, 20, 1000):
        found = nd.group_links(pairs, lambda reps: rows, chunk, maker, 0.15, slack).collect()
        assert {frozenset(t) for t in _trees(len(sets), [(r["a"], r["b"]) for r in found])} == want
    assert 3 < len(want) < len(sets)


def _trees(n, edges):
    label = list(range(n))
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    trees = defaultdict(list)
    for i, x in enumerate(label):
        trees[x].append(i)
    return trees.values()


def test_ids_null_or_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text, 1), ("a", text + " more", 2), (None, text, 3), (None, None, 4), ("c", "", 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _gone int")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=repr)
    assert got == sorted([("b", 38, "a", False), ("a", 39, "a", True), (None, 38, None, True), (None, 0, None, True), ("c", 0, "c", True)], key=repr)
    assert sorted(r["_gone"] for r in nd.drop_near_duplicates(df).collect()) == [2, 3, 4, 5]
    assert nd.drop_near_duplicates(df.withColumnRenamed("_gone", "kept")).columns == ["doc_id", "text", "kept"]


def test_sql_agrees(spark, corpus):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [(i, t) for i, t, _ in corpus if i != 109 and len(t or "") < 10_000] + [(None, corpus[0][1]), (None, None)]
    con.executemany("insert into documents values (?, ?)", rows)
    sql = con.execute(nd.near_duplicates_sql()).fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r)) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_drop_keeps_columns_and_one_of_each(docs, corpus, no_docs):
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, _, keep in brute_force([(i, t) for i, t, _ in corpus], 5, 80, 100) if keep}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert nd.near_duplicates(no_docs).count() == 0 and nd.drop_near_duplicates(no_docs).count() == 0


def test_estimate_and_banding():
    rng = np.random.default_rng(0)
    both = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    one = np.concatenate([both, rng.integers(1, 1 << 62, 300).astype(np.uint64)])
    two = np.concatenate([both, rng.integers(1, 1 << 62, 300).astype(np.uint64)])
    other = rng.integers(1, 1 << 62, 3300).astype(np.uint64)
    sketch = [nd.compress(nd.least(x)) for x in (one, two, other)]
    got = nd.estimate(sketch[0], np.array(sketch[1:]), 3300, np.array([3300, 3300]))
    assert abs(got[0] - 3000 / 3600) < 0.12 and got[1] < 0.05
    for t in (0.8, 0.85, 0.95):
        rows, bands = nd.banding(t)
        assert (1 - t**rows) ** bands <= nd.MISS and rows * bands <= nd.REGISTERS


def test_registers_hold_zeros_and_mantissa():
    low = np.array([1 << 62, (1 << 62) | (1 << 61), 1, 0xFFFFFFFFFFFFFFFF], np.uint64)
    assert nd.compress(low).tolist() == [0, 512, 62 << 10, 0xFFFF]
    assert 0xFFFF not in nd.densify(np.array([5] + [0xFFFF] * 127, np.uint16))
