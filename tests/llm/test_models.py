"""Rules, language, lattice, factorisation machine and decontamination."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqbraid.llm import decontaminate as dc, language_id as lid, lm_scoring as lm, quality_fm as fm, quality_rules as qr, registry, textkit, textstats
from seqbraid.llm.registry import PIECE_BPE as PIECES
from seqbraid.llm.sentencepieces import MARK, Pieces
from tests.llm.conftest import WORDS, sentence
from tests.llm.test_near_dedup import brute_force as near_brute_force


def crc(i):
    return zlib.crc32(str(i).encode())


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_counts_equal_brute_force(corpus):
    rng = random.Random(3)
    texts = [t for _, t, _ in corpus if len(t or "") < 50_000] + ["".join(rng.choice("ab #\n\t|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert textstats.counts(text or "")[0] == brute_counts(text)


def test_distinct_words_of_the_whole_text():
    rng = random.Random(8)
    at = textstats.RATIOS.index("distinct")
    rich, poor = [f"w{i}" for i in range(2000)], [rng.choice("abcdefghijklmnopqrst") for _ in range(2000)]
    value = lambda words: textstats.counts(" ".join(words))[1][at]
    assert value(rich) == value(rich[:200]) == value(rich[:1001]) == 1
    assert value(rich[:200] + poor) < 0.25 and value(poor[:200] + rich) > 0.85
    assert value(rich[:200] + poor[:100]) < value(rich[:200])
    assert math.isclose(value(["a"] * 250), 1 / 200) and value([]) == 0 and value(["a", "b", "a"]) == 2 / 3


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(rng, "en", rng.randint(60, 120))
        if bad:
            text = [" ".join(f"{w}$$#" for w in text.split()), text.upper().replace(" ", "!! "), " ".join(["buy"] * 90)][i % 3]
        rows.append((i, text, "en", 1))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (7, None, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_keep_good_and_drop_bad(spark, docs, corpus, no_docs):
    good, labels = labelled(spark)
    got = {r["doc_id"]: r for r in qr.judge(good, labels).collect()}
    assert len(got) == 400
    assert sum(got[i]["kept"] for i in got if i % 4) / 300 > 0.97
    assert sum(got[i]["kept"] for i in got if i % 4 == 0) / 100 < 0.1
    odd = qr.judge(docs, labels.limit(0)).collect()
    assert len(odd) == len(corpus)
    for r in odd:
        n, chars, symbols, dup, repeats = brute_counts(dict((i, t) for i, t, _ in corpus)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and r["kept"] == (not r["base_failed"])
    assert qr.judge(no_docs, labels).count() == 0


def slow_length(tree, point):
    """Of a tree in nested tuples (feature, cut, left, right), or a leaf's length."""
    while isinstance(tree, tuple):
        tree = tree[2] if point[tree[0]] < tree[1] else tree[3]
    return tree


def test_path_lengths_and_limit_equal_brute_force():
    rng = np.random.default_rng(2)
    good = rng.normal(0, 1, (500, 4))
    points = np.concatenate([good, rng.normal(0, 1, (40, 4)) + [9, 0, 0, 0], [[0, 0, 0, 0], [1e9, -1e9, 0, 0]]])
    low, high = points[:-1].min(axis=0), points[:-1].max(axis=0)
    forest = qr.Forest(good, low, high, trees=30, sample=64)

    def nested(n):
        return (forest.feature[n], forest.at[n], nested(forest.left[n]), nested(forest.right[n])) if forest.left[n] >= 0 else forest.length[n]

    def sizes(n, depth):
        """Each leaf's length is its depth and what its points would still need; all points are in some leaf."""
        if forest.left[n] >= 0:
            return sizes(forest.left[n], depth + 1) + sizes(forest.right[n], depth + 1)
        held = next(k for k in range(65) if math.isclose(forest.length[n], depth + float(qr._expected(k))) and (k <= 1 or depth == forest.depth))
        return max(held, 0)

    trees = [nested(r) for r in forest.roots]
    want = [sum(slow_length(t, p) for t in trees) / 30 for p in points]
    assert np.allclose(forest.lengths(points), want) and np.allclose(forest.score(points), 2 ** (-np.array(want) / float(qr._expected(64))))
    assert all(sizes(r, 0) <= 64 for r in forest.roots)
    assert forest.score(points[500:540]).min() > np.quantile(forest.score(good), 0.9)
    scores, labels = np.round(rng.random(300), 2), rng.random(300) < 0.6
    best = max((np.mean(scores[labels] <= c) - np.mean(scores[~labels] <= c), -c) for c in scores if np.mean(scores[labels] <= c) >= 0.9)
    cut = qr.limit(scores, labels, 0.9)
    assert math.isclose(np.mean(scores[labels] <= cut) - np.mean(scores[~labels] <= cut), best[0]) and np.mean(scores[labels] <= cut) >= 0.9


def test_verdicts_equal_the_forest_by_hand(spark):
    good, labels = labelled(spark)
    rows = sorted(good.selectExpr("pmod(xxhash64(doc_id), 1099511627776) as h", "doc_id", "text").collect())
    points = {r["doc_id"]: textstats.counts(r["text"])[1] for r in rows}
    # Document 7 has the labels 1 and null, of which the null isn't used.
    table, fine = np.array(list(points.values())), np.array([r["doc_id"] % 4 > 0 for r in rows])
    forest = qr.Forest(table[fine], table.min(axis=0), table.max(axis=0))
    most = qr.limit(forest.score(table), fine)
    for r in qr.judge(good, labels).collect():
        score = forest.score(np.array([points[r["doc_id"]]]))[0]
        assert math.isclose(r["anomaly"], score) and r["kept"] == (not r["base_failed"] and score <= most)


def test_every_labelled_row_counts(spark):
    """The bad rows have the greatest id hashes, after 21,000 labels of good ones."""
    rng = random.Random(12)
    by_hash = [r["id"] for r in sorted(spark.range(80).selectExpr("pmod(xxhash64(id), 1099511627776) as h", "id").collect())]
    bad = set(by_hash[70:])
    rows = [(i, sentence(rng, "en", rng.randint(60, 120)).replace(" ", "$$# " if i in bad else " ")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(80) for _ in range(300)], "doc_id long, quality int").repartition(7)
    got = {r["doc_id"]: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert not any(r["base_failed"] for r in got.values()) and {i for i in got if not got[i]["kept"]} == bad
    table, fine = np.repeat(np.array([textstats.counts(t)[1] for _, t in rows]), 300, axis=0), np.repeat([i not in bad for i, _ in rows], 300)
    forest = qr.Forest(table[fine], table.min(axis=0), table.max(axis=0))
    assert forest.cells(table[fine]).sum(axis=1).tolist() == [21_000] * qr.TREES
    score = forest.score(table)
    most = qr.limit(score, fine)
    assert [got[i]["anomaly"] for i in range(80)] == score[::300].tolist()
    assert all(got[i]["kept"] == (score[300 * i] <= most) for i in got)


def test_language(spark, docs, corpus, no_docs):
    rng = random.Random(6)
    rows = [(i, sentence(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(rng.choice(sorted(WORDS)) for _ in range(300))]
    got = lid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _, _ in rows if crc(i) % 3 == 1}
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in lid.identify(docs).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["rejected"] for i in (100, 101, 102, 110))
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[106]["lang_pred"] == "en"
    kept = lid.keep_identified(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert lid.identify(no_docs).count() == 0 and lid.keep_identified(no_docs).count() == 0


def test_language_equals_compression_by_hand(spark):
    """Every size, choice, score and margin from one compressor call a block, without the operator's classifier."""
    import zstandard

    rng = random.Random(26)
    rows = [(i, sentence(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(rng.choice(sorted(WORDS)) for _ in range(120))] + [(500, sentence(rng, "de", 6000), "de"), (501, "12", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {i for i, _, _ in rows if crc(i) % 3 == 1}
    content = lid.learn(df.where(~df["doc_id"].isin(out)), "doc_id", "text", "lang")
    for r in lid.identify(df).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        data, sizes = lid.letters(text), {}
        for lang, held in content.items():
            params = zstandard.ZstdCompressionParameters.from_level(lid.LEVEL, source_size=lid.BLOCK, dict_size=len(held), write_content_size=False, write_checksum=False)
            packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(packer.compress(data[i : i + lid.BLOCK])) for i in range(0, len(data), lid.BLOCK))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert r["lang_pred"] == first[0] and math.isclose(r["margin"], (second[1] - first[1]) / first[1])
        assert math.isclose(r["score"], 1 / sum(math.exp(-lid.BYTE_WEIGHT * (x - first[1])) for x in sizes.values()))
        assert r["held_out"] == (r["doc_id"] in out) and r["rejected"] == (r["margin"] < lid.MIN_MARGIN)


def test_language_learns_only_from_its_rows(spark):
    rows = [(i, "alpha beta gamma delta", "xx") for i in range(60) if crc(i) % 3 == 1] + [(i, "epsilon zeta eta theta", "yy") for i in range(60) if crc(i) % 3 != 1]
    got = lid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"yy"}


def test_language_learns_from_anywhere_in_its_texts(spark):
    rng = random.Random(16)
    head = " ".join(f"header{i}" for i in range(900))
    rows = [(i, f"{head} {sentence(rng, 'de', 4000)}", "de") for i in range(40)] + [(100 + i, "1234 ... " * 800 + sentence(rng, "fr", 200), "fr") for i in range(40)]
    rows += [(200 + i, "12 !", "en") for i in range(3000)] + [(4000, sentence(rng, "en", 50), "en")]
    content = lid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert sorted(content) == ["de", "en", "fr"]
    assert content["de"].count(b" nicht ") > 20 and content["fr"].count(b" dans ") > 20


def test_lattice_sums_all_segmentations():
    pieces, logs = ["a", "b", "ab", "aba", "▁", "▁a", "", ""], np.log10([0.2, 0.1, 0.15, 0.05, 0.2, 0.1, 0.1, 0.1])
    byte_pieces = {b: 6 for b in range(256)}
    lattice = lm.Lattice(pieces, byte_pieces, logs)
    value = dict(zip(pieces[:6], 10**logs, strict=False))

    def total(text):
        if not text:
            return 1.0
        out = sum(value.get(text[:n], 0) * total(text[n:]) for n in range(1, min(3, len(text)) + 1))
        return out if text[0] in value else 0.1 ** len(text[0].encode()) * total(text[1:]) + out

    words = ["▁" + "".join(w) for n in range(5) for w in itertools.product("abé", repeat=n)]
    got = lattice.forward(words)
    assert np.allclose(got, [math.log10(total(w)) for w in words])
    for i in (0, 7, len(words) - 1):
        assert math.isclose(lattice._forward_one(words[i]) / math.log(10), got[i], rel_tol=1e-9)
    no_bytes = lm.Lattice(pieces, {}, logs)
    assert math.isclose(no_bytes.forward(["é"])[0], math.log10(0.05) - lm.UNKNOWN_LOG)
    assert sorted(i for g in lattice.batches(words + ["▁" + "a" * 300]) for i in g) == list(range(len(words) + 1))


def test_scores_of_texts(spark, docs, corpus, no_docs):
    rows = lm.score_texts(docs, PIECES, block_bytes=50_000).collect()
    train = Counter(w for i, t, _ in corpus if crc(i) % 7 != 2 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    texts = dict((i, t) for i, t, _ in corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        words = [*(texts[r["doc_id"]] or "").encode().lower().split(), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(w in train for w in words), n, crc(r["doc_id"]) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    # The marginal of the whole text by plain recursion over the vocabulary's scores.
    model = Pieces(PIECES)
    value = {p: 1 / (3 - model.scores[i]) for p, (_, i) in model.score.items() if model.scores[i] > -1e8}
    end, rest = train[b""] / (n + 1), min(value.values())
    scale = (1 - end) / (sum(value.values()) + rest * len(model.bytes))

    def slow(word):
        high = [1.0]
        for j in range(1, len(word) + 1):
            high.append(sum(high[i] * value.get(word[i:j], (rest * scale) ** len(word[i:j].encode()) / scale if j == i + 1 else 0) * scale for i in range(max(0, j - 20), j)))
        return math.log10(high[-1])

    for r in rows:
        if r["doc_id"] not in (106, 107):
            words = (texts[r["doc_id"]] or "").encode().lower().split()
            assert math.isclose(r["score"], sum(slow(MARK + w.decode()) for w in words) + math.log10(end), rel_tol=1e-9)
    by_text = {}
    for r in rows:
        assert r["score"] < 0 and math.isfinite(r["score"])
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(round(r["score"], 6))
    assert all(len(x) == 1 for x in by_text.values())
    assert lm.score_texts(no_docs, PIECES).count() == 0


def test_learned_scores_are_of_the_training_words_and_the_refitted_lattice(spark, docs, corpus):
    train = Counter(w for i, t, _ in corpus if crc(i) % 7 != 2 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    pieces, byte_pieces, logs = lm.weights(PIECES, train[b""] / (n + 1))
    lattice = lm.Lattice(pieces, byte_pieces, logs)
    # Expected uses: how far a word's log sum moves as a piece's log weight does.
    words, step = ["▁" + w for w in ("the", "habenxé", "日")], 1e-5
    used = sum(lattice.expected([w]) for w in words)
    assert np.allclose(used, sum(lattice._expected_one(w) for w in words))
    for i in [*np.flatnonzero(used)[:40], 5000]:
        moved = logs.copy()
        moved[i] += step
        other = lm.Lattice(pieces, byte_pieces, moved)
        assert math.isclose(used[i], sum(float(other.forward([w])[0] - lattice.forward([w])[0]) for w in words) / step, rel_tol=1e-3, abs_tol=1e-4)
    fitted = lm.refitted(logs, sum(lattice.expected(["▁" + w.decode()]) for w in train if w))
    assert math.isclose((10**fitted).sum(), 1, rel_tol=1e-9) and fitted[-1] == logs[-1]
    prior = lm.Lattice(pieces, byte_pieces, fitted)
    texts, held = dict((i, t) for i, t, _ in corpus), []
    for r in lm.score_texts(docs, PIECES, block_bytes=50_000, learned=True).collect():
        assert math.isfinite(r["score"])
        if r["doc_id"] not in (106, 107):
            low = [float(prior.forward(["▁" + w.decode()])[0]) for w in (texts[r["doc_id"]] or "").encode().lower().split()] + [float(fitted[-1])]
            words = [*(texts[r["doc_id"]] or "").encode().lower().split(), b""]
            by_hand = sum(math.log10((train[w] + v * 10**x) / (n + v)) for w, x in zip(words, low, strict=True))
            assert math.isclose(r["score"], by_hand, rel_tol=1e-9)
        held += [(r["score"], r["base_score"])] * r["held_out"]
    assert sum(s for s, _ in held) > 1.25 * sum(b for _, b in held)


def test_the_query_scores_held_out_rows_about_as_well_as_the_base(spark):
    rows = registry.op6_lm_scoring(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in rows)
    assert sum(r["score"] for r in rows) > 1.5 * sum(r["base_score"] for r in rows)


def test_scores_of_rows_without_an_id_or_with_another_type(spark):
    df = spark.createDataFrame([("x", "one two"), (None, "one two"), (None, "one two"), ("x", None)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in lm.score_texts(df, PIECES).collect())
    assert [x[:3] for x in got] == [("", 3, 3), ("", 3, 3), ("x", 1, 1), ("x", 3, 3)] and got[0][3] == got[1][3] == got[3][3]
    assert crc("x") % 7 != 2


def test_machine_in_linear_time_equals_all_pairs():
    rng = np.random.default_rng(1)
    machine = fm.Machine()
    machine.weight = rng.normal(size=fm.FEATURES)
    ids, x = np.array([3, 9, 70, 4100]), rng.random(4)
    pair = sum(machine.vectors[i] @ machine.vectors[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(ids, x, strict=True), 2))
    assert math.isclose(machine.raw(np.zeros(4, int), ids, x, 1)[0], machine.weight[ids] @ x + pair, rel_tol=1e-9)


def test_scores_equal_the_machine_by_hand(spark):
    """Held-out texts by all pairs of their features, with the weights that the learned rows give."""
    good, labels = labelled(spark)
    good = good.selectExpr("*", "length(text) as n_chars")
    texts = {r["doc_id"]: (r["text"], float(r["n_chars"])) for r in good.collect()}
    of = lambda i: fm.features(pa.array([texts[i][0]]), pa.array([texts[i][1]]))
    learned = [(int(i % 4 > 0), *(x.astype(t).tobytes() for x, t in zip(of(i)[1:], ("<i4", "<f4"), strict=True))) for i in texts if crc(i) % 5]
    learned.sort()
    machine = fm.Machine().fit([(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4").astype(float)) for _, a, b in learned], np.array([q for q, _, _ in learned], float))
    got = {r["doc_id"]: r["score"] for r in fm.score_quality(good, labels).collect()}
    for i in list(texts)[:40]:
        _, ids, x = of(i)
        pair = sum(machine.vectors[a] @ machine.vectors[b] * u * v for (a, u), (b, v) in itertools.combinations(zip(ids, x, strict=True), 2))
        raw = machine.bias + machine.weight[ids] @ x + pair + math.log(fm.CUT / (1 - fm.CUT))
        assert math.isclose(got[i], 1 / (1 + math.exp(-raw)), rel_tol=1e-7)


def test_stated_lengths_are_a_feature_of_their_own():
    at = lambda n: fm.features(pa.array(["one"]), pa.array([n], pa.float64()))[1][-1] - fm._FIRST_STATED
    assert [at(n) for n in (0, 1, 1000, 1e30, None, -5)] == [0, 1, 9, fm.LENGTH_BINS - 1, fm.LENGTH_BINS, fm.LENGTH_BINS]
    assert fm.features(pa.array([None, ""]), pa.array([None, None], pa.float64()))[1].max() < fm.FEATURES


def test_quality_scores(spark, docs, corpus, no_docs):
    good, labels = labelled(spark)
    got = {r["doc_id"]: r for r in fm.score_quality(good, labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if crc(i) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.95
    odd = fm.score_quality(docs, labels.limit(0)).collect()
    assert len(odd) == len(corpus) and {r["score"] for r in odd} == {0.5}
    mixed = fm.score_quality(docs, labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in mixed)
    assert fm.score_quality(no_docs, labels).count() == 0


def slow_align(item, text):
    best, before = 0, [0] * (len(text) + 1)
    for w in item:
        now = [0]
        for j, x in enumerate(text):
            now.append(max(0, before[j] + (dc.MATCH if w == x else dc.MISMATCH), before[j + 1] + dc.GAP, now[j] + dc.GAP))
        best, before = max(best, *now), now
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert dc.align(item, text)[0] == slow_align(item.tolist(), text.tolist())


def test_leaks(spark, docs, corpus, no_docs):
    rng = random.Random(12)
    fresh = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.choice('lmnr')}{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(fresh, n))) for i, n in enumerate([30, 30, 30, 12, 3, 1])] + [(90, None), (91, ""), (None, "x y z")]
    edited = items[1][1].split()
    for at in (5, 14, 22):
        edited[at] = "changed"
    del edited[18]
    half = items[2][1].split()[:15]
    texts = {
        1: f"Before it, {items[0][1].title()}. After it.",
        2: sentence(rng, "en", 500) + " " + " ".join(edited) + " " + sentence(rng, "en", 500),
        3: sentence(rng, "en", 40) + " " + " ".join(half),
        4: items[3][1] + "\n" + items[4][1],
        5: items[5][1],
        6: sentence(rng, "en", 300),
        7: None,
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 0), (1, 0), (2, 1), (4, 3), (4, 4), (5, 5)])
    got = dc.find_leaks(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert sorted(r["doc_id"] for r in dc.drop_leaks(df, bench).collect()) == [3, 6, 7]
    assert dc.find_leaks(docs, bench).count() == 0 and dc.drop_leaks(docs, bench).count() == len(corpus)
    assert dc.find_leaks(no_docs, bench).count() == 0 and dc.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_of_items_that_share_wording(spark):
    rng = random.Random(13)
    shared = [f"s{i}" for i in range(40)]
    items = [(i, " ".join([*shared[:20], f"only{i}", *shared[20:]])) for i in range(4)] + [(4, "five words of one item"), (5, "a b c d e f g h i j")]
    copy = items[2][1].split()
    copy[20] = "other"
    texts = [(0, " ".join([sentence(rng, "en", 50), *copy, sentence(rng, "en", 50)])), (1, "five words if one item"), (2, "a b c X e f g Y i j"), (3, " ".join(shared[:8]))]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (2, 5)]
    for parts in (1, 4):
        got = dc.find_leaks(df.repartition(parts), bench.repartition(parts)).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert [r["doc_id"] for r in dc.drop_leaks(df, bench).collect()] == [3]


def test_leaks_equal_alignment_with_every_item(spark):
    """Exhaustive: every text against every item, over a vocabulary so small that seeds are common."""
    rng = random.Random(14)
    words = WORDS["en"][:40]
    items = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(30)]
    texts = []
    for _ in range(150):
        copy = rng.choice(items).split()
        for _ in range(rng.randint(0, 1 + len(copy) // 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(rng.choices(words, k=5) + copy + rng.choices(words, k=5)))
    found = dc.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    table, index = dc.plain(pa.array(texts)), dc.plain(pa.array(items))
    for n, (a, b) in enumerate(zip(table.first, table.first[1:], strict=False)):
        for i, (c, d) in enumerate(zip(index.first, index.first[1:], strict=False)):
            item, text = index.hashes[c:d], table.hashes[a:b]
            share = dc.align(item, text)[0] / (dc.MATCH * len(item))
            whole = dc.window_words(len(item), dc.MIN_SHARE)
            windows = set(textkit.runs(item, whole).tolist()) & set(textkit.runs(text, whole).tolist())
            assert ((n, i) in got) == bool(share >= dc.MIN_SHARE and windows), (n, i)


def test_the_rarest_gram_of_each_window_is_a_seed(spark):
    rng = random.Random(17)
    grams, n = [], {}
    for item in range(12):
        size = [1, 2, 9, 30][item % 4]
        for place in range(size):
            gram = rng.randrange(40)
            n.setdefault(gram, rng.randrange(6))
            grams.append((bytearray([item]), gram, place, 3, 4 if item < 8 else 3))
    table = spark.createDataFrame(grams, "item binary, gram long, place long, k int, window int")
    counts = spark.createDataFrame([(g, c) for g, c in n.items() if c], "gram long, n long")
    got = {(r["item"][0], r["place"]) for r in dc.seeds(table, counts).collect()}
    want = set()
    for item in range(12):
        own = [(n[g], p) for i, g, p, _, _ in grams if i[0] == item]
        want |= {(item, p) for _, p in own} if item >= 8 else {(item, min(own[w : w + 2])[1]) for w in range(max(1, len(own) - 1))}
    assert got == want


def test_long_passages_are_leaks(spark):
    rng = random.Random(15)
    items = [(0, " ".join(f"a{i}" for i in range(59))), (1, " ".join(f"b{i}" for i in range(1000)))]
    a, b = items[0][1].split(), items[1][1].split()
    edited = [*b[100:120], "other", *b[121:137]]
    passages = {1: a[:40], 2: b[200:890], 3: a[9:41], 4: a[9:40], 5: edited, 6: edited[:-1], 7: [w for i, w in enumerate(b[:400]) if i % 5]}
    texts = [(i, " ".join([sentence(rng, "en", 60), *words, sentence(rng, "en", 60)])) for i, words in passages.items()]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(df, bench).collect()}
    assert sorted(got) == [(1, 0), (2, 1), (3, 0), (5, 1)]
    assert got[1, 0]["end_word"] == 100 and math.isclose(got[1, 0]["similarity"], 40 / 59) and got[2, 1]["item_words"] == 1000
    assert sorted(r["doc_id"] for r in dc.drop_leaks(df, bench).collect()) == [4, 6, 7]


def test_items_without_an_id_are_dropped_too(spark):
    df = spark.createDataFrame([(1, "here is one two three four five six"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three four five six"), (None, None)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.drop_leaks(df, bench).collect()) == [2, 3] and dc.find_leaks(df, bench).count() == 0


def test_word_tables(corpus):
    texts = ["a b", "", None, " c", "d", "e\x0bf g "] + [t for _, t, _ in corpus]
    table = textkit.words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        want = (text or "").encode().split()
        a, b = table.first[i], table.first[i + 1]
        assert [table.word(j) for j in range(a, b)] == want
        for j in range(a, b):
            assert seen.setdefault(table.word(j), table.hashes[j]) == table.hashes[j]
    assert len(set(map(int, seen.values()))) == len(seen)
    for limit in (1, 100, 10**9):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        assert [x for p in textkit.slices([batch], "text", limit) for x in p.column("text").to_pylist()] == texts


@pytest.mark.parametrize("drop", [False, True])
def test_pipeline_on_a_small_folder(spark, docs, corpus, tmp_path, drop):
    """Every stage acts, and the result is what the stages' rules say row by row."""
    import corpus_pipeline

    rng = random.Random(44)
    item, secret = " ".join(f"item{i}" for i in range(40)), "token=abcdefgh12345678"
    more = [(200, f"{sentence(rng, 'en', 60)} {item} {sentence(rng, 'en', 30)}", "en"), (201, f"{sentence(rng, 'de', 70)} {secret} {sentence(rng, 'de', 20)}", "de"), (202, f"{sentence(rng, 'fr', 50)} {secret}", "fr"), (203, "123 456", "fr")]
    rows = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    rows = rows.unionByName(spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in more], rows.schema))
    (rows.limit(0) if drop else rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this is in there at all"), (2, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    if drop:
        assert got == {}
        return
    known = {r["doc_id"] for r in lid.keep_identified(rows).collect()}
    texts = {i: t for i, t, _ in [*corpus, *more]}
    assert {100, 101, 102, 110, 203}.isdisjoint(known) and {200, 201, 202, 0, 106} <= known
    kept = {doc for doc, _, _, keep in near_brute_force([(i, texts[i]) for i in known], 5, 80, 100) if keep}
    assert set(got) == kept - {200} and {60, 72}.isdisjoint(got)
    pieces = Pieces(PIECES, merge=True)
    for i, r in got.items():
        clean = texts[i].replace(secret, "[SECRET]")
        assert r["round_trip"] and pieces.decode(r["ids"]) == clean
        assert r["ids"] == np.frombuffer(pieces.encode([clean])[0][0], np.uint32).tolist()
    assert sum("[SECRET]" in pieces.decode(r["ids"]) for r in got.values()) == 2
