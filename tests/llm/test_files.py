"""Token files, web archives and SentencePiece against their libraries."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from seqbraid.llm import sentencepieces as sp, token_files as tf, warc
from seqbraid.llm.registry import BYTE_BPE, PIECE_BPE
from seqbraid.plans.shared import new_path

BPE, PIECES = BYTE_BPE, PIECE_BPE
ODD = ["a  b c\n d", " x", " ", "", "a \n b", "x  y", "it's 'tis don't x's.", 'Àé. ñ² x_y __ "q" é!é 日本 x。', "<|endoftext|> a <|endoftext|>", "a b   c", "   ", "a   "]


def test_token_digests(docs, corpus, no_docs):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(BPE), 0, []
    for doc, text, _ in sorted(corpus, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, tf.round_trip(docs, BPE).collect()))
    assert got == want
    assert tf.round_trip(no_docs, BPE).count() == 0


def test_rows_without_an_id_come_first(spark):
    rows = [(5, "five"), (None, "none at all"), (2, "two words"), (None, None), (5, "five"), (-3, "minus")]
    got = sorted(map(tuple, tf.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -3, 2, 5, 5] and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    manifest = tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "t"), BPE).collect()
    held = tf.TokenFile(manifest[0]["file"])
    assert held.nameless == 2 and len(held.document(5)) == 2 and held.document(0) == [] and len(held.document(-3)) == 1


def test_many_files_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(tf, "MOST_FILES", 7)
    df = spark.range(3000).selectExpr("(id * 7919) % 3001 as doc_id", "repeat('a ', cast(id % 5 as int)) as text")
    manifest = sorted(tf.write_tokens(df, new_path(spark, "t"), BPE, rows_per_file=10).collect())
    ids = [i for r in manifest for i in tf.TokenFile(r["file"]).ids.tolist()]
    assert 5 <= len(manifest) <= 7 and ids == sorted(ids) and len(ids) == 3000
    assert max(r["n_docs"] for r in manifest) < 3 * 3000 / 7


def test_workers_remember_short_parts_only(corpus):
    e = tf.Encoder(BPE)
    e.encode(["日本語" * 400 + " " + "日本" * 300, "x" * 100 + " y " + "z" * 100] + [t or "" for _, t, _ in corpus])
    assert max(map(len, [*e.later, *e.whole])) <= tf.LONGEST


def test_encoder_equals_the_library(corpus):
    e = tf.Encoder(BPE)
    texts = ODD + [t or "" for _, t, _ in corpus]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_before_line_breaks_are_encoded_once(monkeypatch):
    """What follows a word's letters is a text of its own; only other parts are split by the tokenizer."""
    rng, e, split = random.Random(5), tf.Encoder(BPE), []
    joined = tf.Encoder._joined
    monkeypatch.setattr(tf.Encoder, "_joined", lambda self, parts, letters=False: split.extend([] if letters else parts) or joined(self, parts, letters))
    words = ["alpha", "Ünten", "a", "don", "I", "日本", "x" * 50, "été"]
    ends = [".\nOne", "\n\nTwo", "'s", "'t\n", "12", "\t\t9", "<|endoftext|>b", "%\r\nÀ", "_c", "\n日", "\u0301z", "µ", "-\n\x1cQ", ",", "", "." * 60]
    texts = [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(30)) for _ in range(200)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert split and all(x.startswith("日") or x.endswith(("\u0301z", "µ")) for x in split)
    assert max(map(len, [*e.later, *e.whole])) <= tf.LONGEST


def test_random_access_and_damage(spark, tmp_path):
    rows = [(i * 3, " ".join(f"w{i * j}" for j in range(i % 40))) for i in range(200)]
    manifest = tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "t"), BPE, rows_per_file=64).collect()
    assert len(manifest) > 1 and sum(r["n_docs"] for r in manifest) == 200
    e, seen = tf.Encoder(BPE), []
    for r in sorted(manifest):
        held = tf.TokenFile(r["file"])
        seen += held.ids.tolist()
        doc = int(held.ids[-1])
        assert held.document(doc)[0].tolist() == np.frombuffer(e.encode([dict(rows)[doc]])[0], "<u4").tolist() + [2]
        assert held.document(doc + 1) == []
    assert seen == [i for i, _ in rows]
    path = manifest[0]["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 20] ^= 0xFF
    (tmp_path / "bad.zst").write_bytes(data)
    held = tf.TokenFile(str(tmp_path / "bad.zst"))
    with pytest.raises(Exception):
        for i in range(len(held.ids)):
            held.tokens(i)


def test_archives(spark):
    pages = [(i, f"http://x/{i}\n", None if i % 7 == 0 else f"<p>{i % 4}</p>\r\n\r\nü" * (i % 3)) for i in range(40)]
    rows = [(*p, "x") for p in pages] + [(5, None, pages[5][2], "x"), (5, "u", "other", "x"), (None, "u", "x", "x"), (None, "u", "x", "y"), (None, None, pages[5][2], "x"), (77, "long", "é" * 3_000_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    held = [(p, (h or "").encode()) for p, _, h, _ in rows]
    last = {}
    for p, h in held:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    want = [(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] in (-1, p) else "revisit", None if last[h] in (-1, p) else last[h]) for p, h in held]
    got = [tuple(r) for r in warc.deduplicated(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.deduplicated(df.limit(0)).count() == 0
    big = warc.deduplicated(df, min_bytes=1000)
    assert {r["record_type"] for r in big.collect()} == {"response"}


def test_archives_sql(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (3, None), (4, "")]
    con.executemany("insert into pages values (?, ?)", rows)
    df = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    assert sorted(map(repr, con.execute(warc.deduplicated_sql()).fetchall())) == sorted(repr(tuple(r)) for r in warc.deduplicated(df).collect())


def test_archive_is_standard(spark):
    import gzip

    manifest = warc.write_archives(spark.createDataFrame([(1, "http://a", "<p>"), (2, "http://b", "<p>")], "page_id long, url string, html string"), new_path(spark, "w"))
    data = b"".join(gzip.decompress(open(r["file"].removeprefix("file://"), "rb").read()) for r in manifest.collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"WARC-Type: revisit") == 1 and data.count(b"\r\n\r\n<p>") == 1


def test_pieces_equal_the_library(docs, corpus, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [t or "" for _, t, _ in corpus if len(t or "") < 100_000]
    model, merging = sp.Pieces(PIECES), sp.Pieces(PIECES, merge=True)
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x, _ in merging.encode(texts)] == library.encode(texts)
    assert [model.decode(x) for x, _ in model.encode(texts)] == [model.decode(x) for x, _ in merging.encode(texts)] == texts
    found = sp.encode(docs, PIECES)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(corpus) and by_id[100]["ids"] == [] and all(r["round_trip"] for r in by_id.values())
    merged = sp.encode(docs, PIECES, merge=True)
    assert all(r["ids"] == library.encode(dict((i, t) for i, t, _ in corpus)[r["doc_id"]] or "") for r in merged.collect())
    for some in (found, merged):
        back = {r["doc_id"]: r["text"] for r in sp.decode(some, PIECES).collect()}
        assert all(back[i] == (t or "") for i, t, _ in corpus)
    assert sp.decode(found.selectExpr("doc_id", "cast(null as array<int>) as ids"), PIECES).where("text is null").count() == len(corpus)
    assert sp.encode(no_docs, PIECES).count() == 0


def test_viterbi_equals_brute_force():
    rng = random.Random(1)
    letters = "ab" + sp.MARK
    pieces = [(a, -rng.random() * 9) for a in letters] + [("".join(rng.choice("ab") for _ in range(rng.randint(2, 4))), -rng.random() * 9) for _ in range(12)] + [(sp.MARK + "a", -1.0), (sp.MARK + sp.MARK, -3.0)]
    pieces = list(dict(pieces).items()) + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    model = sp.Pieces(pieces=pieces)
    score = {p: s for p, s in pieces if not p.startswith("<0x")}

    def best(text):
        if not text:
            return 0.0
        return max([(score[text[:n]] if text[:n] in score else model.unknown) + best(text[n:]) for n in range(1, min(len(text), 4) + 1) if n == 1 or text[:n] in score])

    for _ in range(60):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
        ids, total = model.encode([text])[0]
        assert abs(total - best(sp.MARK + text.replace(" ", sp.MARK))) < 1e-9
        assert model.decode(ids) == text


def test_merging_order_equals_plain_merging():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
    pieces = [(c, -100.0) for c in "abc" + sp.MARK] + [(w, -float(i)) for i, w in enumerate(sorted(words, key=lambda w: (len(w), w)))]
    model = sp.Pieces(pieces=pieces, bpe=True, merge=True)
    ids = {p: i for i, (p, _) in enumerate(pieces)}
    texts = sorted({sp.MARK + "".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(300)})
    for word, got, _ in model.encode_words(texts):
        assert got.tolist() == [ids[p] for p in model.merged(word)]


def test_viterbi_of_the_public_model_equals_brute_force(corpus):
    """The best sum of scores over all segmentations, for real words one after another and far apart in the trie."""
    model = sp.Pieces(PIECES)
    words = sorted({sp.MARK + w for _, t, _ in corpus for w in (t or "").split() if len(w) < 12} | {sp.MARK + w for w in ("internationalisation", "🤦🏼", "aaaaaaa", "<0x41>")})

    def best(text):
        high = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in model.score or i == j - 1:
                    high[j] = max(high[j], high[i] + (model.score[text[i:j]][0] if text[i:j] in model.score else model.unknown))
        return high[-1]

    for word, ids, total in model.encode_words(words):
        assert abs(total - best(word)) < 1e-6 and model.decode(ids) == word[1:]


def test_a_prefix_without_a_last_piece_is_merged_by_itself(monkeypatch):
    pieces = [(c, -100.0) for c in "abc" + sp.MARK] + [("ab", -1.0), ("bc", -2.0), ("abc", -3.0)]
    model = sp.Pieces(pieces=pieces, bpe=True, merge=True)
    monkeypatch.setattr(model, "_stay", lambda before, after: False)
    for word, got, _ in model.encode_words(sorted(sp.MARK + w for w in ("abcab", "abc", "bca", "c"))):
        assert got == model._ids(model.merged(word))[0]
