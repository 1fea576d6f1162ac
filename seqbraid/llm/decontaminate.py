"""Benchmark decontamination: rare n-gram seeds join documents to test items, then local alignment.

Texts are compared as sequences of words: lower case, ASCII punctuation as space.

1. Every item gives its n-grams.  A bit map of their hashes, of bounded size, goes
   over the documents once and leaves the places that may hold one.
2. How often each n-gram occurs in all documents says how rare it is.  Of the
   n-grams in each window of an item the rarest is a seed.  A window is as long as
   the stretch that some edits must leave whole, so a copy that is similar enough
   holds a seed, however common the item's wording is.
3. Seeds and places are joined by hash; a place must match over a whole window.
4. Around its seeds a document is aligned with the item by Smith-Waterman, word by
   word, unless they have too few words in common; if the best local score reaches a
   share of what the whole item would give, the document holds the item, copied,
   edited or partly reworded.  So it does if it holds a long passage of it nearly
   word by word.

Documents and items go by the digest of their text.  A group of copies of any size
is one text from the join on, and neither table passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqbraid.llm import textkit
from seqbraid.plans.shared import bounded, materialize

#: Words of a window, and of a seed in it.
WINDOW_WORDS, SEED_WORDS = 4, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of the score that a full copy gives.  With a fifth of its words replaced an item keeps 0.7.
MIN_SHARE = 0.7
#: So many words of an item in a row also count as the item.  Around edits there must be PASSAGE_EDIT more for each edit.
PASSAGE_WORDS, PASSAGE_EDIT = 32, 4
#: Bits of the map of n-grams, as a power of two: 16 a gram within these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 16, 26

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def plain(column: pa.Array) -> textkit.Words:
    data, offsets = textkit.raw(pc.utf8_lower(column))
    flat = _TABLE[data]
    return textkit.words(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(flat)]))


def align(item: np.ndarray, text: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """Best local alignment score, and where in the text it ends.

    A gap costs the same for each word, so the best gap along the text is a running
    maximum of the scores, each raised by what the gap up to it would have cost.
    """
    before = np.zeros(len(text) + 1, np.int64)
    slope = -gap * np.arange(len(text) + 1)
    best, end = 0, 0
    for word in item:
        now = np.maximum(before + gap, 0)
        now[1:] = np.maximum(now[1:], before[:-1] + np.where(text == word, match, mismatch))
        now = np.maximum.accumulate(now + slope) - slope
        at = int(now.argmax())
        if now[at] > best:
            best, end = int(now[at]), at
        before = now
    return best, end


def window_words(n: int, min_share: float) -> int:
    """Words in a row that stay whole in an item of n words, WINDOW_WORDS at most.

    Each replaced or missing word costs 3 of 2 n points, so ``min_share`` bounds how
    many there are, and the longest run between them has at least so many words.
    """
    edits = int((1 - min_share) * MATCH * n / (MATCH - MISMATCH) + 1e-9)
    return max(1, min(WINDOW_WORDS, -(-(n - edits) // (edits + 1))))


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k-grams; grams of unlike lengths have unlike hashes."""
    return textkit.mix(textkit.runs(hashes, k) + np.uint64(k))


def _item_grams(min_share: float):
    """(item, gram, place, before, after, k, window) of the items' n-grams; before and after: the words beside, 1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, "text"):
            table = plain(part.column("text"))
            for i, (a, b) in enumerate(zip(table.first, table.first[1:], strict=False)):
                words = table.hashes[a:b]
                if not len(words):
                    continue
                window = window_words(len(words), min_share)
                k = min(SEED_WORDS, window)
                grams = _grams(words, k)
                edge = np.ones(1, np.uint64)
                before, after = np.concatenate([edge, words])[: len(grams)], np.concatenate([words[k:], edge])
                n = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(np.full(n, i))), *(pa.array(x.view(np.int64)) for x in (grams, np.arange(n), before, after)), pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, window), pa.int32())],
                    ["item", "gram", "place", "before", "after", "k", "window"],
                )

    return run


def _places(bits: np.ndarray, lengths: list[int]):
    """(fp, gram, at, before, after): where a text may hold one of the grams; 0 beside it for none."""
    mask = np.uint64(64 * len(bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, "text"):
            table = plain(part.column("text"))
            for k in lengths:
                grams = _grams(table.hashes, k)
                bit = grams & mask
                at = np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                text = np.searchsorted(table.first, at, "right") - 1
                inside = at + k <= table.first[text + 1]
                at, text = at[inside], text[inside]
                first, last = table.first[text], table.first[text + 1]
                before = np.where(at > first, table.hashes[at - 1], np.uint64(0))
                after = np.where(at + k < last, table.hashes[np.minimum(at + k, len(table.hashes) - 1)], np.uint64(0))
                yield pa.RecordBatch.from_arrays([part.column("fp").take(pa.array(text)), *(pa.array(x.view(np.int64)) for x in (grams[at], at - first, before, after))], ["fp", "gram", "at", "before", "after"])

    return run


def _bit_map(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' hashes; the driver sees this map, whose size is bounded, and no gram."""
    n = grams.count()
    power = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    bit = F.col("gram").bitwiseAND((1 << power) - 1)
    words = grams.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit"))
    out = np.zeros(1 << (power - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2 ** (MOST_BITS - 6) rows
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """The grams of which each is the rarest of a window, the first of equal ones; ``counts``: gram, n."""
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = Window.partitionBy("item").orderBy("place")
    rarer = (F.col("n") < F.lag("n").over(row)) | (F.col("n") <= F.lead("n").over(row))
    alone = F.lag("n").over(row).isNull() & F.lead("n").over(row).isNull()
    return known.withColumn("chosen", (F.col("window") == F.col("k")) | F.coalesce(rarer, F.lit(False)) | alone).where("chosen").drop("chosen", "n")


def _windows(begins: list[int], n: int) -> list[tuple[int, int, int]]:
    """(start, end, seeds) of the stretches of a text around places where the item would begin."""
    slack, out = max(4, n // 2), []
    for begin in begins:
        if out and begin - slack <= out[-1][1]:
            start, _, seen = out[-1]
            out[-1] = (start, begin + n + slack, seen + 1)
        else:
            out.append((begin - slack, begin + n + slack, 1))
    return out


def search(item: np.ndarray, text: np.ndarray, begins: list[int], min_share: float) -> tuple[float, int] | None:
    """(share, end word) of the item in the text, if it holds it; ``begins``: where its seeds say it starts.

    A passage of M matched words and E edits holds M - 3 (E + 1) windows of four
    words, and at least half as many seeds.
    """
    keys, times = np.unique(item, return_counts=True)
    best, passage = (0, 0), (0, 0)
    for start, end, seen in _windows(sorted(begins), len(item)):
        a, b = max(0, start), min(len(text), end)
        there = text[a:b]
        near = 0
        if len(item) >= PASSAGE_WORDS and 2 * seen > PASSAGE_WORDS - WINDOW_WORDS:
            near, stop = align(item, there, 1, -PASSAGE_EDIT, -PASSAGE_EDIT)
            passage = max(passage, (near, a + stop), key=lambda x: x[0])
        at = np.minimum(np.searchsorted(keys, there), len(keys) - 1)
        shared = np.minimum(np.bincount(at[keys[at] == there], minlength=len(keys)), times).sum()
        if near >= PASSAGE_WORDS or shared >= min_share * len(item) - 1e-9:
            score, stop = align(item, there)
            best = max(best, (score, a + stop), key=lambda x: x[0])
    share = best[0] / (MATCH * len(item))
    if share >= min_share:
        return share, best[1]
    return (share, passage[1]) if passage[0] >= PASSAGE_WORDS else None


def _align(min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, "text"):
            texts, items = plain(part.column("text")), plain(part.column("item_text"))
            out = []
            for i, begins in enumerate(part.column("begins").to_pylist()):
                item = items.hashes[items.first[i] : items.first[i + 1]]
                found = search(item, texts.hashes[texts.first[i] : texts.first[i + 1]], [x["begin"] for x in begins], min_share)
                if found:
                    out.append((i, *found, len(item)))
            rows, share, end, size = zip(*out, strict=True) if out else ((), (), (), ())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("fp").take(at), part.column("item").take(at), pa.array(share, pa.float64()), pa.array(end, pa.int64()), pa.array(size, pa.int64())], ["fp", "item", "similarity", "end_word", "item_words"])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def leaks(texts: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(fp, item, similarity, end_word, item_words): which text holds which item, both by the digest of their text.

    ``texts`` and ``items`` have a column text; repeated texts give one row.
    """
    own = texts.select(_digest(F.col("text")).alias("fp"), "text")
    tests = items.select(_digest(F.col("text")).alias("item"), F.col("text")).where("text is not null").dropDuplicates(["item"])
    grams = materialize(tests.mapInArrow(_item_grams(min_share), "item binary, gram long, place long, before long, after long, k int, window int"), "item_grams")
    lengths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most SEED_WORDS rows
    places = materialize(own.mapInArrow(_places(_bit_map(grams), lengths), "fp binary, gram long, at long, before long, after long"), "places")
    counts = places.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = materialize(seeds(grams, counts), "seeds")
    p, s = places.alias("p"), chosen.alias("s")
    whole = (F.col("s.window") == F.col("s.k")) | (F.col("p.before") == F.col("s.before")) | (F.col("p.after") == F.col("s.after"))
    met = p.join(s, (F.col("p.gram") == F.col("s.gram")) & whole).select("fp", "item", F.struct((F.col("at") - F.col("place")).alias("begin"), "place").alias("seed"))
    pairs = materialize(met.groupBy("fp", "item").agg(F.collect_set("seed").alias("begins")), "candidates")
    held = own.join(bounded(materialize(pairs.select("fp").distinct(), "met")), "fp", "left_semi").dropDuplicates(["fp"])
    both = pairs.join(held, "fp").join(tests.withColumnRenamed("text", "item_text"), "item")
    return both.mapInArrow(_align(min_share), "fp binary, item binary, similarity double, end_word long, item_words long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, item_id, similarity, end_word, item_words: one row per document and item it holds.

    ``benchmark`` has item_id and text.  ``similarity`` is the alignment score over
    that of a full copy, which is under ``min_share`` where only a passage of
    PASSAGE_WORDS words is found; ``end_word``: where in the document the copy ends.
    Null or empty texts and items without a word hold nothing and are found nowhere;
    rows that repeat an id, or have none, are searched each, with one row per item
    for each of them.  Items without an id are not reported; two items of one text
    both are.  Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    found = materialize(leaks(own, items, min_share), "leaks")
    named = found.join(items.select("item_id", _digest(F.col("text")).alias("item")), "item")
    return own.select("doc_id", _digest(F.col("text")).alias("fp")).join(bounded(materialize(named, "named")), "fp").select("doc_id", "item_id", "similarity", "end_word", "item_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with an id or without, all columns unchanged.

    Null and empty texts are kept; rows that repeat each other go or stay together;
    an empty benchmark drops nothing; other columns may have any name.
    """
    found = leaks(docs.select(F.col(text_col).cast("string").alias("text")), benchmark.select(F.col("text").cast("string").alias("text")), min_share)
    gone = materialize(found.select("fp").distinct(), "leaks")
    return docs.alias("_docs").join(bounded(gone).alias("_gone"), _digest(F.col(f"_docs.{text_col}").cast("string")) == F.col("_gone.fp"), "left_anti")
