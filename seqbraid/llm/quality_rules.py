"""Quality rules, and an isolation forest over their statistics.

The base rules count; the forest judges the shape of a text.  Trees split the space
of the ratios at random, feature and place, where the labelled rows lie, until a
good one stands alone or a cell holds none.  What is unlike the good rows is in an
empty cell after few splits.  The mean path length becomes the usual score
2**(-length / expected length), and the limit between kept and dropped is the one
that separates the labelled good and bad documents best, subject to keeping nearly
all good ones.

All labelled rows count.  The places of the splits need only the rows' least and
greatest values; the executors then count the good rows of every cell, which gives
the path lengths, and the labelled rows of every score, which give the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import textkit
from seqbraid.llm.textstats import RATIOS, counts
from seqbraid.plans.shared import discard, materialize

#: Trees, and the most cells of a tree: the size of the model, however many rows it counts.
TREES, CELLS = 128, 256
#: Scores are multiples of 1 / STEPS, so that the driver's table of them has a bounded size.
STEPS = 1 << 20
#: Of the labelled good rows, the limit keeps at least this share.
KEEP_GOOD = 0.995
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _expected(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees in flat arrays, one complete tree after another; a leaf has no children (-1) and a path length."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int | None = None, seed: int = 11):
        """Of good ``points``, all or ``sample`` of them a tree; splits fall anywhere between ``low`` and ``high``."""
        size = min(sample or len(points), len(points))
        self._split(size, low, high, trees, seed)
        rng = np.random.default_rng([seed, 1])
        self.fill(np.array([self._cells_of(root, points[rng.choice(len(points), size, replace=False)]) for root in self.roots]) if size < len(points) else self.cells(points))

    @classmethod
    def unfilled(cls, size: int, low: np.ndarray, high: np.ndarray, trees: int = TREES, seed: int = 11) -> Forest:
        """The splits for ``size`` good points; ``fill`` makes it a forest of them."""
        forest = cls.__new__(cls)
        forest._split(size, low, high, trees, seed)
        return forest

    def _split(self, size: int, low: np.ndarray, high: np.ndarray, trees: int, seed: int) -> None:
        rng, wide = np.random.default_rng(seed), np.flatnonzero(high > low)
        self.depth = max(1, math.ceil(math.log2(max(2, min(size, CELLS))))) if len(wide) else 0
        self.base = float(_expected(size)) or 1.0
        nodes = (2 << self.depth) - 1
        self.roots = np.arange(trees) * nodes
        self.feature, self.at = np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))
        low, high = (np.tile(x.astype(float), (trees, 1, 1)) for x in (low, high))
        for level in range(self.depth):
            here = slice((1 << level) - 1, (2 << level) - 1)
            f = rng.choice(wide, (trees, 1 << level))
            cut = rng.uniform(*(np.take_along_axis(x, f[..., None], 2)[..., 0] for x in (low, high)))
            self.feature[:, here], self.at[:, here] = f, cut
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
            np.put_along_axis(high[:, ::2], f[..., None], cut[..., None], 2)
            np.put_along_axis(low[:, 1::2], f[..., None], cut[..., None], 2)
        self.feature, self.at = self.feature.ravel(), self.at.ravel()
        inner = np.tile(np.arange(nodes) < nodes // 2, trees)
        self.left = np.where(inner, np.arange(trees * nodes) + np.tile(np.arange(nodes), trees) + 1, -1)
        self.right = np.where(inner, self.left + 1, -1)

    def _cells_of(self, root: int, points: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[every, self.feature[root + node]] >= self.at[root + node])
        return np.bincount(node - (1 << self.depth) + 1, minlength=1 << self.depth)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """How many points are in each cell of each complete tree."""
        return np.array([self._cells_of(root, points) for root in self.roots])

    def fill(self, counts: np.ndarray) -> None:
        """Path lengths from the points in each cell; a node of at most one point becomes a leaf."""
        levels = [counts]
        while levels[0].shape[1] > 1:
            levels.insert(0, levels[0][:, ::2] + levels[0][:, 1::2])
        depths = np.concatenate([np.full(1 << d, d) for d in range(len(levels))])
        held = np.concatenate(levels, axis=1)
        self.length = (depths + _expected(held)).ravel()
        self.left, self.right = (np.where(held.ravel() > 1, x, -1) for x in (self.left, self.right))

    def lengths(self, points: np.ndarray) -> np.ndarray:
        """Mean path lengths."""
        total, every = np.zeros(len(points)), np.arange(len(points))
        for root in self.roots:
            node = np.full(len(points), root)
            for _ in range(self.depth):
                below = np.where(points[every, self.feature[node]] < self.at[node], self.left[node], self.right[node])
                node = np.where(self.left[node] >= 0, below, node)
            total += self.length[node]
        return total / len(self.roots)

    def score(self, points: np.ndarray) -> np.ndarray:
        return np.round(2.0 ** (-self.lengths(points) / self.base) * STEPS) / STEPS


def limit(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score up to which a document is kept."""
    cuts, at = np.unique(scores, return_inverse=True)
    return limit_of_counts(cuts, np.bincount(at[good], minlength=len(cuts)), np.bincount(at[~good], minlength=len(cuts)), keep_good)


def limit_of_counts(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The same from ascending different scores and the good and bad rows of each."""
    kept, passed = np.cumsum(good), np.cumsum(bad)
    if not len(cuts) or not kept[-1] or not passed[-1]:
        return 1.0
    low = int(np.searchsorted(kept, math.ceil(keep_good * kept[-1])))
    best = low + int(np.argmax((kept / kept[-1] - passed / passed[-1])[low:]))
    return float(cuts[best : best + 2].mean())


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textkit.slices(batches, "text"):
        rows = [counts(x or "") for x in part.column("text").to_pylist()]
        numbers = np.array([c for c, _ in rows], np.int64).reshape(-1, len(_COUNTS)).T
        ratios = np.array([r for _, r in rows], np.float64).reshape(-1, len(RATIOS)).T
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, numbers), *map(pa.array, ratios)], ["doc_id", *_COUNTS, *RATIOS])


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS])


def _judge(forest: Forest | None, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _COUNTS}
            failed = (numbers["n_words"] < MIN_WORDS) | (100 * numbers["n_repeat_words"] > MAX_REPEAT_PERCENT * numbers["n_words"])
            score = forest.score(_points(batch)) if forest is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in _COUNTS), pa.array(failed), pa.array(~failed & (score <= most)), pa.array(score)], ["doc_id", *_COUNTS, "base_failed", "kept", "anomaly"])

    return run


def _count_cells(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((forest.cells(_points(batch)) for batch in batches), np.zeros((len(forest.roots), 1 << forest.depth), np.int64))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], ["tree", "held"])

    return run


def _add_cells(table: pa.Table) -> pa.Table:
    held = np.array(table.column("held").to_pylist(), np.int64).sum(axis=0)
    return pa.table({"tree": table.column("tree")[:1], "held": pa.array([held], pa.list_(pa.int64()))})


def _scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_points(batch))), batch.column("good")], ["score", "good"])

    return run


def fit(points: DataFrame) -> tuple[Forest | None, float]:
    """The forest and the limit of all rows of ``points``: good (boolean) and the ratios.

    Three passes; the driver sees the extremes, a count for each cell of the forest,
    and one for each score (at most STEPS + 1).
    """
    good = F.sum(F.col("good").cast("long"))
    ends = points.agg(F.count("*").alias("n"), good.alias("good"), *(f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in RATIOS)).first()
    if not ends["good"] or ends["good"] == ends["n"]:
        return None, 1.0
    forest = Forest.unfilled(ends["good"], *(np.array([ends[f"{name}_{c}"] for c in RATIOS]) for name in ("min", "max")))
    kind = "tree int, held array<long>"
    cells = points.where("good").mapInArrow(_count_cells(forest), kind).groupBy("tree").applyInArrow(_add_cells, kind).toArrow().sort_by("tree")
    forest.fill(np.array(cells.column("held").to_pylist(), np.int64))
    held = points.mapInArrow(_scores(forest), "score double, good boolean").groupBy("score").agg(good.alias("good"), F.count("*").alias("n")).toArrow().sort_by("score")
    fine, n = (held.column(c).to_numpy() for c in ("good", "n"))
    return forest, limit_of_counts(held.column("score").to_numpy(), fine, n - fine)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, anomaly (0 to 1).

    Null text counts as empty, which the base rules fail.  Forest and limit come from
    all labelled rows; without good rows among them, or without bad ones, the base
    rules decide alone.  Labels that are null, or whose id is null, are not used; of
    an id labelled twice, every label counts.  Repeated ids give a row each, equal
    texts the same verdict; a long text is judged whole; an empty table gives an empty
    result; only the named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ", ".join([*(f"{c} long" for c in _COUNTS)])
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = materialize(own.mapInArrow(_stats, f"doc_id {kind}, {numbers}, " + ", ".join(f"{c} double" for c in RATIOS)), "stats")
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(quality_col) == 1).alias("good")).dropna()
    points = materialize(stats.join(known, "doc_id").select("good", *RATIOS), "points")
    forest, most = fit(points)
    discard(points)
    return stats.mapInArrow(_judge(forest, most), f"doc_id {kind}, {numbers}, base_failed boolean, kept boolean, anomaly double")
