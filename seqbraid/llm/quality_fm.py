"""Quality scores from a factorisation machine.

A text's features are its hashed words, the ratios of ``textstats`` in ranges, its
length in ranges, and as metadata the length that its row states.  The model adds a weight for each feature and the inner
product of two low-rank vectors for each pair of features; by

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over f [(sum v_if x_i)^2 - sum (v_if x_i)^2]

a text is scored in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from seqbraid.llm import textkit
from seqbraid.llm.textstats import RATIOS, counts

#: The model is fitted on at most so many labelled rows.
LABELLED_ROWS = 4000
WORD_BUCKETS, BINS, LENGTH_BINS, RANK = 4096, 12, 20, 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-4
CUT = 0.3

_FIRST_RATIO = WORD_BUCKETS
_FIRST_LENGTH = _FIRST_RATIO + BINS * len(RATIOS)
_FIRST_STATED = _FIRST_LENGTH + LENGTH_BINS
FEATURES = _FIRST_STATED + LENGTH_BINS + 1


def _bins(ratios: np.ndarray) -> np.ndarray:
    """Ranges that double: 0, then up to 2**-9, 2**-8 ... of each ratio (of a 32nd of it for word length)."""
    value = ratios.copy()
    value[:, 0] /= 32
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log2(np.maximum(value, 1e-12))) + BINS - 2, 0, BINS - 1).astype(np.int64)


def _stated(column: pa.Array) -> np.ndarray:
    """Ranges of a stated length; the last is for none, or a negative one."""
    size = pc.fill_null(column, -1).to_numpy(zero_copy_only=False)
    return np.where(size < 0, LENGTH_BINS, np.clip(np.log2(1 + np.maximum(size, 0)), 0, LENGTH_BINS - 1)).astype(np.int64)


def features(column: pa.Array, stated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a slice of texts, rows ascending; each row's words have length 1 together."""
    table = textkit.words(column, lower=True)
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(table.first))
    key, times = np.unique(row * WORD_BUCKETS + (table.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    rows, value = key // WORD_BUCKETS, np.log1p(times)
    norm = np.sqrt(np.bincount(rows, value**2, n))
    stats = [counts(x or "") for x in column.to_pylist()]
    ratios = np.array([r for _, r in stats], float).reshape(n, len(RATIOS))
    length = np.clip(np.log2(1 + np.array([c[0] for c, _ in stats])), 0, LENGTH_BINS - 1).astype(np.int64)
    shape = _FIRST_RATIO + BINS * np.arange(len(RATIOS)) + _bins(ratios)
    all_rows = np.concatenate([rows, np.repeat(np.arange(n), len(RATIOS)), np.arange(n), np.arange(n)])
    all_ids = np.concatenate([key % WORD_BUCKETS, shape.ravel(), _FIRST_LENGTH + length, _FIRST_STATED + _stated(stated)])
    values = np.concatenate([value / norm[rows], np.full(n * len(RATIOS), 0.5), np.full(2 * n, 0.5)])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], all_ids[order], values[order]


class Machine:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.weight, self.vectors = 0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK))

    def raw(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows before the logistic function."""
        out = self.bias + np.bincount(row, self.weight[ids] * x, n)
        for f in range(RANK):
            part = self.vectors[ids, f] * x
            out += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part**2, n))
        return out

    def score(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, ids, x, n), -30, 30)))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 6) -> Machine:
        """Logistic loss, both labels weighing the same in all, by Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
        state = [(np.zeros(FEATURES), np.zeros(FEATURES)), (np.zeros((FEATURES, RANK)), np.zeros((FEATURES, RANK)))]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                row = np.repeat(np.arange(len(chosen)), [len(texts[i][0]) for i in chosen])
                ids, x = (np.concatenate([texts[i][j] for i in chosen]) for j in (0, 1))
                error = (self.score(row, ids, x, len(chosen)) - label[chosen]) * weight[chosen] / len(chosen)
                step += 1
                each = error[row] * x
                sums = np.zeros((len(chosen), RANK))
                held = self.vectors[ids]
                for f in range(RANK):
                    sums[:, f] = np.bincount(row, held[:, f] * x, len(chosen))
                slope = np.bincount(ids, each, FEATURES) + DECAY * self.weight
                slopes = np.column_stack([np.bincount(ids, each * (sums[row, f] - held[:, f] * x), FEATURES) for f in range(RANK)]) + DECAY * self.vectors
                self.bias -= RATE * error.sum()
                for param, g, (first, second) in ((self.weight, slope, state[0]), (self.vectors, slopes, state[1])):
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    param -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return self


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textkit.slices(batches, "text"):
        row, ids, x = features(part.column("text"), part.column("n_chars"))
        at = np.searchsorted(row, np.arange(part.num_rows + 1))
        yield pa.RecordBatch.from_arrays([part.column("_hash"), part.column("quality"), pa.array([ids[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["_hash", "quality", "ids", "x"])


def _apply(machine: Machine, shift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.slices(batches, "text"):
            score = 1 / (1 + np.exp(-np.clip(machine.raw(*features(part.column("text"), part.column("n_chars")), part.num_rows) + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, held_out: int = 0, labelled_rows: int = LABELLED_ROWS, stated_col: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Learned from the ``labelled_rows`` labelled rows of the smallest id hashes among
    those whose crc32 of the id as text doesn't leave ``held_out`` modulo ``mod``.
    Null text counts as empty; empty texts have a score too.  Without labels of both
    kinds every score is 0.5.  Null labels and ids aren't learned from; an id
    labelled twice counts twice; repeated ids give a row each.  Scores are shifted
    so that ``CUT`` separates the labelled rows where both errors weigh the same.
    A long text is scored whole, by itself.  An empty table gives an empty result.
    Of other columns only ``stated_col`` is read, if there is one and it is a number.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == held_out, F.lit(False))
    numeric = stated_col in docs.columns and isinstance(docs.schema[stated_col].dataType, NumericType)
    stated = F.col(stated_col).cast("double") if numeric else F.lit(None).cast("double")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), out.alias("held_out"), stated.alias("n_chars"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held_out)
    chosen = textkit.thinned(known, labelled_rows).orderBy("_hash", "doc_id", "quality").limit(labelled_rows)
    held = own.join(F.broadcast(chosen), "doc_id").select("_hash", "quality", "text", "n_chars").mapInArrow(_encode, "_hash long, quality int, ids binary, x binary")
    rows = held.orderBy("_hash", "quality", "ids", "x").limit(labelled_rows).collect()  # a document may come more than once; a row has FEATURES entries at most
    rows.sort(key=lambda r: (r["quality"], r["ids"], r["x"]))
    label = np.array([r["quality"] == 1 for r in rows], float)
    machine, shift = Machine(), 0.0
    machine.vectors[:] = machine.vectors if 0 < label.sum() < len(label) else 0
    if 0 < label.sum() < len(label):
        machine.fit([(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows], label)
        shift = float(np.log(CUT / (1 - CUT)))
    return own.mapInArrow(_apply(machine, shift), f"doc_id {kind}, held_out boolean, score double, predicted int")
