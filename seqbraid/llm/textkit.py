"""Word tables over Arrow batches of text, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Its hash is a
polynomial over its bytes modulo 2**64, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of text handled at once; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 20
#: Bytes that ``words`` hashes at once, up to the next space; so its work space doesn't grow with a text.
HASH_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse; only those of usual lengths are kept."""
    if not _powers:
        _powers[:] = [np.cumprod(np.full(2 * HASH_BYTES, x, np.uint64)) for x in (_P, _Q)]
    return _powers if n <= len(_powers[0]) else [np.cumprod(np.full(n, x, np.uint64)) for x in (_P, _Q)]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def free_names(taken: list[str], *names: str) -> tuple[str, ...]:
    """The names, with underscores after them where a column has that name already."""
    low, out = {x.lower() for x in taken}, []
    for name in names:
        while name in low:
            name += "_"
        out.append(name)
    return tuple(out)


def thinned(labelled: DataFrame, rows: int) -> DataFrame:
    """About twice ``rows`` of the rows (or all), those of the smallest hashes of doc_id, with the hash.

    So what the driver then sorts and cuts to ``rows`` has the same size however
    many rows and partitions there are.
    """
    total = labelled.count()
    most = min(1.0, (2 * rows + 1000) / max(total, 1))
    hashed = labelled.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    return hashed.where(F.col("_hash") <= most * (1 << 40))


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased if asked for
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the number of words
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of at least HASH_BYTES bytes (but for the last) that end where no word goes on."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + HASH_BYTES)
        if end < n:
            border = int(offsets[np.searchsorted(offsets, end)])
            while end < border:
                gap = np.flatnonzero(_SPACE[data[end : min(end + HASH_BYTES, border)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + HASH_BYTES, border)
        yield start, end
        start = end


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(column)
    if lower:
        data = _LOWER[data]
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for start, end in _cuts(data, offsets):
        part = data[start:end]
        n = len(part)
        solid = ~_SPACE[part]
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end, "right")] - start] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        stop[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        found.append((starts + start, ends + start, mix((total[ends] - total[starts]) * inverse[starts])))
    starts, ends, hashes = map(np.concatenate, zip(*found, strict=True))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, over text borders too; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _P + hashes[j : j + n]
    return mix(out)


def shingles(table: Words, i: int, k: int, all_runs: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of text i: its k-word runs, or its whole sequence if shorter."""
    a, b = int(table.first[i]), int(table.first[i + 1])
    if a == b:
        return np.zeros(0, np.uint64)
    if b - a < k:
        return runs(table.hashes[a:b], b - a)
    return np.unique(all_runs[a : b - k + 1])
