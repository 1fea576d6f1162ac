"""Subword lattice likelihood.

The pieces of an existing vocabulary weight every segmentation of a word by their
scores, and the word's probability is their sum, by a forward recursion in log
space.  A text's probability is the product over its words and one end.  A unigram
model's scores are log probabilities and are taken as they are; a BPE model's are
merge ranks, which weigh by the power law 1 / (rank + 3).  The weights sum to what
the end leaves, whose weight is the share of ends among the training tokens.

``learned`` fits this to the training texts.  The scores so weigh the segmentations
of every distinct training word, and the pieces' expected counts in these, besides
PRIOR counts dealt by the scores, are the new weights.  The lattice under them is
what unseen words are expected to be: a word's probability is (c + V * lattice) /
(N + V), of its count c among N training tokens of V kinds.

Nothing is computed twice for a word: the corpus is dealt into blocks of documents,
each block gives its distinct words, the words' totals and likelihoods are found
once, and each block gets back the table of its own words.  So a frequent word costs
a row per block, a block's table is bounded by the block, and no vocabulary is ever
broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import textkit
from seqbraid.llm.sentencepieces import MARK, Pieces
from seqbraid.plans.shared import materialize

BLOCK_BYTES = 12 << 20
#: Small corpora are dealt into blocks of a quarter of that or more, up to so many.
SMALL_BLOCKS = 32
#: Words of up to so many characters are scored together; longer ones one by one.
TOGETHER = 48
_BATCH = 20_000
#: So many uses of pieces, dealt by the vocabulary's scores, besides those expected in the training words.
PRIOR = 100.0
#: How much rarer than the rarest piece a character is that the vocabulary can't spell, as a log10.
UNKNOWN_LOG = 6.0
_END = ""  # stands for a text's end, as no word is empty
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Lattice:
    """Pieces and their log10 weights, and sums over all segmentations."""

    def __init__(self, pieces: list[str], byte_pieces: dict[int, int], logs: np.ndarray):
        self.pieces, self.byte_pieces, self.logs = pieces, byte_pieces, logs
        #: Of a character that has no piece and whose bytes have none either.
        self.unknown = float(logs[np.isfinite(logs)].min()) - UNKNOWN_LOG if np.isfinite(logs).any() else -UNKNOWN_LOG
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[tuple[int, int]]] = {}
        self.ids = {}
        for i, piece in enumerate(pieces):
            if piece:
                self.ids[piece] = i
                lengths.setdefault(len(piece), []).append((int(self._hash(np.array([[ord(c) for c in piece]], np.uint64))[0]), i))
        for n, found in lengths.items():
            found.sort()
            self.by_length[n] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int64)
        self.longest = max(lengths, default=1)
        self.openings = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[0], np.uint64)
        for k in range(codes.shape[1]):
            out = textkit.mix(out * _MUL + codes[:, k] + np.uint64(1))
        return out

    def _spelled(self, char: str) -> float:
        """Log10 weight of a character as byte pieces."""
        ids = [self.byte_pieces.get(b) for b in char.encode()]
        return self.unknown if None in ids else float(self.logs[ids].sum())

    def _edges(self, codes: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, length): rows that have a piece there, its log weight, and its id; -1 for a character without a piece."""
        n, width = codes.shape
        out = {}
        for start in range(width):
            rolling = np.zeros(n, np.uint64)
            live = np.flatnonzero(lengths > start)
            for size in range(1, min(self.longest, width - start) + 1):
                live = live[lengths[live] >= start + size]
                if not len(live):
                    break
                rolling[live] = textkit.mix(rolling[live] * _MUL + codes[live, start + size - 1] + np.uint64(1))
                found = np.zeros(len(live), bool)
                if size in self.by_length:
                    keys, ids = self.by_length[size]
                    at = np.minimum(np.searchsorted(keys, rolling[live]), len(keys) - 1)
                    found = keys[at] == rolling[live]
                    if found.any():
                        out[start, size] = live[found], self.logs[ids[at[found]]], ids[at[found]]
                if size == 1 and not found.all():
                    rows = live[~found]
                    chars, back = np.unique(codes[rows, start], return_inverse=True)
                    each = np.array([self._spelled(chr(int(c))) for c in chars])
                    kept = out.get((start, 1), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                    out[start, 1] = np.concatenate([kept[0], rows]), np.concatenate([kept[1], each[back]]), np.concatenate([kept[2], np.full(len(rows), -1)])
        return out

    def _steps(self, word: str, start: int) -> Iterator[tuple[int, str, float]]:
        """(end, letters, natural log weight) of each piece that begins at ``start``."""
        ln10 = math.log(10)
        for end in range(start + 1, min(len(word), start + self.longest) + 1):
            text = word[start:end]
            if text in self.ids:
                yield end, text, float(self.logs[self.ids[text]]) * ln10
            elif end == start + 1:
                yield end, text, self._spelled(text) * ln10
            if text not in self.openings:
                return

    def _ahead(self, word: str) -> list[float]:
        """Natural log sums over all segmentations of each opening of a word."""
        ahead = [0.0] + [-math.inf] * len(word)
        for start in range(len(word)):
            for end, _, log in self._steps(word, start):
                ahead[end] = _plus(ahead[end], ahead[start] + log)
        return ahead

    def _forward_one(self, word: str) -> float:
        """``forward`` of one long word, position by position, as a natural logarithm."""
        return self._ahead(word)[-1]

    def _expected_one(self, word: str) -> np.ndarray:
        """``expected`` of one long word."""
        n, ahead, used = len(word), self._ahead(word), np.zeros(len(self.pieces))
        behind = [-math.inf] * n + [0.0]
        for start in range(n - 1, -1, -1):
            for end, text, log in self._steps(word, start):
                behind[start] = _plus(behind[start], behind[end] + log)
                self._count(used, text, math.exp(ahead[start] + log + behind[end] - ahead[n]))
        return used

    def _count(self, used: np.ndarray, text: str, share: float) -> None:
        """Add ``share`` uses of a piece, or of the byte pieces of a character that has none."""
        ids = [self.ids[text]] if text in self.ids else [self.byte_pieces.get(b) for b in text.encode()]
        if None not in ids:
            np.add.at(used, ids, share)

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((len(words), int(lengths.max())), np.uint64)
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return codes, lengths

    @staticmethod
    def _sums(edges: dict, order: list, lengths: np.ndarray) -> np.ndarray:
        """Natural log sums up to each position, a row each."""
        ln10 = math.log(10)
        ahead = np.full((int(lengths.max()) + 1, len(lengths)), -np.inf)
        ahead[0] = 0
        for start, size in order:
            rows, logs, _ = edges[start, size]
            ahead[start + size, rows] = np.logaddexp(ahead[start + size, rows], ahead[start, rows] + logs * ln10)
        return ahead

    def forward(self, words: list[str]) -> np.ndarray:
        """Log10 sums over all segmentations of marked words, all about equally long."""
        ln10 = math.log(10)
        if len(words) == 1 and len(words[0]) > TOGETHER:
            return np.array([self._forward_one(words[0]) / ln10])
        codes, lengths = self._codes(words)
        edges = self._edges(codes, lengths)
        return self._sums(edges, sorted(edges), lengths)[lengths, np.arange(len(words))] / ln10

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is used in marked words, all about equally long, one word counting as one."""
        if len(words) == 1 and len(words[0]) > TOGETHER:
            return self._expected_one(words[0])
        ln10, each = math.log(10), np.arange(len(words))
        codes, lengths = self._codes(words)
        edges = self._edges(codes, lengths)
        order = sorted(edges)
        ahead, used = self._sums(edges, order, lengths), np.zeros(len(self.pieces))
        total = ahead[lengths, each]
        behind = np.full(ahead.shape, -np.inf)
        behind[lengths, each] = 0
        for start, size in reversed(order):
            rows, logs, ids = edges[start, size]
            rest = behind[start + size, rows] + logs * ln10
            behind[start, rows] = np.logaddexp(behind[start, rows], rest)
            share, real = np.exp(ahead[start, rows] + rest - total[rows]), ids >= 0
            used += np.bincount(ids[real], share[real], len(used))
            for row, part in zip(rows[~real], share[~real], strict=True):
                self._count(used, words[row][start], part)
        return used

    def batches(self, words: list[str]) -> Iterator[np.ndarray]:
        """Word numbers in groups of about equal length."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            long = lengths[order[start]] > TOGETHER
            end = start + 1 if long else min(start + _BATCH, int(np.searchsorted(lengths[order], min(TOGETHER, lengths[order[start]] + 2), "right")))
            yield order[start : max(end, start + 1)]
            start = max(end, start + 1)


def weights(path: str, end: float) -> tuple[list[str], dict[int, int], np.ndarray]:
    """Pieces of a model file, its byte pieces, and log10 weights by their scores; the last entry is the end, of weight ``end``."""
    model = Pieces(path)
    pieces = [""] * len(model.raw)
    for piece, (_, i) in model.score.items():
        if model.scores[i] > -1e8:
            pieces[i] = piece
    held = [i for i, p in enumerate(pieces) if p]
    score = np.array(model.scores)
    logs = np.full(len(pieces) + 1, -np.inf)
    logs[held] = -np.log10(3 - score[held]) if model.bpe else score[held] / math.log(10)
    least = logs[held].min()
    for i in model.bytes.values():  # their own scores say nothing
        logs[i] = least
    usable = np.isfinite(logs)
    high = logs[usable].max()
    logs[usable] += math.log10(1 - end) - high - math.log10((10 ** (logs[usable] - high)).sum())
    logs[-1] = math.log10(end)
    return [*pieces, ""], model.bytes, logs


def _block_words(train_mod: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: dict[int, set] = {}
        train: dict[int, Counter] = {}
        for part in textkit.slices(batches, "text"):
            blocks, learns = part.column("block").to_pylist(), part.column("learns").to_pylist()
            for block, learn, text in zip(blocks, learns, part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                words.append(b"")
                if learn:
                    train.setdefault(block, Counter()).update(words)
                else:
                    every.setdefault(block, set()).update(words)
        for block in every.keys() | train.keys():
            counts = train.get(block, Counter())
            words = [*counts, *(every.get(block, set()) - counts.keys())]
            for i in range(0, len(words), 100_000):
                some = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int32()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts.get(w, 0) for w in some], pa.int64())], ["block", "word", "c"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about _BATCH words, for the lattice takes many together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _BATCH:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _likelihoods(pieces, byte_pieces, logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, byte_pieces, logs)
        for table in _gathered(batches):
            words = table.column("word").to_pylist()
            marked, out = [MARK + w for w in words], np.zeros(len(words))
            for group in lattice.batches(marked):
                out[group] = lattice.forward([marked[i] for i in group])
            out[[i for i, w in enumerate(words) if w == _END]] = logs[-1]
            yield from table.append_column("logp", pa.array(out)).combine_chunks().to_batches()

    return run


def _expected(pieces, byte_pieces, logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, used = Lattice(pieces, byte_pieces, logs), np.zeros(len(pieces))
        for table in _gathered(batches):
            marked = [MARK + w for w in table.column("word").to_pylist()]
            for group in lattice.batches(marked):
                used += lattice.expected([marked[i] for i in group])
        ids = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(used[ids])], ["piece", "used"])

    return run


def refitted(logs: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Log10 weights by the uses of pieces and PRIOR more, dealt by ``logs``; the end, the last, keeps its weight."""
    uses = used + PRIOR * 10**logs
    uses[-1] = 0
    with np.errstate(divide="ignore"):
        out = np.log10(uses / uses.sum() * (1 - 10 ** logs[-1]))
    out[-1] = logs[-1]
    return out


def _score(n_train: int, distinct: int, learned: bool):
    spread = n_train + distinct + 1
    kinds = max(1, distinct)

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(table.column("word").cast(pa.binary()).to_pylist())}
        c, logp = table.column("c").to_numpy(), table.column("logp").to_numpy()
        base = np.log10((c + 1) / spread)
        if learned:
            with np.errstate(divide="ignore"):
                logp = np.logaddexp(np.log(c), math.log(kinds) + logp * math.log(10)) / math.log(10) - math.log10(n_train + kinds)
        rows = []
        for text in texts.column("text").cast(pa.large_binary()).to_pylist():
            words = (text or b"").lower().split()
            words.append(b"")
            ids = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            rows.append((len(ids), int(np.count_nonzero(c[ids])), float(base[ids].sum()), float(logp[ids].sum())))
        n, known, low, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pa.array([not x for x in texts.column("learns").to_pylist()], pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_train] * len(n), pa.int64()), "base_score": pa.array(low, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES, learned: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Documents whose crc32 of the id as text leaves ``held_out`` modulo ``mod`` are
    not learned from; nor are those without an id, which are scored all the same.
    Null text counts as empty and holds the end alone.  With no training token the
    base has one unseen token's mass and the end the weight 1/200.  Repeated ids and
    equal rows give a row each, equal texts the same scores; a long text is in a
    block of its own size; an empty table gives an empty result; only the two named
    columns are read.  ``learned`` scores by the training words with the refitted
    lattice as their prior (see above); without, by the bare scores of the vocabulary.
    """
    learns = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod != held_out, F.lit(False))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), learns.alias("learns"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes), min(SMALL_BLOCKS, 4 * size // block_bytes))
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.octet_length("text")))
    dealt = own.withColumn("block", F.pmod(spot, F.lit(blocks)).cast("int"))
    in_blocks = materialize(dealt.repartition(blocks, "block").mapInArrow(_block_words(mod, held_out), "block int, word string, c long"), "block_words")
    words = materialize(in_blocks.groupBy("word").agg(F.sum("c").alias("c")), "words")
    n_train, distinct, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.col("word") == _END, F.col("c"))), F.lit(0))).first()
    pieces, byte_pieces, logs = weights(vocabulary, ends / (n_train + 1) if n_train else 1 / 200)
    if learned and n_train:
        used, trained = np.zeros(len(pieces)), words.where((F.col("c") > 0) & (F.col("word") != _END)).select("word")
        for row in trained.mapInArrow(_expected(pieces, byte_pieces, logs), "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():  # at most a row per piece
            used[row["piece"]] = row["used"]
        logs = refitted(logs, used)
    scored = words.mapInArrow(_likelihoods(pieces, byte_pieces, logs), "word string, c long, logp double")
    tables = in_blocks.select("block", "word").join(scored, "word")
    out = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(_score(n_train, distinct, learned), out)
