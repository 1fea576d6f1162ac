"""SentencePiece encoding by Viterbi, its forward scores shared between words.

A text is marked as the model's normaliser does (a mark before it and for every
space) and cut before each run of marks; no piece reaches over such a cut.  The
distinct marked words of a slice are sorted, which lays them out as a trie in
depth-first order: a word begins where it leaves its predecessor, and the forward
scores of the prefix they share stay on the stack.  Each position looks leftwards
only as far as some piece has such an ending.  The segmentation maximises the sum of
the pieces' scores; of equal ones the longer last piece wins.  A unigram model's
scores are log probabilities; a BPE model's are merge ranks, which stand for
probabilities by the power law 1 / (rank + 3).

For BPE models the library merges pairs instead, by the same ranks, and the two
segmentations of a word may differ.  With ``merge`` the same walk of the trie keeps
each prefix's last piece under merging instead of its best score: merging a prefix ends in piece t just if
merging the rest ends in some piece s, and s and t side by side stay two pieces when
merged.  Should a prefix have no such piece, its word is merged by itself.

Characters without a piece become byte pieces.  Decoding turns pieces back into
bytes, marks into spaces, and drops the first.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import textkit

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, and pairs of pieces; only words of under LONGEST_CACHED characters are.
CACHE, LONGEST_CACHED = 60_000, 64


def common_prefixes(words: list[str]) -> list[int]:
    """The length of each word's common prefix with the word before it."""
    if not words:
        return []
    if max(map(len, words)) > LONGEST_CACHED:
        out, before = [], ""
        for word in words:
            n = min(len(word), len(before))
            out.append(n if word[:n] == before[:n] else next(i for i in range(n) if word[i] != before[i]))
            before = word
        return out
    grid = np.array(words).view(np.uint32).reshape(len(words), -1)
    unlike = np.ones((len(words), grid.shape[1] + 1), bool)
    unlike[1:, :-1] = (grid[1:] != grid[:-1]) | (grid[1:] == 0)
    unlike[0, 0] = True
    return unlike.argmax(axis=1).tolist()


class Pieces:
    """A model's pieces, with Viterbi encoding and decoding."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float]] | None = None, bpe: bool = False, merge: bool = False):
        """Of a model file, or of a list of (piece, score) with byte pieces written <0xNN>; ``merge``: see above."""
        self.score: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        if pieces is None:
            import sentencepiece

            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            with open(path, "rb") as file:
                kind = sentencepiece_model_pb2.ModelProto.FromString(file.read()).trainer_spec
            bpe = kind.model_type == kind.BPE
            pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
            skipped = {i for i in range(len(pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        else:
            skipped = set()
        self.raw = [b""] * len(pieces)
        self.scores = [s for _, s in pieces]
        for i, (piece, score) in enumerate(pieces):
            if i in skipped:
                continue
            if bpe:
                score = -math.log(max(3 - score, 1))
            if len(piece) == 6 and piece[:3] == "<0x" and piece[-1] == ">":
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
                continue
            self.raw[i] = piece.replace(MARK, " ").encode()
            self.score[piece] = (score, i)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece reaches over a mark, so words can't be encoded alone")
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        self.ending: dict[str, tuple[float, int] | None] = {}
        for piece in self.score:
            for i in range(len(piece)):
                self.ending.setdefault(piece[i:])
        self.ending.update(self.score)
        self.cache: dict[str, tuple[bytes, float]] = {}
        self.bpe, self.merge = bpe, merge
        if merge and not bpe:
            raise ValueError("only a BPE model's pieces are merged")
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the adjacent pair of the best score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, before: str, after: str) -> bool:
        return self.merged(before + after) == ([before, after] if before else [after])

    def _last_pieces(self, word: str, shared: int, last: list[str], unsure: list[int]) -> None:
        """For each longer prefix, the piece that merging it ends in; ``unsure``: prefixes for which the rule finds none."""
        ending, pairs = self.ending, self.pairs
        while unsure and unsure[-1] > shared:
            unsure.pop()
        for j in range(shared + 1, len(word) + 1):
            i = j - 1
            while True:
                text = word[i:j] if i >= 0 else None
                if i < 0 or (text not in ending and i < j - 1):
                    last.append(self.merged(word[:j])[-1])
                    unsure.append(j)
                    break
                if i == j - 1 or ending[text] is not None:
                    known = pairs.get(last[i])
                    if known is None:
                        known = pairs[last[i]] = {}
                    stay = known.get(text)
                    if stay is None:
                        stay = known[text] = self._stay(last[i], text)
                        self.n_pairs += 1
                    if stay:
                        last.append(text)
                        break
                i -= 1

    def _best_pieces(self, word: str, shared: int, last: list[str], best: list[float]) -> None:
        """For each longer prefix, the last piece of its best segmentation, and its score."""
        look, score, unknown = self.ending.get, self.score.get, self.unknown
        for j in range(shared + 1, len(word) + 1):
            i, held = j - 1, word[j - 1]
            found = score(held)
            high = best[i] + (found[0] if found is not None else unknown)
            while i > 0:
                i -= 1
                text = word[i:j]
                found = look(text, False)
                if found is False:
                    break
                if found is not None and (value := best[i] + found[0]) >= high:
                    high, held = value, text
            best.append(high)
            last.append(held)

    def _ids(self, pieces: list[str]) -> tuple[array, float]:
        ids, total = array("I"), 0.0
        for piece in pieces:
            if piece in self.score:
                value, of = self.score[piece]
                ids.append(of)
                total += value
            else:
                ids.extend([self.bytes.get(b, 0) for b in piece.encode()])
                total += self.unknown
        return ids, total

    @staticmethod
    def _back(word: str, last: list[str]) -> list[str]:
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= len(last[j])
        out.reverse()
        return out

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, array, float]]:
        """Each distinct word of a sorted list with its ids and the sum of their scores."""
        last, best, unsure = [""], [0.0], []
        if self.n_pairs > CACHE:
            self.pairs.clear()
            self.n_pairs = 0
        for word, shared in zip(words, common_prefixes(words), strict=True):
            del last[shared + 1 :], best[shared + 1 :]
            if self.merge:
                self._last_pieces(word, shared, last, unsure)
            else:
                self._best_pieces(word, shared, last, best)
            yield word, *self._ids(self.merged(word) if unsure else self._back(word, last))

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """Ids of whole texts, as native unsigned 32-bit integers, with their scores."""
        if len(self.cache) > CACHE:  # what came first is mostly what comes often
            self.cache = dict(islice(self.cache.items(), CACHE // 2))
        cache = self.cache
        split = [self._words(x) for x in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(cache)
        long = {}
        usual, rest = [], []
        for x in new:
            (usual if len(x) < LONGEST_CACHED else rest).append(MARK + x)
        for words, kept in ((usual, cache), (rest, long)):
            for word, ids, score in self.encode_words(sorted(words)):
                kept[word[1:]] = (ids.tobytes(), score)
        out = []
        for words in split:
            held = [cache[x] if x in cache else long[x] for x in words] if long else list(map(cache.__getitem__, words))
            out.append((b"".join([x[0] for x in held]), sum([x[1] for x in held])))
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """The marked words, each without its first mark."""
        if MARK in text:  # the cuts are sure only where marks stand for spaces
            return [text.replace(" ", MARK)]
        words = text.split(" ") if text else []
        if "" not in words:
            return words
        out, marks = [], ""
        for word in words:
            if word:
                out.append(marks + word)
                marks = ""
            else:
                marks += MARK
        return [*out, marks[1:]] if marks else out

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        items = array("I", ids) if isinstance(ids, bytes) else ids
        data = b"".join(map(self.raw.__getitem__, items))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_models: dict[tuple[str, bool], Pieces] = {}


def model(path: str, merge: bool = False) -> Pieces:
    if (path, merge) not in _models:
        _models[path, merge] = Pieces(path, merge=merge)
    return _models[path, merge]


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, np.uint32).astype("<u4").tobytes())


def _encode(path: str, merge: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, merge)
        for part in textkit.slices(batches, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            found = pieces.encode(texts)
            same = [pieces.decode(ids) == text for text, (ids, _) in zip(texts, found, strict=True)]
            columns = [part.column("doc_id"), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([_crc(x) for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "score", "round_trip"]
            if with_ids:
                flat = np.frombuffer(b"".join([x for x, _ in found]), np.uint32).astype(np.int32)
                at = np.cumsum([0, *(len(x) // 4 for x, _ in found)]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", merge: bool = False, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, round_trip and the ids of every whole text.

    The ids are Viterbi's; with ``merge`` those that merging gives for a BPE model, as
    the library does it.  ``score`` is the sum of their scores.  Null text counts as empty and has no pieces.
    ``round_trip``: decoding the ids gives the text back; only a text that itself
    holds the mark U+2581 fails.  One row per input row, ids null or repeated
    included, equal texts alike; an empty table gives an empty result; only the two
    columns are read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_encode(path, merge, with_ids), f"doc_id {kind}, n_pieces long, ids_crc32 long, score double, round_trip boolean" + ", ids array<int>" * with_ids)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give null text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {kind}, text string")
