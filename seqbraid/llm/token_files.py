"""Token ids as independent zstandard frames with a trailing seek table.

A file is a sequence of frames, one per document in ascending id order, each with
a content checksum; a skippable frame with the documents' ids (those without
one come first) and token counts; and the seek table of the public zstandard seekable format (compressed size,
decompressed size and XXH64 checksum of each frame).  A reader takes the tables at
the end of a file and then decompresses the frames it wants, nothing else.

Texts are cut at single spaces between two characters that aren't white space.
The tokenizer's own splitting always begins a new piece there, so equal parts
have equal ids wherever they stand and a worker encodes each distinct part once,
many parts to a call; a token that begins with the space begins a part.  Of a part
that is letters and then anything that begins with an ASCII character other than a
letter, where the splitting always cuts, the letters are encoded apart, without the
splitting, and what follows them as a text of its own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import files, textkit
from seqbraid.plans.shared import materialize, new_path

END_ID = 2
ROWS_PER_FILE = 8192
#: Files at most; larger corpora get larger files.  So the driver's borders and manifest have a bounded size.
MOST_FILES = 20_000
#: Ids that the driver sorts for each border between files.
SAMPLED = 50
#: Parts of up to LONGEST characters that a worker remembers; beyond, the later half is forgotten.
CACHE, LONGEST = 500_000, 40
#: Parts that one call encodes end to end.
JOINED = 500
#: Letters of U+0041 to U+024F.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: The tokenizer's letter for each byte: printable Latin-1 stands for itself, the rest for U+0100 and on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_INDEX_MAGIC, _SEEK_MAGIC, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, width: int = 4):
        self.width, self.kind, self.code = width, f"<u{width}", {2: "H", 4: "I"}[width]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        if len(tokens) > 1 << 8 * width:
            raise ValueError(f"{len(tokens)} ids don't fit in {width} bytes")
        self.spaced = np.array([x.startswith("Ġ") for x in tokens])
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Split("Ġ", "merged_with_next")
        self.later: dict[str, bytes | None] = {}  # of " " + part; None: it touches more white space
        self.whole: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], letters: bool = False) -> Iterator[bytes]:
        """Ids of " " + part for parts that may be encoded alone; ``letters``: they need no splitting."""
        chunks = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        texts = [" " + " ".join(x) for x in chunks]
        if letters:
            texts = [x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LETTERS) for x in texts]
        found = (self.letters if letters else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        for chunk, one in zip(chunks, found, strict=True):
            ids = np.array(one.ids, self.kind)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(chunk):
                yield from self._ids([f" {x}" for x in chunk])
                continue
            raw, at = ids.tobytes(), [*(at * self.width).tolist(), self.width * len(ids)]
            yield from map(raw.__getitem__, map(slice, at, at[1:]))

    def _careful(self, head: str, rest: list[str]) -> list[str]:
        """Parts that may be encoded alone, for texts with wider white space."""
        parts = [head]
        for part in rest:
            if part and not part[0].isspace() and parts[-1] and not parts[-1][-1].isspace():
                parts.append(f" {part}")
            else:
                parts[-1] += f" {part}"
        return parts

    def _learn(self, new: set[str]) -> list[str]:
        """Remember the ids of the parts; returns the words that were learnt with them."""
        later, letters = self.later, _LETTERS.match
        plain, other, rest = set(), set(), []
        whole, words, ends = [], [], []
        for part in new:
            if part.isascii() and part.isalpha():
                plain.add(part)
            elif not part or part[0].isspace() or part[-1].isspace():
                later[part] = None
            elif (word := letters(part)) and ((n := word.end()) == len(part) or part[n].isascii()):
                word = word[0]
                if n < len(part):
                    whole.append(part)
                    words.append(word)
                    ends.append(part[n:])
                    if word in later:
                        continue
                (plain if word.isascii() else other).add(word)
            else:
                rest.append(part)
        for some in (list(plain), list(other)):
            later.update(zip(some, self._joined(some, letters=True), strict=True))
        later.update(zip(rest, self._joined(rest), strict=True))
        unseen = list(set(ends) - self.whole.keys())
        self.whole.update(zip(unseen, self._ids(unseen), strict=True))
        later.update(zip(whole, list(map(add, map(later.__getitem__, words), map(self.whole.__getitem__, ends))), strict=True))
        self._forget_long(self.whole, unseen)
        return words

    @staticmethod
    def _forget_long(seen: dict, parts: Iterable[str]) -> None:
        for part in [x for x in parts if len(x) > LONGEST]:
            seen.pop(part, None)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > CACHE:  # what came first is mostly what comes often
            self.later = dict(islice(self.later.items(), CACHE // 2))
        if len(self.whole) > CACHE:
            self.whole.clear()
        new: set[str] = set()
        heads: list[str] = []
        found: list[list[bytes | str | None]] = []  # a part that isn't known stands for itself
        find = self.later.get
        for text in texts:
            rest = text.split(" ")
            heads.append(rest.pop(0))
            found.append(row := list(map(find, rest, rest)))
            new.update([x for x in row if type(x) is str])
        words = self._learn(new)
        out: list[bytes] = []
        slow: list[tuple[int, list[str]]] = []
        later = self.later
        for i, (head, row) in enumerate(zip(heads, found, strict=True)):
            try:
                if row and (not head or head[-1].isspace()):
                    raise TypeError
                body = b"".join([later[x] if type(x) is str else x for x in row])
                parts = [head]
            except TypeError:
                body, parts = b"", self._careful(head, texts[i].split(" ")[1:])
            slow.append((i, parts))
            out.append(body)
        unseen = list({x for _, parts in slow for x in parts} - self.whole.keys())
        self.whole.update(zip(unseen, self._ids(unseen), strict=True))
        for i, parts in slow:
            out[i] = b"".join([self.whole[x] for x in parts]) + out[i]
        self._forget_long(self.later, new)
        self._forget_long(self.later, words)
        self._forget_long(self.whole, unseen)
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """The worker's encoder; Spark keeps workers from task to task."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def _frames(path: str, bounds: np.ndarray, width: int) -> Iterator:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], f"<u{width}").tobytes()
        pack = zstandard.ZstdCompressor(level=1, write_checksum=True)
        for part in textkit.slices(batches, "text"):
            ids = pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)
            texts = [x or "" for x in part.column("text").to_pylist()]
            data = [x + end for x in encoder(path, width).encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, ids, "left"), pa.int32()), part.column("doc_id"), pa.array([len(x) // width for x in data], pa.int64()), pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in data], pa.int64()), pa.array([pack.compress(x) for x in data], pa.binary())],
                ["bucket", "doc_id", "n_tokens", "checksum", "frame"],
            )

    return run


class _File:
    def __init__(self, folder: str, bucket: int, width: int):
        self.bucket, self.width = bucket, width
        self.out, self.uri = files.write(folder, f"tokens-{bucket:06d}", ".zst")
        self.ids, self.counts, self.sizes, self.sums = [], [], [], []

    def add(self, doc: int | None, count: int, checksum: int, frame: bytes) -> None:
        self.out.write(frame)
        self.ids.append(doc)
        self.counts.append(count)
        self.sizes.append(len(frame))
        self.sums.append(checksum)

    def close(self) -> tuple:
        known = [x for x in self.ids if x is not None]
        index = np.array([0] * (len(self.ids) - len(known)) + known, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(struct.pack("<IIBI", _INDEX_MAGIC, len(index) + 5, self.width, len(self.ids) - len(known)) + index)
        entries = np.array([self.sizes, np.array(self.counts, np.int64) * self.width, self.sums], np.int64).T.astype("<u4").tobytes()
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.ids), 0x80, _SEEKABLE))
        self.out.close()
        return self.bucket, self.uri, len(self.ids), sum(self.counts)


_MANIFEST = "bucket int, file string, n_docs long, n_tokens long"


def _writer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for bucket, doc, count, checksum, frame in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "checksum", "frame")), strict=True):
                if now is None or bucket != now.bucket:
                    if now is not None:
                        done.append(now.close())
                    now = _File(folder, bucket, width)
                now.add(doc, count, checksum, frame)
        if now is not None:
            done.append(now.close())
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["bucket", "file", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = ROWS_PER_FILE, width: int = 2) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest.

    Null text counts as empty and holds the end id alone.  Rows without an id come
    first; rows that repeat an id, or have none, all stay, in the order of their
    frames' bytes.  An empty table gives no file.  ``width``: bytes an id takes in
    the files, 2 or 4; the vocabulary must fit.  Whole texts are encoded, a long one
    by itself.  Only the two named columns are read.  Borders between files come
    from a sample of the ids, chosen by their hashes, of at most SAMPLED * MOST_FILES.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = own.select("doc_id").count()
    count = max(1, min(MOST_FILES, -(-n // rows_per_file)))
    bounds = []
    if count > 1:
        share = min(1.0, SAMPLED * count / n)
        some = own.select("doc_id").where((F.pmod(F.xxhash64("doc_id", F.lit("border")), F.lit(1 << 40)) <= share * (1 << 40)) & F.col("doc_id").isNotNull())
        seen = np.sort(some.toArrow().column("doc_id").to_numpy())
        bounds = seen[(np.arange(1, count) * len(seen)) // count] if len(seen) else []
    frames = own.mapInArrow(_frames(tokenizer, np.unique(np.array(bounds, np.int64)), width), "bucket int, doc_id long, n_tokens long, checksum long, frame binary")
    dealt = frames.repartition(count, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")
    return materialize(dealt.mapInArrow(_writer(folder, width), _MANIFEST), "manifest")


class TokenFile:
    """Random access to one file; frames are checked as they are read."""

    def __init__(self, uri: str):
        self.stream = files.read(uri)
        size = self.stream.size()
        self.stream.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", self.stream.read(9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table")
        index = 8 + 5 + 12 * count
        self.stream.seek(size - 9 - 12 * count - 8 - index)
        kind, _, self.width, self.nameless = struct.unpack("<IIBI", self.stream.read(13))
        if kind != _INDEX_MAGIC:
            raise ValueError(f"{uri} has no index")
        self.ids = np.frombuffer(self.stream.read(8 * count), "<i8")
        self.counts = np.frombuffer(self.stream.read(4 * count), "<u4").astype(np.int64)
        self.stream.seek(size - 9 - 12 * count)
        table = np.frombuffer(self.stream.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.lengths, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.unpack = zstandard.ZstdDecompressor()

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document, which alone is decompressed."""
        self.stream.seek(int(self.starts[i]))
        data = self.unpack.decompress(self.stream.read(int(self.sizes[i])), max_output_size=int(self.lengths[i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError("a frame's checksum is wrong")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, doc_id: int) -> list[np.ndarray]:
        a, b = self.nameless + np.searchsorted(self.ids[self.nameless :], [doc_id, doc_id + 1])
        return [self.tokens(i) for i in range(a, b)]

    def close(self) -> None:
        self.stream.close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            held = TokenFile(uri)
            sums = np.zeros(len(held.ids), np.int64)
            for i in range(len(sums)):
                ids = held.tokens(i)
                if len(ids) != held.counts[i]:
                    raise ValueError(f"{uri}: a document's length is wrong")
                sums[i] = zlib.crc32(ids.tobytes())
            held.close()
            starts = base + np.cumsum(held.counts) - held.counts
            nameless = np.arange(len(held.ids)) < held.nameless
            yield pa.RecordBatch.from_arrays([pa.array(held.ids, pa.int64(), mask=nameless), pa.array(starts, pa.int64()), pa.array(held.counts, pa.int64()), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files.

    The driver sees the manifest only: a row per file.
    """
    base, rows = 0, []
    for row in sorted(manifest.collect()):
        rows.append((row["file"], base))
        base += row["n_tokens"]
    spark = manifest.sparkSession
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(rows, "file string, base long").repartition(len(rows))
    return listed.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files to the shared folder and read them back."""
    return read_digests(write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, id_col, text_col))
