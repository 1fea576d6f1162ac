"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of learned texts.  A
text, lower-cased and with everything but letters turned into spaces, is cut into
blocks; each block is compressed with each dictionary, and the language whose
blocks are smallest in total is chosen.  When the runner-up is nearly as small, the
text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import textkit

#: A dictionary is made of at most so many texts, up to PIECE characters from a place in each, until it is full.
TEXTS, PIECE, DICTIONARY_BYTES = 96, 1024, 1 << 16
BLOCK, LEVEL = 8192, 6
#: Texts whose runner-up is less than this share larger are rejected.
MIN_MARGIN = 0.002
#: Code lengths are compared on this scale: each byte less is so much likelier.
BYTE_WEIGHT = 0.2
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower())} ".encode()


def dictionaries(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    """lang -> dictionary, from (lang, text) in order; the first texts stand at the end, where matches are cheapest."""
    out: dict[str, bytes] = {}
    for lang, text in rows:
        held = out.get(lang, b"")
        if len(held) < DICTIONARY_BYTES:
            out[lang] = letters(text[:PIECE]) + held
    return {k: v[-DICTIONARY_BYTES:] for k, v in out.items() if v.strip()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.pack = []
        for lang in self.langs:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(content[lang]), write_content_size=False, write_checksum=False)
            held = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.pack.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))

    def sizes(self, text: str) -> list[int] | None:
        """Compressed bytes for each language; None: no letter."""
        if not any(map(str.isalpha, text)):
            return None
        data = letters(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum([len(p.compress(b)) for b in blocks]) for p in self.pack]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the runner-up's surplus."""
        sizes = self.sizes(text) if text and self.langs else None
        if sizes is None:
            return UNKNOWN, 0.0, 0.0
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        best = sizes[order[0]]
        score = 1 / float(np.exp(-BYTE_WEIGHT * (np.array(sizes) - best)).sum())
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return self.langs[order[0]], score, margin


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = TEXTS) -> dict[str, bytes]:
    """Dictionaries from a sample of at most ``texts`` texts a language.

    Rows of a language are thinned to a few times that number by the hash of their
    id, then those of the smallest hashes are taken, so no task holds a language.
    Texts without a letter are passed over.  Of each text, letters only, PIECE
    characters are taken from a place that the hash of id and text chooses.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    hashed = own.withColumn("h", F.pmod(F.xxhash64("id", F.lit("dictionary")), F.lit(1 << 40)))
    totals = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    share = totals.select("lang", (F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(4.0 * texts + 64) / F.col("n"))).alias("most"))
    thin = hashed.join(F.broadcast(share), "lang").where("h < most").select("lang", "h", F.xxhash64("id", "text").alias("at"), F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")).alias("text"))
    place = F.pmod("at", F.greatest(F.length("text") - PIECE + 1, F.lit(1))).cast("int") + 1
    pieces = thin.select("lang", "h", F.substring("text", place, F.lit(PIECE)).alias("text"))
    ranked = pieces.withColumn("r", F.expr("row_number() over (partition by lang order by h, text)")).where(F.col("r") <= texts)
    rows = ranked.select("lang", "r", "text").collect()  # bounded: languages x texts x PIECE
    return dictionaries([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["r"]))])


def _predict(content: dict[str, bytes], text_col: str, columns: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for part in textkit.slices(batches, text_col):
            found = [model.predict(x) for x in part.column(text_col).to_pylist()]
            lang, score, margin = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], [*columns, *names])

    return run


def classify(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "margin")) -> DataFrame:
    """``docs`` (or the columns ``keep``) with language, score and margin of each whole text.

    Null text, and text without a letter, is ``und`` with score and margin 0; so is
    every text if no language was learned.  Equal sizes go to the first language in
    alphabetical order, with margin 0.  The three ``names`` must not be among the
    columns kept.
    """
    columns = list(keep or docs.columns)
    if clash := set(columns) & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema), f"{names[0]} string, {names[1]} double, {names[2]} double"])
    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(_predict(content, text_col, columns, list(names)), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 3, held_out: int = 1, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected.

    Dictionaries come only from rows whose crc32 of the id as text doesn't leave
    ``held_out`` modulo ``mod`` and whose language isn't null.  ``rejected``: no
    letter, or a margin under ``min_margin``.  One row per input row: rows that
    repeat an id or a text are judged each, and equal texts alike; a null id is kept
    and not held out.  An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == held_out, F.lit(False))
    content = learn(docs.where(~out), id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    found = classify(own, content, keep=["doc_id", "held_out"])
    return found.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is clear, all columns unchanged; learns from all of them.

    Null texts, and texts without a letter, go; so do all if no row has a language.
    Rows that repeat each other stay or go together.  Other columns may have any
    name.
    """
    content = learn(docs, id_col, text_col, lang_col)
    names = textkit.free_names(docs.columns, "lang_found", "score_found", "margin_found")
    found = classify(docs, content, text_col, names=names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= min_margin)).select(*docs.columns)
