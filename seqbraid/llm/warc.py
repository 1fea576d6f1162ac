"""Web archives in which a payload is stored once.

Headers (page, length, SHA-1) are shuffled by digest; in each group of equal
payloads the page with the largest id keeps its payload as a ``response`` and the
others become ``revisit`` records that refer to it.  Pages then meet their
decision by id and each task writes one archive of gzip members, a record each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqbraid.llm import files, textkit
from seqbraid.plans.shared import materialize, new_path

_NAMES = uuid.UUID("7b0a1c52-53a1-4f0c-9a39-6c7f0f6a1d10")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with refers_to: the page whose record holds the same payload, else null.

    The originals are a table of their own, of payloads that come more than once, so
    that adaptive skew joins can split the headers of a payload that most pages have.
    """
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "payload_bytes")
    first = materialize(groups.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "originals")
    joined = headers.join(first, ["sha1", "payload_bytes"], "left")
    other = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "payload_bytes", "sha1", F.when(other, F.col("original")).alias("refers_to"))


def record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{payload_digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with fresh headers; ``payload`` is not stored in a revisit."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page, payload_digest)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, payload_digest)), ("WARC-Profile", _PROFILE), ("X-Refers-To-Page", str(refers_to))]
    block = _HTTP % size + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), *([("X-Page-ID", str(page))] if page is not None else []), ("X-Payload-Length", str(size)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, n = None, "", 0
        for part in textkit.slices(batches, "html"):
            if out is None:
                out, uri = files.write(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.gz")
            rows = zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").cast(pa.binary()).to_pylist(), part.column("payload_bytes").to_pylist(), part.column("sha1").to_pylist(), part.column("refers_to").to_pylist(), strict=True)
            for page, url, html, size, sha1, original in rows:
                own = base64.b32encode(bytes.fromhex(sha1)).decode()
                out.write(gzip.compress(record(page, url, html or b"", size, own, original, date), level, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["file", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the manifest: file, n_records.

    Null html is an empty payload.  Of payloads with at least ``min_bytes`` bytes
    that are equal, all but the largest page id become revisits; rows that repeat
    that id and payload are responses too.  A page without an id can't be referred
    to: it revisits the page of its payload that has the largest id, or is a
    response where none has one.  Other columns are not read.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    own = own.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(b""))))
    headers = own.select("page_id", F.octet_length(F.coalesce("html", F.lit(b""))).cast("long").alias("payload_bytes"), "sha1")
    decided = resolve(materialize(headers, "headers").distinct(), min_bytes)
    o, d = own.alias("o"), decided.alias("d")
    joined = o.join(d, (F.col("o.sha1") == F.col("d.sha1")) & F.col("o.page_id").eqNullSafe(F.col("d.page_id"))).select("o.*", "d.payload_bytes", "d.refers_to")
    return materialize(joined.mapInArrow(_writer(folder, date, level), "file string, n_records long"), "manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    left = b""
    while True:
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if not left:
                left = stream.read(chunk)
                if not left:
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            rows = []
            with files.read(uri) as stream:
                for data in members(stream):
                    fields, block = parse(data)
                    if digest(block) != fields["WARC-Block-Digest"][5:]:
                        raise ValueError(f"damaged record in {uri}")
                    size, own = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:]
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, own = len(payload), digest(payload)
                    original = fields.get("X-Refers-To-Page")
                    page = fields.get("X-Page-ID")
                    rows.append((int(page) if page else None, fields.get("WARC-Target-URI"), size, own, fields["WARC-Type"], int(original) if original else None))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's files, digests recomputed from the payloads."""
    count = max(1, manifest.count())
    return manifest.repartition(count).mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), min_bytes)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def deduplicated_sql(table: str = "pages") -> str:
    """``deduplicated`` with no least size, as DuckDB SQL."""
    digits = "('0x' || substr(h, i * 5 + 1, 5))::bigint"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({digits} >> {shift}) & 31)::int + 1, 1)"
    four = " || ".join(letter.format(digits=digits, shift=x) for x in (15, 10, 5, 0))
    return (
        f"with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from {table}), "
        "o as (select *, max(page_id) over (partition by h, payload_bytes) as original from p) "
        f"select page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i: {four}), 'string_agg', '') as payload_digest, "
        "case when original is null or original = page_id then 'response' else 'revisit' end as record_type, nullif(original, page_id) as refers_to from o"
    )
