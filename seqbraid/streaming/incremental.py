"""Collapse a stream of reads: counts, ids and first records merge batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqbraid.plans.shared import new_path
from seqbraid.sources.reads import normalize


def collapse_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append (batch, seq, cnt, first_read_id) of each micro-batch of (read_id, seq, cnt) to Parquet.

    A batch that is run again overwrites its own folder, so nothing is counted twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = batch.groupBy("seq").agg(F.sum("cnt").alias("cnt"), F.min("read_id").alias("first_read_id"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(seq, cnt, first_read_id) over all batches so far."""
    parts = spark.read.schema("seq string, cnt long, first_read_id long, batch int").parquet(path)
    return parts.groupBy("seq").agg(F.sum("cnt").alias("cnt"), F.min("first_read_id").alias("first_read_id"))


def collapse_files(spark: SparkSession, folder: str, schema: str, seq: str, read_id: str) -> DataFrame:
    """Stream the Parquet files of a folder or path through ``collapse_stream`` until it has read them all."""
    out = new_path(spark, "stream")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    reads = source.select(F.expr(read_id).cast("long").alias("read_id"), F.expr(seq).alias("seq"), F.lit(None).cast("string").alias("seq2"), F.lit(1).cast("long").alias("cnt"))
    query = collapse_stream(normalize(reads), f"{out}/batches", f"{out}/checkpoint")
    query.awaitTermination()
    return merged(spark, f"{out}/batches")
