"""Tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table under
``spark.checkpoint.dir`` and reading it again.  A lost executor then costs the
tasks it ran and nothing that is already written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: About 50 MB in memory.
BROADCAST_ROWS = 1_000_000

_RUN = uuid.uuid4().hex
_OWN: dict[str, str] = {}
_USED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one if none is set.

    A session on a cluster without ``spark.checkpoint.dir`` is an error: a folder
    of one machine would lose its files with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="seqbraid-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = f"{shared_dir(spark)}/seqbraid-{_RUN}"
    if not _USED:
        atexit.register(_forget)
    _USED.add(folder)
    return f"{folder}/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_shared_path"] = path
    return out


def bounded(table: DataFrame) -> DataFrame:
    """``table``, a materialized one of a few numbers or digests a row, to be broadcast if it has at most BROADCAST_ROWS rows.

    Beyond that a join with it is whatever Spark plans.
    """
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave, once all that reads them is written."""
    for table in tables:
        _delete(table.sparkSession, table.__dict__.pop("_shared_path"))


def _forget() -> None:
    """At the end of the process: its tables are of no further use."""
    spark = SparkSession.getActiveSession()
    for folder in _USED:
        if spark is not None:
            try:
                _delete(spark, folder)
                continue
            except Exception:  # the JVM may be gone already
                pass
        if folder.startswith(("/", "file:")):
            shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables this process wrote; results still to be read go too."""
    _delete(spark, f"{shared_dir(spark)}/seqbraid-{_RUN}")
