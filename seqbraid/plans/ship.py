"""Send this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: What goes to a Python worker at once, unless the session says otherwise: whole texts may be long.
AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: How many times longer tables of numbers are in memory than in their files, unless the session says otherwise.  By
#: the files' own size Spark would broadcast tables of 100 MB and more, each of which the driver holds twice.
SIZES = {"spark.sql.sources.fileCompressionFactor": "8"}


def true_sizes(spark: SparkSession) -> None:
    """What decides whether a file's table is broadcast is about its size in memory."""
    for name, value in SIZES.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)


def ensure(spark: SparkSession) -> None:
    """Add the package's sources to the application, once; Spark serves them to every executor."""
    context = spark.sparkContext
    for name, value in AT_ONCE.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="seqbraid-")) / "seqbraid.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "seqbraid").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
