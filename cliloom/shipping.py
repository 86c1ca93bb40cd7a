"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, where the session leaves it at Spark's default of 10,000: whole texts travel in these batches.
_ROWS, _ROWS_KEY = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for each Spark context."""
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, _ROWS)
    context = spark.sparkContext
    if not getattr(context, "_cliloom_shipped", False):
        top = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="cliloom-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        context.addPyFile(path)
        context._cliloom_shipped = True
    return spark
