"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of a batch for Python workers where the session has Spark's default: rows here are texts, some of them long.
BATCH_ROWS = "2000"
BATCH_KEY, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors of this application, once; Spark's file server delivers it."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="sigloom-"), "sigloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """A table read in fewer parts than there are cores, as a file of one row group is, dealt over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
