"""Intermediate tables in the folder that all executors share.

`staged` cuts lineage by writing Parquet under the folder that the cluster names in spark.checkpoint.dir, so that a lost
executor costs a re-read and not a re-run. The setting is read from the session; where it is unset, a folder under
the warehouse is used on a local master, and any other master is refused. `release` removes a table that is no longer read;
what is left is removed when the driver ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/sigloom-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # No _SUCCESS file: nothing reads it, and where the folder is local Hadoop starts two more children of the driver for it.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes staged tables; only for those that nothing will read again."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path in _made:
            _remove(_made.pop(path), path)


def tables() -> frozenset[str]:
    """The staged tables that are there now."""
    return frozenset(_made)


def release_since(before: frozenset[str], *keep: DataFrame) -> None:
    """Removes the tables staged since `before`, except `keep`; only where nothing will read them again."""
    kept = {getattr(df, "_staged_path", None) for df in keep}
    for path in [p for p in _made if p not in before and p not in kept]:
        _remove(_made.pop(path), path)
