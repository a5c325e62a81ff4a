"""Filter files: the raw bits of one sample's filter, first bit highest in a byte, padded to whole bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.sources import binary


class Filters(binary.Format):
    """A record is a byte; a row is a set bit."""

    name = "sigloom_filters"
    columns = {"path": "string", "row_index": "long"}

    @staticmethod
    def layout(head: bytes) -> binary.Layout:
        return binary.Layout(0, 1)

    @staticmethod
    def decode(path: str, head: bytes, n: int, data: bytes, wanted: list[str]) -> dict[str, pa.Array]:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) + 8 * n
        return {"path": pa.DictionaryArray.from_arrays(np.zeros(len(at), np.int32), [path]).cast(pa.string()), "row_index": pa.array(at, pa.int64())}


def read_filters(spark: SparkSession, paths: str | list[str], m: int) -> DataFrame:
    """path, row_index; padding bits beyond m are left out."""
    return binary.read(spark, Filters, paths).where(F.col("row_index") < m).select("path", F.col("row_index").cast("int").alias("row_index"))


def packed(bloom: DataFrame, key: str, m: int) -> DataFrame:
    """key, content: the file of each sample from (key, row_index). A filter has a fixed size, m bits."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((m + 7) // 8 * 8, bool)
        bits[pdf["row_index"].to_numpy()] = True
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [np.packbits(bits).tobytes()]})

    kind = bloom.schema[key].dataType.simpleString()
    return bloom.select(key, "row_index").distinct().groupBy(key).applyInPandas(one, f"`{key}` {kind}, content binary")


def write_filters(bloom: DataFrame, key: str, m: int, directory: str) -> None:
    """One file for each sample, through Spark's file systems, as `<directory>/<key>=<sample>/...bin` content rows."""
    packed(bloom, key, m).write.mode("overwrite").partitionBy(key).parquet(directory)


def write_raw(bloom: DataFrame, key: str, m: int, directory: str) -> None:
    """One raw file for each sample, `<directory>/<sample>.bloom`; all appear, or none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield f"{name}.bloom", iter([content.as_buffer()])

    binary.write(packed(bloom, key, m).select(F.col(key).cast("string"), "content"), directory, encode)


def write_file(bloom: DataFrame, m: int, path: str) -> None:
    """The raw file of one sample (row_index) through Spark's file systems; the filter, of m bits, meets in one place."""
    spark = bloom.sparkSession
    rows = packed(bloom.select(F.lit("one").alias("sample"), "row_index"), "sample", m).collect()
    content = bytes(rows[0]["content"]) if rows else bytes((m + 7) // 8)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
