"""FASTA records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(text: DataFrame, *keep: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = F.split(plain, "\n", 2)
    body = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), "\\s", "")
    return text.where(F.trim("value") != "").select(*keep, F.trim(F.get(parts, 0)).alias("header"), body.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """query_id, header, seq of every record; a record may have many lines. Ids rise with file and position."""
    text = spark.read.option("lineSep", "\n>").text(path)
    return _records(text).withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "header", "seq")


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq of every record."""
    text = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("path"))
    return _records(text, "path").select("path", "seq")


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that arrive in a directory; the id is a hash of header and sequence."""
    text = spark.readStream.option("lineSep", "\n>").text(path)
    return _records(text).withColumn("query_id", F.xxhash64("header", "seq")).select("query_id", "header", "seq")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_name from tab-separated lines without a header; n is the line's place."""
    rows = spark.read.csv(path, sep="\t", schema="path string, sample_name string")
    return rows.withColumn("n", F.monotonically_increasing_id())
