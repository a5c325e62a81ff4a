"""Sample metadata: (colour, sample_name, deleted). Colours are 0, 1, ... in order of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.plans.stage import staged

# The name that a deleted sample shows, and what a merge appends to a name that exists.
DELETED_NAME = "D3L3T3D"
DUPLICATE_SUFFIX = "_duplicate_in_merge"
SCHEMA = "colour int, sample_name string, deleted boolean"


def assign(names: DataFrame, order: list[str], first: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Samples with colours first, first+1, ... in the given order, and the columns to keep.

    Names are numbered inside range partitions; only the partitions' sizes (one row per task) meet on the driver.
    """
    spark = names.sparkSession
    ranged = staged(names.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "names")
    starts, at = [], first
    for row in ranged.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row["_part"], at))
        at += row["count"]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_nth", inside).join(F.broadcast(spark.createDataFrame(starts, "_part int, _start long")), "_part")
    return placed.select((F.col("_start") + F.col("_nth")).cast("int").alias("colour"), "sample_name", F.lit(False).alias("deleted"), *(keep or []))


def validate(new: DataFrame, existing: DataFrame | None = None) -> None:
    """Raises ValueError for an empty, reserved, repeated or existing name; a deleted sample's name still exists."""
    names = new.select("sample_name")
    bad = names.where(F.coalesce(F.col("sample_name"), F.lit("")).isin("", DELETED_NAME)).limit(1).collect()
    if bad:
        raise ValueError(f"a sample cannot have the name {bad[0][0]!r}")
    every = names if existing is None else names.unionByName(existing.select("sample_name"))
    again = every.groupBy("sample_name").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"two samples cannot have the same name: {again[0][0]!r}")


def count(samples: DataFrame) -> int:
    """Number of colours, deleted ones included."""
    return samples.agg(F.coalesce(F.max("colour") + 1, F.lit(0))).first()[0]


def delete(samples: DataFrame, name: str) -> DataFrame:
    if samples.where((F.col("sample_name") == name) & ~F.col("deleted")).limit(1).count() == 0:
        raise ValueError(f"no sample {name!r}")
    return samples.withColumn("deleted", F.col("deleted") | (F.col("sample_name") == name))


def to_colours(names: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_name, colour of the names that exist and are not deleted."""
    return names.join(samples.where(~F.col("deleted")).select("sample_name", "colour"), "sample_name")


def to_names(colours: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows of `colours` with sample_name; a deleted sample shows the reserved name."""
    shown = samples.select("colour", F.when(F.col("deleted"), F.lit(DELETED_NAME)).otherwise(F.col("sample_name")).alias("sample_name"))
    return colours.join(shown, "colour")


def exists(names: DataFrame, samples: DataFrame) -> DataFrame:
    return names.join(samples.select("sample_name"), "sample_name", "left_semi")


def merge(left: DataFrame, right: DataFrame, num_left: int) -> DataFrame:
    """Both tables; right colours are shifted, and a right name that exists on the left gets a suffix.

    A deleted sample stays deleted. Names that would then still repeat raise ValueError before anything is written.
    """
    known = left.select("sample_name", F.lit(True).alias("known"))
    moved = right.join(known, "sample_name", "left").select(
        (F.col("colour") + num_left).cast("int").alias("colour"),
        F.when(F.col("known"), F.concat("sample_name", F.lit(DUPLICATE_SUFFIX))).otherwise(F.col("sample_name")).alias("sample_name"),
        "deleted",
    )
    both = left.select("colour", "sample_name", "deleted").unionByName(moved)
    again = both.groupBy("sample_name").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"a sample of that name was merged before: {again[0][0]!r}")
    return both
