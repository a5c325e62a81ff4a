"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A fingerprint is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (five words,
A-Z lower-cased; with fewer words the whole sequence; none without words). Sketches of parts merge into the
sketch of the whole (`merge`, and `merge_groups` for any number of rows of a key); from sketches follow
resemblance, containment and the number of distinct shingles. Sets of at most k shingles are exact.

`edits` pairs every document with the next one in descending id. The order is found on ids alone: they are
range-partitioned, numbered inside each range, and the ends of the ranges (one row per task) are tied on the
driver. Each text then crosses the network once, and its head once more.

Defined cases: a null text is empty; an empty text has an empty sketch, which is like another empty one (1.0)
and unlike any other (0.0). Rows without an id come last; rows of one id are ordered by a hash of their text;
repeated rows are one place in the order and each is returned. One document follows itself. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

K = 128
WIDTH = 5
NO_ID = -(1 << 63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes of a text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def rolled(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return F.array_distinct(_let(F.transform(words, lambda w: F.xxhash64(w)), rolled))


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the smallest hashes of the union that both sides hold."""
    def of(union: Column) -> Column:
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))

    return _let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Number of distinct shingles; exact below k."""
    top = F.element_at(a, -1).cast("double")
    share = (top + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b holds; 1.0 for an empty a."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.hex(x)), "-")


def merge_groups(df: DataFrame, key: str, column: str, k: int = K, fan_in: int = 64) -> DataFrame:
    """key, column: the merged sketch of each key.

    Merges at most about fan_in sketches in one place, level by level, so the sketches of a key that
    holds most rows are never gathered in one task.
    """
    rows = df.select(F.col(key).alias("_fp_key"), F.col(column).alias("_fp_sketch"))
    most = rows.groupBy("_fp_key").count().agg(F.max("count")).first()[0] or 1
    parts = most
    while parts > 1:
        parts = -(-parts // fan_in)
        salt = F.pmod(F.xxhash64("_fp_sketch", F.rand(7)), F.lit(parts))
        gathered = rows.groupBy("_fp_key", salt.alias("_fp_part")).agg(F.flatten(F.collect_list("_fp_sketch")).alias("x"))
        rows = staged(gathered.select("_fp_key", F.slice(F.sort_array(F.array_distinct("x")), 1, k).alias("_fp_sketch")), "sketches")
    return rows.select(F.col("_fp_key").alias(key), F.col("_fp_sketch").alias(column))


def _order(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """doc, row, before_doc, before_row, before_chars of each distinct row; whether rows repeat."""
    spark = keyed.sparkSession
    ids = keyed.groupBy("doc", "row").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, F.col("doc").desc(), F.col("row").desc()).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "order")
    ends = ranged.groupBy("part").agg(F.max(F.struct("doc", "row")).alias("head"), F.max("copies").alias("copies")).orderBy("part").collect()
    heads = [(e["part"], ends[(i + 1) % len(ends)]["head"]["doc"], ends[(i + 1) % len(ends)]["head"]["row"]) for i, e in enumerate(ends)]
    after_end = spark.createDataFrame(heads, "part int, end_doc long, end_row long")
    window = Window.partitionBy("part").orderBy(F.col("doc").desc(), F.col("row").desc())
    nexts = ranged.withColumns({"next_doc": F.lead("doc").over(window), "next_row": F.lead("row").over(window)})
    nexts = nexts.join(F.broadcast(after_end), "part")
    edge = F.col("next_row").isNull()
    links = nexts.select(
        F.when(edge, F.col("end_doc")).otherwise(F.col("next_doc")).alias("doc"),
        F.when(edge, F.col("end_row")).otherwise(F.col("next_row")).alias("row"),
        F.col("doc").alias("before_doc"), F.col("row").alias("before_row"), F.col("n_chars").alias("before_chars"),
    )
    return links, any(e["copies"] > 1 for e in ends)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text, n_chars, edited, sketch, edited_sketch, next_sketch of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    links, repeats = _order(keyed.select("doc", "row", F.char_length("text").cast("long").alias("n_chars")))
    # Both uses of `own` read the same three columns, so the texts are shuffled once and the exchange is reused.
    own = keyed.select("doc", "row", "text").repartition("doc", "row")
    heads = own.join(links, ["doc", "row"]).select(
        F.col("before_doc").alias("doc"), F.col("before_row").alias("row"),
        F.expr("left(text, cast(before_chars div 3 as int))").alias("head"), sketch(F.col("text"), k).alias("next_sketch"),
    )
    if repeats:
        heads = heads.dropDuplicates(["doc", "row"])
    n = F.char_length("text")
    paired = own.join(heads, ["doc", "row"]).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - char_length(text) div 3)"), F.col("head")))
    doc_id = F.nullif(F.col("doc"), F.lit(NO_ID))
    return paired.select(doc_id.alias("doc_id"), "text", n.cast("long").alias("n_chars"), "edited", sketch(F.col("text"), k).alias("sketch"), sketch(F.col("edited"), k).alias("edited_sketch"), "next_sketch")


def digest(edited: DataFrame, k: int = K) -> DataFrame:
    s, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), to_text(s).alias("fingerprint"), to_text(e).alias("edited_fingerprint"),
        resemblance(s, e, k).alias("near_edited"), resemblance(s, x, k).alias("near_next"),
    )
