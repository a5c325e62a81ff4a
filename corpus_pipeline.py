"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's `docs`. All but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import bpe, linededup, minhash, mixing, rules
from sigloom.plans.session import dealt, ship
from sigloom.plans.stage import release_since, staged, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of tokens. All clean tokens are asked for; the shares of the others are upper bounds. No document is repeated.
WEIGHTS = {"clean": 0.92, "poor": 0.055, "toxic": 0.025}
SPACE = r"\x20\x09-\x0D"
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _documents(rules.reject(dealt(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses lines and has too few words for the rules before this stage then goes; all others stay."""
    ship(spark)
    done = linededup.dedup_lines(dealt(docs))
    enough = F.col("text").rlike(rf"^[{SPACE}]*([^{SPACE}]+[{SPACE}]+){{{rules.MIN_WORDS - 1}}}[^{SPACE}]")
    return _documents(done.where((F.col("n_dropped") == 0) | enough))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.dedup(dealt(docs)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(dealt(docs), labels, WEIGHTS, whole="clean").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    done = bpe.encode(dealt(docs).select(*COLUMNS), RANK_FILE, public_tokenizers.PATTERN, bytes_col="decoded")
    return done.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The mixing classifier is a trained model, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = tables()
        done = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_since(before, done)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
