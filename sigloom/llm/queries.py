"""Queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.plans.session import dealt

from . import bpe, fingerprint, htmlx, langid, linededup, minhash, mixing, quality, repair, rules, spelling, substring, urlfilter
from .stage import staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(documents, _table(spark, sf_dir, "labels")).drop("stats")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.drop("host", "row", "keys")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.edits(_table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Target shares of tokens by domain.
MIXTURE = {"clean": 0.92, "poor": 0.06, "toxic": 0.02}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known, domains = mixing.posteriors(documents, mixing.quality_domains(_table(spark, sf_dir, "labels")))
    rated = mixing.rates(known, mixing.fit(known, domains, MIXTURE))
    doc_id = F.nullif(F.col("doc"), F.lit(mixing.NO_ID))
    return rated.select(doc_id.alias("doc_id"), "n_tokens", *(F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate")


def op5_url_filter(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """`listed`: the URLs to block (column url, any form). The tables have none; without it, `urlfilter.listed_pages` makes one."""
    pages = _table(spark, sf_dir, "pages")
    if listed is None:
        listed = urlfilter.listed_pages(pages, _table(spark, sf_dir, "benchmark"))
    else:
        listed = listed.select(urlfilter.canonical(F.col("url")).alias("url"))
    return urlfilter.judge(pages.select("page_id", "url"), staged(listed, "listed")).drop("url")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlx.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), with_runs=False).drop("runs")


def op9_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    return bpe.digest(_table(spark, sf_dir, "documents"), rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.digest(rows, repair.summaries(repair.repair(repair.damaged(rows))))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents").select("doc_id", "text"), slip=spelling.SLIP)


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_quality_rules": op2_quality_rules,
        "op3_fingerprints": op3_fingerprints,
        "op4_mixing": op4_mixing,
        "op5_url_filter": op5_url_filter,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_language_id": op8_language_id,
        "op9_bpe": op9_bpe,
        "op10_line_dedup": op10_line_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": rules.ORACLE,
        "op5_url_filter": urlfilter.ORACLE,
        "op6_minhash_dedup": minhash.SQL,
        "op10_line_dedup": linededup.ORACLE,
        "op11_conversation_repair": repair.ORACLE,
        "op12_substring_dedup": substring.ORACLE,
        "op13_spelling_variants": spelling.ORACLE,
    }
