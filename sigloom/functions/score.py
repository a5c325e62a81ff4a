"""Alignment-style statistics of a presence string (one 0 or 1 for each k-mer of a query, in order)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the statistics.
LAMBDA, K, MISMATCH, KMER, ADJUST = 1.330, 0.621, 2, 31, 3
SNP_SHARE = 0.05

FIELDS = (
    "score double, min_score double, max_score double, mismatches int, min_mismatches int, max_mismatches int, nident int, min_nident int, max_nident int, "
    "pident double, min_pident double, max_pident double, length int, evalue double, pvalue double, log_evalue double, log_pvalue double"
)
NAMES = tuple(x.split()[0] for x in FIELDS.split(", "))


def without_short_runs(presence: Column) -> Column:
    """Each position is 1 only if it and the next two are; positions after the end count as 1."""
    padded = F.concat(presence, F.lit("11"))
    kept = F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(presence)), lambda i: F.when(F.substring(padded, i, F.lit(3)) == "111", "1").otherwise("0")), "")
    return F.when(F.char_length(presence) < 3, presence).otherwise(kept)


def runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, run_no, symbol, counted: runs of equal characters; every run but a string's last counts one more."""
    found = F.regexp_extract_all(F.col(text), F.lit("(0+|1+)"), F.lit(1))
    rows = df.select(key, F.size(found).alias("n"), F.posexplode(found).alias("run_no", "run"))
    return rows.select(key, "run_no", F.substring("run", 1, 1).alias("symbol"), (F.char_length("run") + F.when(F.col("run_no") < F.col("n") - 1, 1).otherwise(0)).alias("counted"))


def evalue(score: Column, length: Column, db_size: Column) -> Column:
    return F.lit(K) * db_size * length * F.exp(F.lit(-LAMBDA) * score)


def pvalue(value: Column) -> Column:
    return 1 - F.exp(-value)


def bitscore(score: Column) -> Column:
    return (F.lit(LAMBDA) * score - math.log(K)) / math.log(2)


def _log_evalue(score: float, length: int, db_size: int) -> float:
    return round(math.log10(K * max(db_size, 1) * length) - LAMBDA * score, 2)


def _log_pvalue(log_value: float) -> float:
    p = 1 - math.exp(-(10**log_value)) if log_value < 300 else 1.0
    return round(math.log10(p), 2) if p > 0 else round(log_value, 2)


def statistics(presence: str, db_size: int, kmer: int = KMER) -> tuple:
    """The values of NAMES. The scores are a fold over the zero runs that rounds at each step, so order matters."""
    text = presence if len(presence) < 3 else "".join("1" if (presence + "11")[i : i + 3] == "111" else "0" for i in range(len(presence)))
    parts = re.findall("0+|1+", text)
    counted = [(p[0], len(p) + (i < len(parts) - 1)) for i, p in enumerate(parts)]
    length = len(text) + kmer - 1
    ones = sum(n for s, n in counted if s == "1")
    span = kmer + ADJUST
    best = worst = middle = float(ones)
    fewest = most = 0.0
    for symbol, n in counted:
        if symbol == "1":
            continue
        low = n / span
        high = max(n - span + 1, low)
        mid = low + SNP_SHARE * high
        fewest, most = fewest + low, most + high
        best = round(best - MISMATCH * low + (n - MISMATCH * low), 2)
        worst = round(worst - MISMATCH * high + (n - MISMATCH * high), 2)
        middle = round(middle - MISMATCH * mid + (n - MISMATCH * mid), 2)
    scale = length / len(text)
    score, low_score, high_score = (round(x * scale, 2) for x in (middle, worst, best))
    least, top = math.floor(fewest), math.ceil(most)
    likely = math.ceil(math.ceil(fewest) + SNP_SHARE * math.floor(most))
    same, fewest_same, most_same = length - likely, length - top, length - least
    try:
        e = K * db_size * length * math.exp(-LAMBDA * score)
    except OverflowError:
        e = math.inf
    p = 1 - math.exp(-e)
    log_e = _log_evalue(score, length, db_size)
    return (score, low_score, high_score, likely, least, top, same, fewest_same, most_same, *(100.0 * x / length for x in (same, fewest_same, most_same)), length, e, p, log_e, _log_pvalue(log_e))


def score_presence(presence: Column, db_size: Column) -> Column:
    """Struct of NAMES; null for a null or empty string."""

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sizes in batches:
            rows = [statistics(t, int(d)) if t else (None,) * len(NAMES) for t, d in zip(texts, sizes, strict=True)]
            frame = pd.DataFrame(rows, columns=list(NAMES))
            whole = ("mismatches", "min_mismatches", "max_mismatches", "nident", "min_nident", "max_nident", "length")
            yield frame.astype({c: "Int32" for c in whole})

    return run(presence, db_size)
