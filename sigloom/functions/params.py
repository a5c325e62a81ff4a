"""Sizing of Bloom filters and of chunked builds: plain formulas, on numbers or on columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)


def kmer_rate(q_max: Column, n: Column, length: Column, k: Column) -> Column:
    """Largest false positive rate of one k-mer for at most q_max false hits among n samples."""
    return F.pow(q_max / n, F.lit(1.0) / (length - k + 1))


def filter_bits(k_max: Column, rate: Column) -> Column:
    return -k_max * F.log(rate) / F.lit(LN2**2)


def hash_count(rate: Column) -> Column:
    return F.ceil(-F.log(rate) / F.lit(LN2))


def filter_bits_direct(q_max: Column, n: Column, length: Column, k: Column, k_max: Column) -> Column:
    return -k_max * F.log(q_max / n) / ((length - k + 1) * F.lit(LN2**2))


def hash_count_direct(q_max: Column, n: Column, length: Column, k: Column) -> Column:
    return F.ceil(-F.log(q_max / n) / ((length - k + 1) * F.lit(LN2)))


def false_positive_rate(h: Column, n: Column, m: Column) -> Column:
    """Of a filter of m bits with n elements and h hashes."""
    return F.pow(1 - F.exp(-h * n / m), h)


def filter_bytes(m: Column) -> Column:
    """Memory model of one filter while an index is built."""
    return m * 9 / 8


def chunk_plan(n: int, m: int, max_bytes: int) -> tuple[int, int]:
    """Filters per chunk and number of chunks for n filters of m bits."""
    chunks = math.ceil(n * m * 9 / 8 / max_bytes)
    return n // chunks, chunks


def chunk_bytes(n: int, m: int, chunks: int) -> int:
    """Memory with which n filters of m bits are built in so many chunks."""
    return math.ceil(n * m * 9 / 8 / chunks)


# Decimal and binary multiples of a byte.
_MULTIPLES = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50}


def parse_size(text: str) -> int:
    """Bytes of a size such as 20GB, 1.5 MiB or 300."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*([kmgtp]i?)?(?:b|bytes?)?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * _MULTIPLES[found[2] or ""])
