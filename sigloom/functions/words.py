"""Bit vectors as 64-bit words: bit i of a vector is bit i % 64 of word i // 64; a missing word is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_of(bit: Column) -> Column:
    return F.floor(bit / 64).cast("int")


def mask_of(bit: Column) -> Column:
    """The word with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))


def bit_at(words: Column, bit: Column) -> Column:
    return F.bit_get(words, F.pmod(bit, F.lit(64)).cast("int"))


def set_bit(words: Column, bit: Column) -> Column:
    return words.bitwiseOR(mask_of(bit))


def clear_bit(words: Column, bit: Column) -> Column:
    return words.bitwiseAND(F.bitwise_not(mask_of(bit)))


def positions(word_no: Column, bits: Column) -> Column:
    """Set positions of one word, ascending."""
    found = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(bits, i) == 1)
    return F.transform(found, lambda i: word_no * 64 + i)


def pack(df: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """keys, word_no, bits from one row per set bit; repeats are harmless."""
    return df.groupBy(*keys, word_of(F.col(bit)).alias("word_no")).agg(F.bit_or(mask_of(F.col(bit))).alias("bits"))


def unpack(df: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """One row per set bit."""
    return df.select(*keys, F.explode(positions(F.col("word_no"), F.col("bits"))).alias(bit))
