"""k-mers, hashing, bit words and sizing."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.functions import kmers as km
from sigloom.functions import murmur, params, words


def plain_murmur(data: bytes, seed: int) -> int:
    mask, h, n = 0xFFFFFFFF, seed, len(data)

    def scramble(k):
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    for i in range(0, n - n % 4, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if n % 4:
        h ^= scramble(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_row_goldens(spark):
    df = spark.createDataFrame([("ATT",)], "e string")
    for (h, m), wanted in {(3, 25): {2, 15, 17}, (1, 25): {15}, (2, 50): {15, 27}}.items():
        assert set(murmur.with_rows(df, "e", h, m).first()["rows"]) == wanted


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="ACGTNé日 x", max_size=40), min_size=1, max_size=30), seed=st.integers(0, 2**31 - 1))
def test_murmur_is_the_algorithm(spark, texts, seed):
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    for row in murmur.with_murmur3(df, "e", [0, seed], ["a", "b"]).collect():
        assert (row["a"], row["b"]) == (plain_murmur(row["e"].encode(), 0), plain_murmur(row["e"].encode(), seed))


def test_kmers_of_long_short_and_null_sequences(spark):
    texts = ["ACGTN" * 400, "AC", "ACG", "", None]
    for row in spark.createDataFrame([(t,) for t in texts], "s string").select("s", km.kmers(F.col("s"), 3).alias("k")).collect():
        s = row["s"] or ""
        assert row["k"] == [s[i : i + 3] for i in range(len(s) - 2)]


def test_codec_round_trip_and_edges(spark):
    kmer = "ACACAAACCATGGCCGGACGCAGCTTTCTGA"
    row = spark.createDataFrame([(kmer, 147)], "k string, e int").select(
        km.decode(km.encode(F.col("k")), 31).alias("d"), km.canonical(F.col("k")).alias("c"), km.text_bits(F.lit("AGCT")).alias("b"),
        km.edge_bases(F.col("e"), True).alias("f"), km.edge_bases(F.col("e"), False).alias("r"), km.edge_text(F.col("e")).alias("t"),
    ).first()
    assert (row["d"], row["b"], row["f"], row["r"], row["t"]) == (kmer, "00011011", ["A", "C"], ["T", "A"], "a..tAC..")
    assert row["c"] == min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))
    with pytest.raises(Exception, match="complement"):
        spark.createDataFrame([("ACN",)], "k string").select(km.reverse_complement_strict(F.col("k"))).collect()


def test_words_round_trip(spark):
    bits = [(1, 0), (1, 63), (1, 64), (2, 200), (2, 200)]
    df = spark.createDataFrame(bits, "k int, b int")
    packed = words.pack(df, ["k"], "b")
    assert sorted(tuple(r) for r in words.unpack(packed, ["k"], "b").collect()) == sorted(set(bits))
    one = spark.createDataFrame([(5,)], "w long").select(words.set_bit(F.col("w"), F.lit(63)).alias("s"), words.clear_bit(F.col("w"), F.lit(64)).alias("c"), words.bit_at(F.col("w"), F.lit(2)).alias("g")).first()
    assert (one["s"], one["c"], one["g"]) == (5 - 2**63, 4, 1)


def test_sizing():
    assert params.chunk_plan(10, 25_000_000, 10**8) == (3, 3)
    assert params.chunk_plan(10, 25_000_000, 10**9) == (10, 1)
    assert params.parse_size("20GB") == 20 * 10**9 and params.parse_size("1.5 MiB") == int(1.5 * 2**20)
    with pytest.raises(ValueError):
        params.parse_size("many")


def test_false_positive_rate(spark):
    row = spark.range(1).select(params.false_positive_rate(F.lit(3.0), F.lit(1e7), F.lit(25e6)).alias("r"), params.hash_count_direct(F.lit(1e-6), F.lit(1e3), F.lit(50), F.lit(31)).alias("h")).first()
    assert math.isclose(row["r"], 0.3412, abs_tol=5e-5) and row["h"] == 2
