"""MurmurHash3 x86 32 with any seed, as column expressions.

Spark's own `hash` is this function with seed 42, but it treats the last bytes of a string that do not fill a
word in its own way, and its seed cannot be given. Two facts make it usable all the same:

* `hash(x, s)` hashes s with the hash of x as seed, and the hash of an integer is a bijection, so there is one x for
  which the seed becomes what is wanted (`_opener`).
* The last step is a bijection too: it is undone for the whole words of the string, the last bytes are mixed in as the
  algorithm has it, and the last step is done again.

So hashing stays inside generated code. Products modulo 2**32 are made of 16-bit halves, which never overflow a BIGINT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm.
C1, C2, ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 32)


def _opener(seed: int) -> int:
    """The INT whose hash under Spark's seed 42 is `seed`."""
    h = seed & MASK
    h ^= h >> 16
    h = h * _inverse(F2) & MASK
    h ^= h >> 13 ^ h >> 26
    h = h * _inverse(F1) & MASK
    h ^= h >> 16
    h ^= 4
    h = (h - ADD) * _inverse(5) & MASK
    h = (h >> 13 | h << 19) & MASK
    k = (h ^ 42) * _inverse(C2) & MASK
    k = (k >> 15 | k << 17) & MASK
    k = k * _inverse(C1) & MASK
    return k - (1 << 32) if k >> 31 else k


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, for x in 0..2**32-1."""
    high = F.shiftleft((x * (factor >> 16)).bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16)
    return (x * (factor & 0xFFFF) + high).bitwiseAND(F.lit(MASK))


def _fold(x: Column, *bits: int) -> Column:
    out = x
    for b in bits:
        out = out.bitwiseXOR(F.shiftrightunsigned(x, b))
    return out


# Each step is a projection of its own: a step names its input two or three times, and nested steps would double the
# expression at each level. The optimiser keeps such projections apart, and one generated function runs them all.
_TAIL_STEPS = (
    lambda t: _times(t, C1),
    lambda t: F.shiftleft(t, 15).bitwiseOR(F.shiftrightunsigned(t, 17)).bitwiseAND(F.lit(MASK)),
    lambda t: _times(t, C2),
)
_UNDO_STEPS = (
    lambda h: _fold(h, 16),
    lambda h: _times(h, _inverse(F2)),
    lambda h: _fold(h, 13, 26),
    lambda h: _times(h, _inverse(F1)),
    lambda h: _fold(h, 16),
)
_DO_STEPS = (
    lambda h: _fold(h, 16),
    lambda h: _times(h, F1),
    lambda h: _fold(h, 13),
    lambda h: _times(h, F2),
    lambda h: _fold(h, 16),
)


def _last_byte(data: Column, n: Column, i: int, plain: Column) -> Column:
    """Byte i after the last whole word, at its place in a little-endian number; 0 beyond the end."""
    one = F.substring(data, n - n.bitwiseAND(F.lit(3)) + F.lit(i + 1), F.lit(1))
    value = F.when(plain, F.ascii(one.cast("string"))).otherwise(F.conv(F.hex(one), 16, 10)).cast("bigint")
    return F.when(n.bitwiseAND(F.lit(3)) > i, F.shiftleft(value, 8 * i)).otherwise(F.lit(0).cast("bigint"))


def with_murmur3(df: DataFrame, text: str, seeds: Sequence[int], names: Sequence[str]) -> DataFrame:
    """df with a BIGINT column for each seed: the signed 32-bit hash of the UTF-8 bytes of `text`; null for null."""
    n, data = F.col("_mm_n"), F.col(text).cast("binary")
    plain = F.char_length(text) == n
    out = df.withColumn("_mm_n", F.octet_length(text))
    tail = _last_byte(data, n, 0, plain).bitwiseOR(_last_byte(data, n, 1, plain)).bitwiseOR(_last_byte(data, n, 2, plain))
    whole = F.substring(data, F.lit(1), n - n.bitwiseAND(F.lit(3)))
    out = out.withColumns({"_mm_t": tail, **{c: F.hash(F.lit(_opener(seed)), whole).cast("bigint").bitwiseAND(F.lit(MASK)) for c, seed in zip(names, seeds, strict=True)}})
    for step in _TAIL_STEPS:
        out = out.withColumn("_mm_t", step(F.col("_mm_t")))
    for step in _UNDO_STEPS:
        out = out.withColumns({c: step(F.col(c)) for c in names})
    # The lengths: that of the whole words comes off, that of the string goes on.
    lengths = n.bitwiseXOR(n - n.bitwiseAND(F.lit(3))).cast("bigint")
    out = out.withColumns({c: F.col(c).bitwiseXOR(F.col("_mm_t")).bitwiseXOR(lengths) for c in names})
    for step in _DO_STEPS:
        out = out.withColumns({c: step(F.col(c)) for c in names})
    signed = {c: F.when(F.col(text).isNotNull(), F.col(c) - F.when(F.col(c) >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))) for c in names}
    return out.withColumns(signed).drop("_mm_n", "_mm_t")


def with_rows(df: DataFrame, kmer: str, h: int, m: int, name: str = "rows") -> DataFrame:
    """df with the distinct Bloom rows (0..m-1) of a k-mer under seeds 0..h-1; 1 to h of them.

    Take them apart with explode_outer: the filter that the optimiser infers from a plain explode would be pushed
    through all steps and doubled at each.
    """
    names = [f"_mm_{i}" for i in range(h)]
    out = with_murmur3(df, kmer, range(h), names)
    return out.withColumn(name, F.array_distinct(F.array(*(F.pmod(F.col(c), F.lit(m).cast("bigint")).cast("int") for c in names)))).drop(*names)
