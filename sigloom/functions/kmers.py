"""k-mer expressions: Spark column expressions, but for `counts`, which looks at the k-mers of a text in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import windows
from sigloom.plans.stage import staged

#: Start positions per chunk, outer and inner: a substring of a UTF-8 string is found by a scan from its start.
CHUNKS = (4096, 64)
#: Start positions of the pieces that become rows of their own, so no array holds the k-mers of a long sequence.
SPANS = (1 << 22, 1 << 16)
#: Characters of a text whose k-mers one task counts at once.
WHOLE = 1 << 17

# The two orders of bases that the file format and the text form of a k-mer use.
ALPHABET = "ACGT"
TEXT_BITS = {"A": "00", "G": "01", "C": "10", "T": "11"}


def _chunks(text: Column, size: int, k: int) -> Column:
    """Pieces of a text of at least k characters that have `size` start positions each; they overlap by k-1."""
    last = F.floor((F.char_length(text) - F.lit(k)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.substring(text, c * size + 1, F.lit(size + k - 1)))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order, with repeats; empty for a null or shorter sequence."""

    def of_chunk(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(text) - F.lit(k - 1)), lambda i: F.substring(text, i, F.lit(k)))

    outer, inner = CHUNKS
    every = F.flatten(F.transform(_chunks(seq, outer, k), lambda text: F.flatten(F.transform(_chunks(text, inner, k), of_chunk))))
    return F.when(F.char_length(seq) >= k, every).otherwise(F.array().cast("array<string>"))


def reverse_complement(seq: Column) -> Column:
    """Other characters than A, C, G and T stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_complement_strict(seq: Column) -> Column:
    """Fails the query on a character outside A, C, G and T."""
    valid = F.assert_true(seq.rlike("^[ACGT]*$"), F.lit("only A, C, G and T have a complement"))
    return F.when(valid.isNull(), reverse_complement(seq))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def text_bits(kmer: Column) -> Column:
    """Two characters 0 or 1 for each base."""
    out = kmer
    for base, bits in TEXT_BITS.items():
        out = F.replace(out, F.lit(base), F.lit(bits))
    return out


def encode(kmer: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), first base highest; up to 31 bases fit a BIGINT."""
    digits = F.transform(F.split(kmer, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda total, d: total * 4 + d)


def decode(value: Column, k: int) -> Column:
    if k > 31:
        raise ValueError("at most 31 bases fit")
    base = lambda j: F.substring(F.lit(ALPHABET), (F.shiftrightunsigned(value, 2 * j).bitwiseAND(F.lit(3).cast("bigint")) + 1).cast("int"), F.lit(1))
    return F.concat(*(base(j) for j in range(k - 1, -1, -1)))


def edge_bases(edges: Column, forward: bool) -> Column:
    """Bases of an edge byte: bits 0-3 are A, C, G, T forward; bits 4-7 are T, G, C, A backward."""
    order = ALPHABET if forward else ALPHABET[::-1]
    first = 0 if forward else 4
    marks = [F.when(edges.cast("bigint").bitwiseAND(F.lit(1 << (first + i)).cast("bigint")) != 0, F.lit(b)) for i, b in enumerate(order)]
    return F.array_compact(F.array(*marks))


def edge_text(edges: Column) -> Column:
    """Eight characters: a backward base in lower case or a dot, then the forward ones in upper case."""
    def shown(forward: bool) -> list[Column]:
        bases = edge_bases(edges, forward)
        return [F.when(F.array_contains(bases, b), F.lit(b if forward else b.lower())).otherwise(F.lit(".")) for b in ALPHABET]

    return F.concat(*shown(False), *shown(True))


def adjacent(kmer: Column, edges: Column, forward: bool) -> Column:
    """Neighbours of a k-mer, canonical."""
    n = F.char_length(kmer)
    if forward:
        return F.transform(edge_bases(edges, True), lambda b: canonical(F.concat(F.substring(kmer, F.lit(2), n), b)))
    return F.transform(edge_bases(edges, False), lambda b: canonical(F.concat(b, F.substring(kmer, F.lit(1), n - 1))))


def pieces(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, _at, _text: pieces of at most the last SPANS start positions, which overlap by k-1, and where they begin."""
    found = df.where(F.char_length(seq) >= k).select(key, F.lit(0).cast("bigint").alias("_at"), F.col(seq).alias("_text"))
    for size in SPANS:
        cut = found.select(key, "_at", F.posexplode(_chunks(F.col("_text"), size, k)).alias("_n", "_text"))
        found = cut.select(key, (F.col("_at") + F.col("_n") * F.lit(size)).alias("_at"), "_text")
    return found


def occurrences(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, pos, kmer: every k-mer of each sequence, of any length: pieces become rows before their k-mers do."""
    found = pieces(df, key, seq, k).select(key, "_at", F.posexplode(kmers(F.col("_text"), k)).alias("_n", "kmer"))
    return found.select(key, (F.col("_at") + F.col("_n")).alias("pos"), "kmer")


def counts(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, n_kmers, n_distinct of each key that has a k-mer; the rows of a key count as one, and so do those without a key.

    A text of one row is counted where it is. Only the k-mers of texts of more than WHOLE characters, and of keys with several rows, are shuffled.
    """
    again = staged(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_again")), "again")
    apart = F.char_length(seq) > WHOLE
    if again.isEmpty():
        one, more = df.where(~apart), df.where(apart)
    else:
        marked = df.join(again.withColumn("_many", F.lit(True)), F.col(key).eqNullSafe(F.col("_again")), "left")
        apart = apart | F.coalesce("_many", F.lit(False))
        one, more = marked.where(~apart), marked.where(apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, lengths in windows.blocks(batch, 1, k):
                numbers = (pa.array(x.astype("int64")) for x in (lengths - (k - 1), windows.distinct(codes, lengths, k)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *numbers], names=[key, "n_kmers", "n_distinct"])

    here = one.where(F.char_length(seq) >= k).select(key, seq).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_kmers long, n_distinct long")
    per_kmer = occurrences(more, key, seq, k).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    return here.unionByName(per_kmer.groupBy(key).agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct")))
