"""Bloom rows and the bit-sliced signature.

bloom      (colour, row_index): one row per set bit of a sample's filter.
signature  (row_index, word_no, bits): for each filter position the samples that have it, 64 colours a word.

The shuffle on (row_index, word_no) is the transposition; bit_or combines before it, so neither a sample with very
many k-mers nor a position that all samples share lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import kmers as km
from sigloom.functions import windows, words
from sigloom.plans.stage import staged


#: Bits of the filter that leaves out rows nobody asks for; rows of larger Bloom filters share them.
FILTER_BITS = 1 << 25
#: Texts and sets of rows that a task remembers, by digests of 16 bytes.
REMEMBERED = 1 << 17


def _hashed(texts: DataFrame, key: str, text: str, k: int | None, h: int, m: int, only: np.ndarray | None = None) -> DataFrame:
    """key, row_index of the k-mers of texts, or of whole texts, with repeats; of the rows in `only`, if given."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, lengths in windows.whole(batch, 1) if k is None else windows.blocks(batch, 1, k):
                for of, found in windows.bloom_rows(codes, lengths, lengths[0] if k is None else k, h, m):
                    at, own = found.ravel(), np.repeat(rows[of], h)
                    if only is not None:
                        keep = _passed(only, at)
                        at, own = at[keep], own[keep]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(at.astype(np.int32))], names=[key, "row_index"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, row_index int")


def _passed(only: np.ndarray, at: np.ndarray) -> np.ndarray:
    bit = at % (8 * len(only))
    return (only[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _row_filter(wanted: DataFrame) -> np.ndarray:
    """The bits of the rows wanted; at most FILTER_BITS, whatever is asked."""
    bit = F.pmod("row_index", F.lit(FILTER_BITS)) + 1
    only = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in wanted.where("row_index IS NOT NULL").groupBy(F.bitmap_bucket_number(bit)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit))).collect():
        only[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return only


def bloom_of_kmers(kmers: DataFrame, key: str, h: int, m: int) -> DataFrame:
    """key, row_index from (key, kmer); k-mers are made canonical before hashing."""
    return _hashed(kmers, key, "kmer", None, h, m).distinct()


def bloom_of_sequences(seqs: DataFrame, key: str, seq: str, k: int, h: int, m: int) -> DataFrame:
    return _hashed(km.pieces(seqs, key, seq, k), key, "_text", k, h, m).distinct()


def signature_of_sequences(seqs: DataFrame, seq: str, k: int, h: int, m: int) -> DataFrame:
    """The signature of (colour, seq). bit_or ignores repeats, so nothing is made distinct before the one shuffle."""
    return transpose(_hashed(km.pieces(seqs, "colour", seq, k), "colour", "_text", k, h, m))


def transpose(bloom: DataFrame) -> DataFrame:
    return words.pack(bloom, ["row_index"], "colour").select("row_index", "word_no", "bits")


def untranspose(signature: DataFrame) -> DataFrame:
    return words.unpack(signature, ["row_index"], "colour")


def compact(deltas: DataFrame) -> DataFrame:
    """One row per word from appended parts."""
    return deltas.groupBy("row_index", "word_no").agg(F.bit_or("bits").alias("bits"))


def get_rows(signature: DataFrame, rows: DataFrame, num_cols: int | None = None) -> DataFrame:
    """row_index, colour of the wanted rows; colours beyond num_cols are padding and left out."""
    found = untranspose(signature.join(rows.select("row_index").distinct(), "row_index"))
    return found if num_cols is None else found.where(F.col("colour") < num_cols)


def get_column(signature: DataFrame, colour: int, m: int) -> DataFrame:
    """row_index, bit for every row 0..m-1."""
    own = signature.where(F.col("word_no") == colour // 64).select("row_index", words.bit_at(F.col("bits"), F.lit(colour)).cast("int").alias("bit"))
    every = signature.sparkSession.range(m).select(F.col("id").cast("int").alias("row_index"))
    return every.join(own, "row_index", "left").select("row_index", F.coalesce("bit", F.lit(0)).alias("bit"))


def set_rows(signature: DataFrame, rows: DataFrame) -> DataFrame:
    """Replaces the rows given as (row_index, word_no, bits)."""
    kept = signature.join(rows.select("row_index").distinct(), "row_index", "left_anti")
    return kept.select("row_index", "word_no", "bits").unionByName(rows.select("row_index", "word_no", "bits")).where("bits <> 0")


def set_column(signature: DataFrame, colour: int, rows: DataFrame) -> DataFrame:
    """Overwrites or appends one column with the set rows (row_index)."""
    cleared = signature.withColumn("bits", F.when(F.col("word_no") == colour // 64, words.clear_bit(F.col("bits"), F.lit(colour))).otherwise(F.col("bits")))
    fresh = transpose(rows.select("row_index", F.lit(colour).alias("colour")))
    return compact(cleared.where("bits <> 0").select("row_index", "word_no", "bits").unionByName(fresh))


def merge(left: DataFrame, right: DataFrame, num_left: int) -> DataFrame:
    """Right columns after the left ones: by whole words where the number allows, else words are split in two and joined again."""
    both = left.select("row_index", "word_no", "bits").unionByName(shifted(right, num_left))
    return both if num_left % 64 == 0 else compact(both)


def shifted(signature: DataFrame, by: int) -> DataFrame:
    """The words of columns that move by so many places; a word may become two, of which `compact` makes one with its neighbour's."""
    q, r = divmod(by, 64)
    word = (F.col("word_no") + q).cast("int")
    if not r:
        return signature.select("row_index", word.alias("word_no"), "bits")
    return _split(signature, word, F.lit(r))


def _split(signature: DataFrame, word: Column, r: Column) -> DataFrame:
    """Bits moved up by r (0 to 63) places from the first of `word`."""
    both = F.array(
        F.struct(word.alias("word_no"), F.call_function("shiftleft", "bits", r).alias("bits")),
        F.struct((word + 1).alias("word_no"), F.when(r > 0, F.call_function("shiftrightunsigned", "bits", 64 - r)).otherwise(F.lit(0).cast("bigint")).alias("bits")),
    )
    return signature.select("row_index", F.explode(both).alias("w")).where("w.bits <> 0").select("row_index", F.col("w.word_no").cast("int").alias("word_no"), "w.bits")


def closed_up(signature: DataFrame) -> DataFrame:
    """Words without the columns that are left out: from (row_index, word_no, bits, kept: the word's columns that stay, start: the new number of the first of them)."""
    gone = F.filter(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.bit_get("kept", i) == 0)

    def without(bits: Column, i: Column) -> Column:
        below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), i))
        return bits.bitwiseAND(below).bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(1)).bitwiseAND(F.bitwise_not(below)))

    bits = F.aggregate(gone, F.col("bits").bitwiseAND(F.col("kept")), without)
    close = signature.select("row_index", "start", bits.alias("bits")).where("bits <> 0")
    return _split(close, F.floor(F.col("start") / 64).cast("int"), F.pmod("start", F.lit(64)).cast("int"))


def wanted_rows(kmers: DataFrame, h: int, m: int) -> DataFrame:
    """kmer, n_rows, row_index: the distinct rows of each distinct k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, lengths in windows.whole(batch, 0):
                for of, found in windows.bloom_rows(codes, lengths, lengths[0], h, m):
                    found = np.sort(found, axis=1)
                    fresh = np.ones(found.shape, bool)
                    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                    n = fresh.sum(axis=1)
                    columns = [batch.column(0).take(pa.array(np.repeat(rows[of], n))), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(found[fresh].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["kmer", "n_rows", "row_index"])

    return kmers.select("kmer").where("kmer IS NOT NULL").distinct().mapInArrow(run, "kmer string, n_rows int, row_index int")


def met_words(wanted: DataFrame, signature: DataFrame) -> DataFrame:
    """kmer, word_no, bits of the samples that have every row of a k-mer: a missing word is zero, so a word counts only if all rows have it."""
    met = wanted.join(signature, "row_index")
    anded = met.groupBy("kmer", "word_no").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("met"), F.max("n_rows").alias("n_rows"))
    return anded.where((F.col("met") == F.col("n_rows")) & (F.col("bits") != 0)).select("kmer", "word_no", "bits")


def lookup(kmers: DataFrame, signature: DataFrame, h: int, m: int) -> DataFrame:
    """kmer, word_no, bits of the samples that have every row of a k-mer."""
    return met_words(wanted_rows(kmers, h, m), signature)


def lookup_sequences(kmers: DataFrame, seqs: DataFrame, k: int, h: int, m: int) -> DataFrame:
    """The same of the signature of (colour, seq), of which only the asked rows are made.

    The rows and the words are staged: a plan's estimate of what k-mers become is far too low, and it would send the words through the driver.
    """
    wanted = staged(wanted_rows(kmers, h, m), "wanted")
    held = _hashed(km.pieces(seqs, "colour", "seq", k), "colour", "_text", k, h, m, _row_filter(wanted))
    if m > FILTER_BITS:
        held = held.join(wanted.select("row_index").distinct(), "row_index", "left_semi")
    return met_words(wanted, staged(transpose(held), "words"))


def _asked_sets(seqs: DataFrame, key: str, text: str, k: int, h: int, m: int, only: np.ndarray) -> DataFrame:
    """key, _set, _rows of the texts that have rows in `only`: the set of those rows by its digest, and the rows where a task meets the set first.

    Texts that a task has seen are not hashed again.
    """
    kind = seqs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        told: set[bytes] = set()
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            if len(told) > REMEMBERED:
                told.clear()
            keys = [blake2b(t.encode(), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            fresh = {text_key: i for i, text_key in enumerate(keys) if text_key not in known}
            known.update(dict.fromkeys(fresh, b""))
            names, first = list(fresh), {}
            part = batch.take(pa.array(list(fresh.values()), pa.int64()))
            for rows, codes, lengths in windows.blocks(part, 1, k):
                pairs = [np.zeros(0, np.int64)]
                for of, found in windows.bloom_rows(codes, lengths, k, h, m):
                    at, own = found.ravel(), np.repeat(of, h)
                    keep = _passed(only, at)
                    pairs.append(own[keep] << 32 | at[keep])
                both = np.unique(np.concatenate(pairs))
                edges = np.searchsorted(both >> 32, np.arange(len(rows) + 1))
                at = (both & 0xFFFFFFFF).astype(np.int32)
                for i, lo, hi in zip(rows.tolist(), edges, edges[1:]):
                    if hi > lo:
                        digest = known[names[i]] = blake2b(at[lo:hi].tobytes(), digest_size=16).digest()
                        if digest not in told:
                            told.add(digest)
                            first[digest] = at[lo:hi]
            sets = [known[text_key] for text_key in keys]
            own = [i for i, digest in enumerate(sets) if digest]
            sets = [sets[i] for i in own]
            made = [pa.array(sets, pa.binary()), pa.array([first.pop(digest, None) for digest in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *made], names=[key, "_set", "_rows"])

    return seqs.select(key, text).mapInArrow(run, f"`{key}` {kind}, _set binary, _rows array<int>")


def lookup_samples(kmers: DataFrame, samples: DataFrame, k: int, h: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(colour, column) of samples (colour, seq) in which something asked is set, and kmer, word_no, bits of `lookup` over the columns.

    A lookup reads only the rows asked for, so samples with the same of these share a column, whatever else they hold.
    """
    wanted = staged(wanted_rows(kmers, h, m), "wanted")
    sets = staged(_asked_sets(km.pieces(samples, "colour", "seq", k), "colour", "_text", k, h, m, _row_filter(wanted)), "sets")
    own = staged(sets.groupBy("colour").agg(F.sort_array(F.collect_set("_set")).alias("_sets")), "own")
    columns = staged(own.groupBy("_sets").agg(F.min("colour").alias("column")), "columns")
    rows = sets.where("_rows IS NOT NULL").dropDuplicates(["_set"]).select("_set", "_rows")
    held = columns.select(F.col("column").alias("colour"), F.explode("_sets").alias("_set")).join(rows, "_set").select("colour", F.explode("_rows").alias("row_index"))
    return own.join(columns, "_sets").select("colour", "column"), met_words(wanted, staged(transpose(held), "words"))
