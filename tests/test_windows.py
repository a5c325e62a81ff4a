"""k-mers taken by the batch in numpy, against plain Python and Spark's own expressions."""

import random

from pyspark.sql import functions as F

from sigloom.functions import kmers as km
from sigloom.functions import murmur
from sigloom.operators import search
from sigloom.operators import signature as sig


def texts(n):
    random.seed(n)
    return ["".join(random.choice(letters) for _ in range(size)) for letters in ("ACGT", "AT", "abé€😀ACGT") for size in (0, 2, 3, 31, 40, 500)] + [None]


def shuffled(df):
    """Bytes of the exchanges of a plan that have run."""
    store = df.sparkSession.sparkContext._jsc.sc().statusStore()
    gateway = df.sparkSession.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_counts(spark, monkeypatch):
    # Keys that are there twice, no key at all, and texts longer than one task counts at once.
    rows = [(i % 15 if i % 7 else None, t) for i, t in enumerate(texts(1))] + [(100, "ACGT" * 200), (101, "é" * 40)]
    df = spark.createDataFrame(rows, "key long, seq string").repartition(3)
    every = {}
    for key, t in rows:
        every.setdefault(key, []).extend(t[i : i + 3] for i in range(len(t or "") - 2))
    want = {(key, len(x), len(set(x))) for key, x in every.items() if x}
    for whole in (km.WHOLE, 100):
        monkeypatch.setattr(km, "WHOLE", whole)
        got = km.counts(df, "key", "seq", 3).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_counts_shuffle_no_kmers(spark):
    df = spark.range(200).select("id", F.concat_ws(" ", *(F.sha2((F.col("id") + i).cast("string"), 256) for i in range(30))).alias("seq")).repartition(4).localCheckpoint()
    before = shuffled(df)
    assert km.counts(df, "id", "seq", 31).agg(F.sum("n_kmers")).first()[0] == 200 * (30 * 65 - 1 - 30)
    assert shuffled(df) - before < 100_000  # 12 MB of k-mers


def test_rows_of_texts(spark):
    """The rows that native expressions give, of windows and of whole k-mers."""
    df = spark.createDataFrame(list(enumerate(texts(2))), "key long, seq string").repartition(3)
    kmers = km.occurrences(df, "key", "seq", 31).select("key", km.canonical(F.col("kmer")).alias("c"), "kmer")
    want = {tuple(r) for r in murmur.with_rows(kmers, "c", 3, 2500).select("key", F.explode_outer("rows")).collect()}
    assert {tuple(r) for r in sig.bloom_of_sequences(df, "key", "seq", 31, 3, 2500).collect()} == want
    assert {tuple(r) for r in sig.bloom_of_kmers(kmers, "key", 3, 2500).collect()} == want
    own = murmur.with_rows(kmers.select("kmer", "c").distinct(), "c", 3, 20).select("kmer", F.size("rows"), F.explode_outer("rows"))
    assert sorted(map(tuple, sig.wanted_rows(kmers, 3, 20).collect())) == sorted(map(tuple, own.collect()))


def test_search_of_copies(spark, monkeypatch):
    """Samples of one sequence, or of the same two, are hashed once, and each has its rows."""
    one, two = "ACGTTGCAACGGT", "TTGACCATGACCA"
    rows = [(0, one), (1, two), (2, one), (3, one), (3, two), (4, two), (4, one), (5, None), (70, two), (71, "ACGTTG")]
    samples = spark.createDataFrame([(c, f"s{c}", c == 2, s) for c, s in rows], "colour int, sample_name string, deleted boolean, seq string")
    named, seqs = search.classed(samples)
    assert seqs.select("colour").distinct().count() == 5
    queries = {"a": one + "CCC", "b": two[3:], "short": "AC"}
    asked = spark.createDataFrame(list(queries.items()), "query_id string, seq string")
    held = {}
    for c, s in rows:
        held.setdefault(c, set()).update(min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in (s[i : i + 4] for i in range(len(s or "") - 3)))
    for bits, threshold in ((sig.FILTER_BITS, 0.3), (1 << 15, 0.3), (1 << 15, 0.0)):
        monkeypatch.setattr(sig, "FILTER_BITS", bits)
        want = set()
        for q, s in queries.items():
            own = [s[i : i + 4] for i in range(len(s) - 3)]
            for c in held:
                text = "".join("01"[min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) in held[c]] for x in own)
                found = len({x for x, bit in zip(own, text, strict=True) if bit == "1"})
                if own and c != 2 and found >= threshold * len(set(own)):
                    want.add((q, c, f"s{c}", len(set(own)), found, text))
        for how in ({"marks": True}, {"score": True}):
            got = search.search(asked, None, named.distinct(), 4, 3, 1 << 20, threshold, **how, looked=search.looked_up_sequences(asked, seqs, 4, 3, 1 << 20))
            assert {tuple(r) for r in got.select("query_id", "colour", "sample_name", "num_kmers", "num_kmers_found", "kmer-presence").collect()} == want


def test_search_of_samples_with_the_same_of_what_is_asked(spark, monkeypatch):
    """What nobody asks for does not tell samples apart: they are looked up as one, with the rows of a lookup one by one."""
    random.seed(3)
    some = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    heads = [some(40) for _ in range(4)]
    rows = [(i, heads[i % 4] + some(60)) for i in range(400)] + [(400, heads[0]), (400, heads[1]), (401, None), (402, "ACG"), (403, some(80)), (404, heads[2] * 2000), (405, heads[3][:25])]
    samples = spark.createDataFrame([(c, f"s{c}", c == 7, s) for c, s in rows], "colour int, sample_name string, deleted boolean, seq string").repartition(5)
    asked = spark.createDataFrame([*((f"q{i}", s + some(20)) for i, s in enumerate(heads)), ("short", "AC"), ("none", some(50))], "query_id string, seq string")
    named = samples.drop("seq").distinct()
    for m, bits, kept, threshold, how in ((1 << 20, 1 << 25, 1 << 17, 0.0, {"marks": True}), (1 << 20, 1 << 15, 1, 0.4, {"marks": True}), (2500, 1 << 25, 1 << 17, 0.4, {})):
        monkeypatch.setattr(sig, "FILTER_BITS", bits)
        monkeypatch.setattr(sig, "REMEMBERED", kept)
        looked = search.looked_up_sequences(asked, samples, 21, 3, m)
        want = sorted(map(tuple, search.search(asked, None, named, 21, 3, m, threshold, **how, looked=looked).collect()))
        got = search.search_sequences(asked, samples, 21, 3, m, threshold, **how).distinct().collect()
        assert sorted(map(tuple, got)) == want and len(want) >= 400
    monkeypatch.setattr(sig, "FILTER_BITS", 1 << 25)
    columns = sig.lookup_samples(search.asked_kmers(asked, 21), samples, 21, 3, 25_000_000)[0]
    assert columns.select("column").distinct().count() < 40


def test_search_shuffles_no_row_for_each_sample(spark):
    head = F.concat(*(F.translate(F.sha2(F.lit(str(i)), 256), "0123456789abcdef", "ACGTACGTACGTACGT") for i in range(10)))
    own = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT")
    samples = spark.range(2000).select(F.col("id").cast("int").alias("colour"), F.col("id").cast("string").alias("sample_name"), F.lit(False).alias("deleted"), F.concat(head, own).alias("seq")).repartition(4).localCheckpoint()
    asked = spark.range(1).select(F.lit("q").alias("query_id"), head.alias("seq"))
    before = shuffled(samples)
    assert search.search_sequences(asked, samples, 31, 3, 25_000_000).count() == 2000
    assert shuffled(samples) - before < 1_000_000  # 4 M rows are set
