"""The stored index: what a read touches, and changes that fail, meet or are cleaned up."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from sigloom.operators import signature as sig
from sigloom.operators import variants
from sigloom.plans import commits
from sigloom.plans import index as plans
from sigloom.plans.config import IndexConfig
from sigloom.plans.index import Index

K, M, H = 9, 5000, 3


def sequence(rng, n=40):
    return "".join(rng.choice("ACGT") for _ in range(n))


def built(spark, path, names, k=K, m=M, h=H):
    rng = random.Random(str(names))
    seqs = [(i, n, sequence(rng)) for i, n in enumerate(names)]
    table = spark.createDataFrame(seqs, "n int, sample_name string, seq string")
    return Index.build_sequences(spark, IndexConfig(k=k, m=m, h=h, path=str(path)), table, ["n"]), {n: s for _, n, s in seqs}


def filter_of(spark, seq):
    return sig.bloom_of_sequences(spark.createDataFrame([(0, seq)], "n int, seq string"), "n", "seq", K, H, M)


def bits(index):
    return sorted(map(tuple, sig.untranspose(index.signature()).collect()))


def names(index):
    return [(r["colour"], r["sample_name"], r["deleted"]) for r in index.samples().orderBy("colour").collect()]


def scanned(df):
    """Files and bytes of the scans of a plan, once it has run."""
    df.collect()
    todo, files, size, filters = [df._jdf.queryExecution().executedPlan()], 0, 0, []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            metrics = node.metrics()
            files += metrics.apply("numFiles").value()
            size += metrics.apply("filesSize").value()
            filters.append(node.metadata().apply("PushedFilters"))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return files, size, filters


@pytest.fixture
def blocked(monkeypatch):
    """Parts of 64 blocks, however small."""
    monkeypatch.setattr(Index, "_shift", staticmethod(lambda m, n_words: max(0, (m // 64 - 1).bit_length())))


def test_reads_are_pruned(spark, tmp_path, monkeypatch, blocked):
    index, seqs = built(spark, tmp_path / "i", [f"s{i}" for i in range(70)])
    part = tmp_path / "i" / "signature" / index.parts[0]["name"]
    every = [f for f in part.rglob("*.parquet") if "block=" in str(f)]
    assert len(every) >= 30
    one = next(iter(seqs.values()))
    kmers = spark.createDataFrame([(one[i : i + K],) for i in range(3)], "kmer string")
    asked = sig.wanted_rows(kmers, H, M)
    rows = {r["row_index"] for r in asked.collect()}
    files, size, filters = scanned(index.rows(asked))
    blocks = {r >> index.parts[0]["shift"] for r in rows}
    assert files <= len(blocks) < len(every) / 2 and size < sum(f.stat().st_size for f in every) / 2
    assert all(str(r) in filters[0] for r in rows)
    assert {r["row_index"] for r in index.rows(asked).collect()} <= rows
    # Rows of one block only, too many to be written into the plan: the block is still the only one that is read.
    monkeypatch.setattr(plans, "LITERAL_ROWS", 5)
    near = spark.range(0, 40).select(F.col("id").cast("int").alias("row_index"))
    assert scanned(index.rows(near))[0] <= len({r >> index.parts[0]["shift"] for r in range(40)})
    large = spark.createDataFrame([(s[i : i + K],) for s in seqs.values() for i in range(len(s) - K + 1)], "kmer string")
    got = sorted(map(tuple, index.lookup(large).collect()))
    assert got == sorted(map(tuple, sig.lookup(large, index.signature(), H, M).collect())) and len(got) > 1000
    assert sorted(map(tuple, index.lookup(kmers).collect())) == sorted(map(tuple, sig.lookup(kmers, index.signature(), H, M).collect()))


def test_many_literals_stay_short_lists(spark, tmp_path, blocked):
    index, _ = built(spark, tmp_path / "i", ["a", "b"])
    wanted = spark.range(0, M, 11).select(F.col("id").cast("int").alias("row_index"))
    df = index.rows(wanted)
    _, _, filters = scanned(df)
    assert filters[0].count("In(row_index") >= M / 11 / plans.IN_LIST - 1
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r) for r in index.signature().collect() if r["row_index"] % 11 == 0)
    assert index.rows(wanted.limit(0)).count() == 0


def test_rows_and_columns_of_parts(spark, tmp_path, blocked):
    index, seqs = built(spark, tmp_path / "i", [f"s{i}" for i in range(61)])
    more = random.Random(9)
    for i in range(8):
        seqs[f"t{i}"] = sequence(more)
        index = index.insert(filter_of(spark, seqs[f"t{i}"]), f"t{i}")
    assert len(index.parts) == 9 and index.num_samples() == 69
    together = sig.signature_of_sequences(spark.createDataFrame(list(enumerate(seqs.values())), "colour int, seq string"), "seq", K, H, M)
    every = sorted(map(tuple, sig.untranspose(together).collect()))
    assert bits(index) == every
    asked = spark.createDataFrame([(r,) for r in (0, 17, 1234, 4999, 17)] + [(every[5][0],)], "row_index int")
    assert sorted(map(tuple, index.get_rows(asked).collect())) == [x for x in every if x[0] in (0, 17, 1234, 4999, every[5][0])]
    for colour in (0, 60, 61, 64, 68):
        assert {r["row_index"] for r in index.get_column(colour).where("bit = 1").collect()} == {r for r, c in every if c == colour}
    column = index.get_column(64)
    assert scanned(column)[0] <= 64 and column.count() == M
    with pytest.raises(ValueError, match="colour"):
        index.get_column(69)
    hits = index.search(spark.createDataFrame(list(seqs.items()), "query_id string, seq string"))
    assert {(r["query_id"], r["sample_name"]) for r in hits.collect()} >= {(n, n) for n in seqs}
    probes = spark.createDataFrame([("v", "ref", seqs["s3"]), ("v", "alt", seqs["t7"])], "variant string, kind string, seq string")
    assert {tuple(r) for r in index.variant_search(probes).collect()} == {("v", "s3", "0/0"), ("v", "t7", "1/1")}
    assert variants.as_queries(probes.unionByName(probes)).count() == 2


@pytest.mark.parametrize("by", [0, 1, 5, 63, 64, 100, -64])
def test_shifted_words(spark, by):
    rng = random.Random(by)
    set_bits = sorted({(rng.randrange(20), 64 + rng.randrange(300)) for _ in range(200)})
    moved = sig.compact(sig.shifted(sig.transpose(spark.createDataFrame(set_bits, "row_index int, colour int")), by))
    assert sorted(map(tuple, sig.untranspose(moved).collect())) == [(r, c + by) for r, c in set_bits]


def test_a_change_that_ends_before_its_commit(spark, tmp_path, monkeypatch):
    index, seqs = built(spark, tmp_path / "i", ["a", "b"])
    before = bits(index)

    def broken(*_):
        raise RuntimeError("the driver is gone")

    for lost in ("write", "read"):
        with monkeypatch.context() as m:
            m.setattr(commits, lost, broken)
            with pytest.raises(RuntimeError, match="gone"):
                index.insert(filter_of(spark, "ACGTACGTACGT"), "c")
        index = Index(spark, index.path)
    # The second writer had committed before it ended; the first one had not.
    assert [n for _, n, _ in names(index)] == ["a", "b", "c"] and index.n == 1
    (tmp_path / "i" / "commits" / ".half").write_text("{")
    (tmp_path / "i" / "commits" / "7").mkdir()
    again = Index(spark, index.path).insert(filter_of(spark, "TTTTACGTACGT"), "d")
    assert [n for _, n, _ in names(again)] == ["a", "b", "c", "d"] and again.n == 2
    assert bits(Index(spark, index.path, n=0)) == before
    assert again.vacuum(keep=3, older_than=-60) == 3  # the part and the samples of the first writer, and the half commit
    assert bits(Index(spark, index.path, n=0)) == before and bits(Index(spark, index.path)) == bits(again)


def test_two_writers(spark, tmp_path):
    index, _ = built(spark, tmp_path / "i", ["a"])
    stale = Index(spark, index.path)
    index = index.insert(filter_of(spark, "ACGTACGTACGTA"), "b")
    after = stale.insert(filter_of(spark, "CCCCCGGTACGTA"), "c").delete_sample("b")
    assert names(after) == [(0, "a", False), (1, "b", True), (2, "c", False)]
    assert after.search_one("CCCCCGGTACGTA")[0]["sample_name"] == "c"
    with pytest.raises(ValueError, match="same name"):
        stale.insert(filter_of(spark, "ACGTACGTACGTT"), "c")
    with pytest.raises(FileExistsError):
        built(spark, tmp_path / "i", ["z"])
    # At one time: each number goes to one of them.
    won, lost = [], []

    def claim(i):
        try:
            commits.write(spark, after.path, after.n + 1, after.state | {"writer": i})
            won.append(i)
        except commits.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5 and Index(spark, after.path).state["writer"] == won[0]
    assert not [x for x in os.listdir(tmp_path / "i" / "commits") if x.startswith(".") and not x.endswith(".crc")]


@pytest.mark.parametrize("n", [5, 150])
def test_purge(spark, tmp_path, n):
    index, seqs = built(spark, tmp_path / "i", [f"s{i:03d}" for i in range(n)])
    other, theirs = built(spark, tmp_path / "j", ["x", "y", "z"])
    index = index.merge(other.delete_sample("y"))
    seqs |= theirs
    gone = {"s000", f"s{n - 1:03d}", "y", *random.Random(n).sample(sorted(seqs), min(n // 3, 12))}
    index = index.delete_samples(spark.createDataFrame([(x,) for x in gone - {"y"}], "sample_name string"))
    kept = [s for s in seqs if s not in gone]
    marked = index.compact()
    assert bits(marked) == bits(index) and names(marked) == names(index) and len(marked.parts) == 1
    purged = marked.compact(purge=True)
    assert names(purged) == [(i, s, False) for i, s in enumerate(kept)]
    alone = sig.signature_of_sequences(spark.createDataFrame([(i, seqs[s]) for i, s in enumerate(kept)], "colour int, seq string"), "seq", K, H, M)
    assert bits(purged) == sorted(map(tuple, sig.untranspose(alone).collect()))
    assert purged.num_samples() == len(kept) and purged.state["deletes"] == []
    assert names(purged.insert(filter_of(spark, seqs["s000"]), "s000"))[-1] == (len(kept), "s000", False)


def test_all_samples_deleted(spark, tmp_path):
    index, _ = built(spark, tmp_path / "i", ["a"])
    empty = index.delete_sample("a").compact(purge=True)
    assert empty.num_samples() == 0 and empty.search_one("ACGTACGTACGTACGT", 0.5) == [] and bits(empty) == []
    assert names(empty.insert(filter_of(spark, "ACGTACGTACGT"), "a")) == [(0, "a", False)]


def test_tidy_and_vacuum(spark, tmp_path):
    index, seqs = built(spark, tmp_path / "i", [f"s{i}" for i in range(30)])
    rng = random.Random(4)
    for i in range(7):
        seqs[f"t{i}"] = sequence(rng)
        index = index.insert(filter_of(spark, seqs[f"t{i}"]), f"t{i}")
    index = index.delete_sample("t2").delete_sample("s4")
    before, who = bits(index), names(index)
    reader = Index(spark, index.path)
    tidied = index.tidy(fanout=3)
    assert len(tidied.parts) < len(index.parts) and bits(tidied) == before and names(tidied) == who
    assert tidied.tidy(fanout=3).n == tidied.n
    assert tidied.vacuum(keep=2) == tidied.n - 1  # the tables are too young to go
    assert bits(reader) == before
    tidied.vacuum(keep=1, older_than=-60)
    left = Index(spark, index.path)
    assert bits(left) == before and names(left) == who and sorted(os.listdir(tmp_path / "i" / "signature")) == sorted(p["name"] for p in left.parts)
    assert commits.numbers(spark, left.path) == [left.n] and left.vacuum(older_than=-60) == 0
    with pytest.raises(FileNotFoundError, match="commit 0"):
        Index(spark, left.path, n=0)


def test_copies_share_a_column(spark, tmp_path):
    """Samples of one sequence are stored once, and every read and change has them as samples of their own."""
    seqs = {f"s{i}": ["ACGTTGCAACGGTCA", "TTGACCATGACCATG", "GGGTACCATTTACAG"][i % 3] for i in range(7)}
    rows = spark.createDataFrame([(i, name, seq) for i, (name, seq) in enumerate(seqs.items())], "n int, sample_name string, seq string")
    index = Index.build_sequences(spark, IndexConfig(k=K, m=M, h=H, path=str(tmp_path / "i")), rows, ["n"])
    assert (index.num_cols, index.num_columns) == (7, 3)
    plain = sig.signature_of_sequences(rows.select(F.col("n").alias("colour"), "seq"), "seq", K, H, M)
    want = sorted(map(tuple, sig.untranspose(plain).collect()))
    assert sorted(map(tuple, sig.untranspose(index.signature()).collect())) == want
    assert [r["row_index"] for r in index.get_column(5).where("bit = 1").orderBy("row_index").collect()] == [r for r, c in want if c == 5]
    names = lambda i, seq: {h["sample_name"] for h in i.search_one(seq)}
    index = index.delete_samples(spark.createDataFrame([("s0",), ("s2",), ("s5",)], "sample_name string")).compact(purge=True)
    assert (index.num_cols, index.num_columns) == (4, 2)
    assert names(index, seqs["s0"]) == {"s3", "s6"} and names(index, seqs["s1"]) == {"s1", "s4"} and not names(index, seqs["s2"])
