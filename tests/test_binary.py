"""Binary files in byte ranges, and writers that commit or leave nothing."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from sigloom.sources import binary, bloomfile, cortex


@pytest.fixture
def small_ranges(spark, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    monkeypatch.setattr(binary, "CHUNK", 300)
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def graph_of(rng, n, size, colours):
    return [("".join(rng.choice("ACGT") for _ in range(size)), [rng.randrange(1 << 31) for _ in range(colours)], [rng.randrange(256) for _ in range(colours)]) for _ in range(n)]


def expected(records):
    flip = str.maketrans("ACGT", "TGCA")
    return sorted((min(k, k.translate(flip)[::-1]), c, e) for k, c, e in records)


@pytest.mark.parametrize(("size", "colours", "n"), [(31, 1, 400), (5, 3, 333), (31, 2, 0), (1, 1, 7)])
def test_a_graph_is_read_by_many_tasks(small_ranges, tmp_path, size, colours, n):
    records = graph_of(random.Random(n), n, size, colours)
    names = ["long name " * 9] + [f"c{i}" for i in range(1, colours)]
    data = cortex.write_graph(records, size, names)
    (tmp_path / "g.ctx").write_bytes(data + b"part")  # the last bytes are no record
    graph = cortex.read_graph(small_ranges, str(tmp_path / "g.ctx"))
    rows = graph.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["kmer"], r["coverages"], r["edges"]) for r in rows) == expected(records)
    assert {r["kmer_size"] for r in rows} <= {size} and {r["path"][-5:] for r in rows} <= {"g.ctx"}
    if n > 300:
        assert len({r["task"] for r in rows}) > 4 and graph.rdd.getNumPartitions() == -(-(len(data) + 4) // 1000)


def test_only_wanted_columns_are_decoded(small_ranges, tmp_path, monkeypatch):
    (tmp_path / "g.ctx").write_bytes(cortex.write_graph(graph_of(random.Random(1), 50, 7, 1), 7, ["x"]))
    slim = cortex.read_graph(small_ranges, str(tmp_path / "g.ctx"), ["edges", "path"])
    assert slim.columns == ["edges", "path"] and slim.count() == 50
    got = cortex.Graphs.decode("p", (tmp_path / "g.ctx").read_bytes(), 0, b"", ["edges"])
    assert list(got) == ["edges"]


def test_many_small_files_share_a_task(small_ranges, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i:02d}.bloom").write_bytes(bytes([i, 0, 128]))
    found = bloomfile.read_filters(small_ranges, str(tmp_path), 24)
    assert found.rdd.getNumPartitions() == 1
    want = sorted((i, b) for i in range(40) for b in [*(j for j in range(8) if i >> (7 - j) & 1), 16])
    assert sorted((int(r["path"][-8:-6]), r["row_index"]) for r in found.collect()) == want
    assert bloomfile.read_filters(small_ranges, str(tmp_path / "f0[1-3].bloom"), 16).count() == 4


def test_a_filter_is_read_by_many_tasks(small_ranges, tmp_path):
    rng = random.Random(2)
    data = bytes(rng.choice([0, 0, 255, 1, rng.randrange(256)]) for _ in range(9_000))
    (tmp_path / "a.bloom").write_bytes(data)
    found = bloomfile.read_filters(small_ranges, str(tmp_path / "a.bloom"), 71_000)
    assert found.rdd.getNumPartitions() == 9
    assert sorted(r["row_index"] for r in found.collect()) == [8 * i + j for i, x in enumerate(data) for j in range(8) if x >> (7 - j) & 1 and 8 * i + j < 71_000]


def test_other_schemes_are_read_as_whole_files(small_ranges, tmp_path, monkeypatch):
    records = graph_of(random.Random(3), 90, 9, 2)
    (tmp_path / "g.ctx").write_bytes(cortex.write_graph(records, 9, ["x", "y"]))
    conf = small_ranges.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    path = "viewfs://store/in/g.ctx"
    assert not binary.readable(path)
    assert sorted((r["kmer"], r["coverages"], r["edges"]) for r in cortex.read_graph(small_ranges, path).collect()) == expected(records)
    with pytest.raises(ValueError, match="file system"):
        binary.write(small_ranges.range(1), "viewfs://store/in/out", lambda batches: iter(()))


def test_files_that_end_too_early(spark, tmp_path):
    data = cortex.write_graph(graph_of(random.Random(4), 3, 5, 1), 5, ["x" * 100_000])
    (tmp_path / "whole.ctx").write_bytes(data)
    assert cortex.read_graph(spark, str(tmp_path / "whole.ctx")).count() == 3  # a header longer than the first guess
    (tmp_path / "cut.ctx").write_bytes(data[:70_000])
    with pytest.raises(Exception, match="ends in its header"):
        cortex.read_graph(spark, str(tmp_path / "cut.ctx")).collect()
    (tmp_path / "none.ctx").write_bytes(b"")
    assert cortex.read_graph(spark, str(tmp_path / "none.ctx")).count() == 0


def test_written_graphs_and_links_come_back(spark, tmp_path):
    rng = random.Random(5)
    records = graph_of(rng, 500, 31, 2)
    table = spark.createDataFrame(records, "kmer string, coverages array<bigint>, edges array<int>").repartition(5)
    cortex.write_graphs(table, 31, ["x", "y"], str(tmp_path / "g"))
    assert len(os.listdir(tmp_path / "g")) == 5
    back = cortex.read_graph(spark, f"file:{tmp_path}/g").collect()
    assert sorted((r["kmer"], r["coverages"], r["edges"]) for r in back) == expected(records)
    links = [(k, d, 3 + i, [i, 2], "ACG"[: 1 + i]) for k, _, _ in records[:60] for d in "FR" for i in range(rng.randint(0, 3))]
    cortex.write_links(spark.createDataFrame(links, "kmer string, direction string, num_kmers int, counts array<int>, junctions string").repartition(3), 31, str(tmp_path / "l"))
    read = cortex.read_links(spark, str(tmp_path / "l")).collect()
    assert sorted((r["kmer"], r["direction"], r["num_kmers"], r["counts"], r["junctions"]) for r in read) == sorted(links)
    assert {r["path"].rpartition(".")[2] for r in read} == {"gz"}


def test_links_of_many_files_and_a_header_of_many_lines(spark, tmp_path):
    head = '{\n "file_format": "ctp",\n "format_version": 3,\n "graph": {\n  "kmer_size": 3\n }\n}\n\n'
    for i in range(6):
        body = "".join(f"{'ACGT'[i % 4]}CG 2\nF 3 1 {i},0 T\n# a note\nR 4 2 1 GA\n" for _ in range(50))
        (tmp_path / f"{i}.ctp.gz").write_bytes(gzip.compress((head + body).encode()))
    rows = cortex.read_links(spark, str(tmp_path)).collect()
    assert len(rows) == 600 and sum(r["counts"] == [5, 0] for r in rows) == 50
    (tmp_path / "bad.ctp.gz").write_bytes(gzip.compress((head + "ACG 1\nF 3 2 1,0 T\n").encode()))
    with pytest.raises(Exception, match="2 junctions expected"):
        cortex.read_links(spark, str(tmp_path / "bad.ctp.gz")).collect()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    def encode(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x == 77:
                    raise RuntimeError("this task fails")
                yield f"{x}.bin", iter([b"x"])

    with pytest.raises(Exception, match="this task fails"):
        binary.write(spark.range(0, 100, 1, 4), str(tmp_path / "d"), encode)
    # What other tasks were still writing has a name that readers pass over.
    assert [x for x in os.listdir(tmp_path / "d") if x[0] != "_"] == []
    binary.write(spark.range(0, 70, 1, 4), str(tmp_path / "d"), encode)
    assert len([x for x in os.listdir(tmp_path / "d") if x[0] != "_"]) == 70
    bits = spark.createDataFrame([("s", i) for i in range(0, 30, 7)], "sample string, row_index int")
    bloomfile.write_raw(bits, "sample", 30, str(tmp_path / "d"))
    assert (tmp_path / "d" / "s.bloom").read_bytes() == bytes([0b10000001, 0b00000010, 0b00000100, 0b00001000])


def test_a_task_gets_no_list_of_all_files():
    import pickle

    few, many = (binary._Reader(bloomfile.Filters, [(f"/data/{i}.bloom", 10) for i in range(n)], 100, ["path"]) for n in (1, 5000))
    assert len(pickle.dumps(many)) == len(pickle.dumps(few)) and len(many.partitions()) == 500
