"""Signature, search, metadata, variants, index, formats and sources."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom import __main__ as cli
from sigloom.functions import kmers as km
from sigloom.functions import score as sc
from sigloom.functions import words
from sigloom.operators.contigs import contigs
from sigloom.operators import metadata, search, variants
from sigloom.operators import signature as sig
from sigloom.plans.config import IndexConfig
from sigloom.plans import stage
from sigloom.plans.index import Index
from sigloom.plans.session import dealt
from sigloom.sources import bloomfile, cortex, fasta, sinks
from sigloom.streaming.search import search_stream

# Fixed value: a golden presence string.
GOLDEN = "1111111111111111111111111111111111111111110000000000000000000000000000001111111111111111111111100000000000000000000100000010001111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111110000000000000000000000100000000010001111111111000000000000100000000000000000000000000000000100000000000010000000010000001000000000010000000000000000010001111111100000000000001100010000000000000000000001000000000000110000000000000000000000100000000000000000000100000000000000001010001111111111100000000000000000000100100010011111111111111111100000000001001000001000000000000000000000000000001000000010100000000000000001111111111111111111111111111111111111111111111111111111111111111111111111111111100000010110001000100000000000000000000000000000000000001000001111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111111100010000000100000000001010000001111111111111111111111111111111111111111111111111111111111111111100100000000010000000010000000001111111111111111111111111111111111111111111111111111111111111111111111100000100000000000010000000000000010000000011111111000000100010"


def index(spark, tmp_path, samples, k=3, m=1000, h=3, name="i"):
    seqs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(samples)], "n int, sample_name string, seq string")
    return Index.build_sequences(spark, IndexConfig(k=k, m=m, h=h, path=str(tmp_path / name)), seqs, ["n"])


def presence(i, spark, *kmers):
    found = words.unpack(i.lookup(spark.createDataFrame([(x,) for x in kmers], "kmer string")), ["kmer"], "colour").collect()
    return {x: "".join("1" if any(r["kmer"] == x and r["colour"] == c for r in found) else "0" for c in range(i.num_cols)) for x in kmers}


@pytest.mark.parametrize(("m", "h"), [(250, 3), (2500, 2), (250, 1)])
def test_lookup(spark, tmp_path, m, h):
    rows = [("s1", x) for x in ("ATC", "ATG", "ATA", "ATT")] + [("s2", x) for x in ("ATC", "ATG", "ATA", "TTT")]
    bloom = sig.bloom_of_kmers(spark.createDataFrame(rows, "sample_name string, kmer string"), "sample_name", h, m)
    i = Index.build(spark, IndexConfig(k=3, m=m, h=h, path=str(tmp_path / "i")), bloom, spark.createDataFrame([("s1",), ("s2",)], "sample_name string"))
    assert presence(i, spark, "ATC", "ATT", "TTT") == {"ATC": "11", "ATT": "10", "TTT": "01"}
    other = Index.build(spark, IndexConfig(k=3, m=m, h=h, path=str(tmp_path / "j")), bloom, spark.createDataFrame([("s1",), ("s2",)], "sample_name string"))
    both = i.merge(other)
    assert presence(both, spark, "ATC", "ATT", "TTT") == {"ATC": "1111", "ATT": "1010", "TTT": "0101"}
    assert [r["sample_name"] for r in both.samples().orderBy("colour").collect()] == ["s1", "s2", "s1_duplicate_in_merge", "s2_duplicate_in_merge"]
    with pytest.raises(ValueError):
        both.merge(other)


def test_search_insert_delete_and_merge(spark, tmp_path):
    i = index(spark, tmp_path, [("a", "ATACACAAT"), ("b", "ACAGAGAAC")])
    assert i.search_one("ATACACAAT")[0] == {"sample_name": "a", "num_kmers": 6, "num_kmers_found": 6, "percent_kmers_found": 100.0}
    assert i.search_one("ACAGAGAAC")[0]["sample_name"] == "b"
    assert i.search_one("ACAGTTAAC") == []
    with pytest.warns(UserWarning):
        assert i.search_one("AC") == []
    assert [h["sample_name"] for h in i.search_one("ATACACAAT", 0.0)] == ["a", "b"]
    with pytest.raises(ValueError):
        i.search_one("ATACACAAT", 1.5)
    bloom = sig.bloom_of_sequences(spark.createDataFrame([(0, "ATACACAAC")], "n int, seq string"), "n", "seq", 3, 3, 1000)
    i = i.insert(bloom.union(spark.createDataFrame([(0, 1003)], "n int, row_index int")), "c")
    found = i.search_one("ATACACAAT", 0.5)
    assert [(h["sample_name"], h["percent_kmers_found"]) for h in found[:2]] == [("a", 100.0), ("c", 83.33)]
    with pytest.raises(ValueError):
        i.insert(bloom, "c")
    with pytest.raises(ValueError):
        i.insert(bloom, metadata.DELETED_NAME)
    i = i.delete_sample("a")
    assert "a" not in [h["sample_name"] for h in i.search_one("ATACACAAT", 0.5)] and i.num_cols == 3
    with pytest.raises(ValueError):
        i.delete_sample("nobody")
    before = sorted(map(tuple, sig.untranspose(i.signature()).collect()))
    assert sorted(map(tuple, sig.untranspose(i.compact().signature()).collect())) == before
    with pytest.raises(ValueError):
        Index(spark, i.path, k=5)
    scored = Index(spark, i.path).search_one("ATACACAAC", 1.0, score=True)[0]
    assert scored["kmer-presence"] == "1111111" and scored["length"] == 37
    i.delete()
    with pytest.raises(FileNotFoundError):
        Index(spark, i.path)


def test_merge_equals_building_together(spark, tmp_path):
    samples = [(f"s{n}", s) for n, s in enumerate(["ATACACAAT", "ACAGAGAAC", "GGGTTTACA", "TTTTT", "ACGTACGT"])]
    apart = index(spark, tmp_path, samples[:3], name="x").merge(index(spark, tmp_path, samples[3:], name="y"))
    whole = index(spark, tmp_path, samples, name="z")
    assert sorted(map(tuple, sig.untranspose(apart.signature()).collect())) == sorted(map(tuple, sig.untranspose(whole.signature()).collect()))


@settings(max_examples=4, deadline=None)
@given(rows=st.lists(st.lists(st.booleans(), min_size=10, max_size=10), min_size=5, max_size=10))
def test_transpose_round_trip(spark, rows):
    bits = {(r, c) for r, row in enumerate(rows) for c, x in enumerate(row) if x}
    df = spark.createDataFrame(sorted(bits) or [], "row_index int, colour int")
    assert {tuple(r) for r in sig.untranspose(sig.transpose(df)).collect()} == bits


def test_matrix(spark):
    pattern = ["001", "001", "111", "001", "111"] * 5
    df = spark.createDataFrame([(r, c) for r, row in enumerate(pattern) for c, x in enumerate(row) if x == "1"], "row_index int, colour int")
    s = sig.transpose(df)
    assert [r["bit"] for r in sig.get_column(s, 0, 25).orderBy("row_index").collect()] == [0, 0, 1, 0, 1] * 5
    assert all(r["bit"] == 1 for r in sig.get_column(s, 2, 25).collect())
    changed = sig.set_column(sig.set_column(s, 0, spark.createDataFrame([(3,)], "row_index int")), 3, spark.createDataFrame([(1,)], "row_index int"))
    assert [r["row_index"] for r in sig.get_column(changed, 0, 25).where("bit = 1").collect()] == [3]
    assert [r["row_index"] for r in sig.get_column(changed, 3, 25).where("bit = 1").collect()] == [1]


def test_score_golden(spark):
    want = {
        "length": 1174, "max_mismatches": 269, "max_nident": 1156, "max_pident": 98.46678023850085, "max_score": 1119.98, "min_mismatches": 18, "min_nident": 905, "min_pident": 77.08688245315162,
        "min_score": 96.04, "mismatches": 33, "nident": 1141, "pident": 97.18909710391823, "score": 1064.89, "evalue": 0.0, "pvalue": 0.0, "log_evalue": -1407.74, "log_pvalue": -1407.74,
    }
    df = spark.createDataFrame([(GOLDEN,), (None,)], "s string")
    got, none = (r["x"] for r in df.select(sc.score_presence(F.col("s"), F.lit(500_000)).alias("x")).collect())
    assert got.asDict() == want and all(v is None for v in (none or {}))


def test_variants(spark, tmp_path):
    i = index(spark, tmp_path, [("r", "ACGTACCATG"), ("x", "ACGTAGCATG"), ("both", "ACGTACCATGACGTAGCATG")], k=5, m=5000)
    sites = spark.createDataFrame([("v", "ACGTACCATG", 6, "C", "G")], "variant string, reference string, pos int, ref string, alt string")
    probes = variants.snp_probes(sites, 5)
    assert {(r["kind"], r["seq"]) for r in probes.collect()} == {("ref", "CGTACCATG"), ("alt", "CGTAGCATG")}
    assert {(r["sample_name"], r["genotype"]) for r in i.variant_search(probes).collect()} == {("r", "0/0"), ("x", "1/1"), ("both", "0/1")}
    with pytest.raises(ValueError):
        variants.check_annotation("rpoB", None)


def test_formats(spark, tmp_path):
    i = index(spark, tmp_path, [('a"b', "ATACACAAT"), ("b", "ATACACAAC")])
    asked = spark.createDataFrame([(0, "ATACACAAT"), (1, "GGGGGGG")], "query_id long, seq string")
    hits = i.search(asked, 0.5)
    rows = {r["query_id"]: json.loads(r["json"]) for r in sinks.to_json(search.envelopes(asked, hits, 0.5, "c")).collect()}
    assert set(rows[0]) == {"query", "threshold", "results", "citation"} and rows[1]["results"] == []
    assert [x["sample_name"] for x in rows[0]["results"]] == ['a"b', "b"]
    text = {r["query_id"]: r["csv"] for r in sinks.csv_text(asked, hits).collect()}
    assert text == {0: '"query","num_kmers","num_kmers_found","percent_kmers_found","sample_name"\r\n"ATACACAAT",6,6,100.0,"a""b"\r\n"ATACACAAT",6,5,83.33,"b"\r\n'}
    assert [r["line"] for r in sinks.bulk_csv(asked, hits).collect()][1] == '"ATACACAAT",6,5,83.33,"b"'
    assert len(list(sinks.stream_rows(search.envelopes(asked, hits, 0.5)))) == 2


def test_fasta_manifest_and_stream(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.fa").write_text(">one ref\nACGT\nACGT\n>two\r\nTTTT\r\n")
    rows = [(r["header"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "q")).orderBy("query_id").collect()]
    assert rows == [("one ref", "ACGTACGT"), ("two", "TTTT")]
    (tmp_path / "m.tsv").write_text("a.bloom\ts1\nb.bloom\ts2\n")
    assert [r["sample_name"] for r in fasta.read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("n").collect()] == ["s1", "s2"]
    i = index(spark, tmp_path, [("a", "ACGTACGT")])
    found = []
    done = search_stream(fasta.stream_fasta(spark, str(tmp_path / "q")), i.signature(), i.samples(), 3, 3, 1000, lambda hits, n: found.extend(hits.collect()), checkpoint=str(tmp_path / "c"))
    done.awaitTermination()
    assert [r["sample_name"] for r in found] == ["a"]


def test_filter_files(spark, tmp_path):
    bloom = spark.createDataFrame([("a", 0), ("a", 9), ("b", 12)], "sample string, row_index int")
    bloomfile.write_raw(bloom, "sample", 13, str(tmp_path / "f"))
    assert (tmp_path / "f" / "a.bloom").read_bytes() == bytes([0b10000000, 0b01000000])
    back = bloomfile.read_filters(spark, str(tmp_path / "f"), 13).collect()
    assert sorted((r["path"][-7], r["row_index"]) for r in back) == [("a", 0), ("a", 9), ("b", 12)]


def test_graph_links_and_contigs(spark, tmp_path):
    records = [("ACG", [2, 1], [147, 0]), ("CGT", [1, 1], [8, 1])]
    (tmp_path / "g.ctx").write_bytes(cortex.write_graph(records, 3, ["x", "yy"]))
    rows = cortex.read_graph(spark, str(tmp_path / "g.ctx")).collect()
    assert [(r["kmer"], r["coverages"], r["edges"]) for r in rows] == [("ACG", [2, 1], [147, 0]), ("ACG", [1, 1], [8, 1])]
    graph = cortex.read_graph(spark, str(tmp_path / "g.ctx"))
    assert {(r["direction"], r["next"]) for r in cortex.neighbours(graph.limit(1)).collect()} == {(0, "CGA"), (0, "CGC"), (1, "GTA"), (1, "AAC")}
    assert cortex.graph_kmers(graph, 2).count() == 4
    (tmp_path / "bad.ctx").write_bytes(b"CORTEX" + bytes(30))
    with pytest.raises(Exception, match="version"):
        cortex.read_graph(spark, str(tmp_path / "bad.ctx")).collect()
    head = json.dumps({"file_format": "ctp", "format_version": 3, "graph": {"kmer_size": 3}, "paths": {}})
    (tmp_path / "l.ctp.gz").write_bytes(gzip.compress((head + "\n\n# note\nACG 1\nF 3 1 2,0 T\n").encode()))
    links = cortex.read_links(spark, str(tmp_path / "l.ctp.gz"))
    assert [(r["kmer"], r["direction"], r["counts"], r["junctions"]) for r in links.collect()] == [("ACG", "F", [2, 0], "T")]
    old = json.dumps({"fileFormat": "ctp", "formatVersion": 2, "kmer_size": 3})
    (tmp_path / "old.ctp.gz").write_bytes(gzip.compress((old + "\n\nACG 2\nF 3 1 2,0 T\nR 4 2 1 GA\n").encode()))
    assert [(r["direction"], r["junctions"]) for r in cortex.read_links(spark, str(tmp_path / "old.ctp.gz")).collect()] == [("F", "T"), ("R", "GA")]
    # AAC -> ACC on the only way, then the end.
    known = lambda rows: spark.createDataFrame([(k, [e]) for k, e in rows.items()], "kmer string, edges array<int>")
    seed = spark.createDataFrame([("AAC",)], "seed string")
    fork, link = known({"AAC": 6, "ACC": 0, "ACG": 0}), spark.createDataFrame([("AAC", "F", "G")], "kmer string, direction string, junctions string")
    assert contigs(seed, known({"AAC": 2, "ACC": 0})).first()["contig"] == "AACC"
    # At a fork the link decides.
    assert contigs(seed, fork, link).first()["contig"] == "AACG"
    assert contigs(seed, fork).first()["contig"] == "AAC"


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("k: 31\nm: 1000\nh: 3\nmax_build_mem_bytes: 20GB # cap\nstorage-config:\n  filename: x\n")
    monkeypatch.setenv("SIGLOOM_CONFIG", str(tmp_path / "c.yaml"))
    assert IndexConfig.load() == IndexConfig(k=31, m=1000, h=3, max_build_bytes=20 * 10**9)
    with pytest.raises(ValueError):
        IndexConfig(k=0)


@pytest.mark.parametrize("n", [1, 7, 1000, 4000, 12_345])
def test_percent_rounds_as_python(spark, n):
    rows = spark.range(n + 1).select("id", search.percent_found(F.col("id"), F.lit(n)).alias("p")).collect()
    assert [r["p"] for r in sorted(rows)] == [round(100.0 * i / n, 2) for i in range(n + 1)]


def test_kmers_of_a_long_sequence(spark, monkeypatch):
    """Pieces are rows before their k-mers are: no array is longer than the smallest span."""
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(30_000)) + "é日"
    rows = spark.createDataFrame([(1, seq), (2, "ACGT"), (3, "ACG"), (4, None)], "n int, seq string")
    monkeypatch.setattr(km, "SPANS", (7000, 600))
    got = sorted((r["n"], r["pos"], r["kmer"]) for r in km.occurrences(rows, "n", "seq", 4).collect())
    assert got == [(1, i, seq[i : i + 4]) for i in range(len(seq) - 3)] + [(2, 0, "ACGT")]
    plan = km.occurrences(rows, "n", "seq", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") >= 3


def test_build_in_chunks_and_compression(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"s{i:03d}", "ACGTACGTTG"[i % 5 :] + "ACGT"[i % 4] * 4) for i in range(130)], "n int, sample_name string, seq string")
    whole = Index.build_sequences(spark, IndexConfig(k=3, m=100, h=2, path=str(tmp_path / "w"), compression="snappy"), samples, ["n"])
    parts = Index.build_sequences(spark, IndexConfig(k=3, m=100, h=2, path=str(tmp_path / "p"), max_build_bytes=40 * 113), samples, ["n"])
    assert len(parts.parts) > 2 and len(whole.parts) == 1
    assert sorted(map(tuple, sig.untranspose(parts.signature()).collect())) == sorted(map(tuple, sig.untranspose(whole.signature()).collect()))
    assert list((tmp_path / "w" / "signature").rglob("*.snappy.parquet")) and not list((tmp_path / "p" / "signature").rglob("*.snappy.parquet"))
    with pytest.raises(ValueError):
        Index.build_sequences(spark, IndexConfig(k=3, m=100, h=2, path=str(tmp_path / "q"), max_build_bytes=10), samples, ["n"])


def test_colours_follow_the_order_over_partitions(spark):
    names = spark.createDataFrame([(f"n{(i * 37) % 500:04d}",) for i in range(500)], "sample_name string").repartition(9)
    assert sorted((r["sample_name"], r["colour"]) for r in metadata.assign(names, ["sample_name"], 5).collect()) == [(f"n{i:04d}", i + 5) for i in range(500)]


def test_build_from_files(spark, tmp_path):
    config = IndexConfig(k=3, m=1000, h=3, path=str(tmp_path / "i"))
    (tmp_path / "a.fa").write_text(">x\nATACACAAT\n")
    (tmp_path / "b.ctx").write_bytes(cortex.write_graph([("ACAGA", [1], [0]), ("GAGAA", [1], [0])], 5, ["b"]))
    bloomfile.write_raw(sig.bloom_of_sequences(spark.createDataFrame([("c", "TTTGGG")], "s string, seq string"), "s", "seq", 3, 3, 1000), "s", 1000, str(tmp_path))
    (tmp_path / "m.tsv").write_text("c.bloom\tthird\na.fa\tfirst\nb.ctx\tsecond\n")
    index = Index.build_files(spark, config, manifest=str(tmp_path / "m.tsv"))
    assert [r["sample_name"] for r in index.samples().orderBy("colour").collect()] == ["third", "first", "second"]
    assert [index.search_one(x)[0]["sample_name"] for x in ("ATACACAAT", "ACAGA", "TTTGG")] == ["first", "second", "third"]
    named = Index.build_files(spark, IndexConfig(k=3, m=1000, h=3, path=str(tmp_path / "j")), paths=[str(tmp_path / "a.fa")])
    assert named.samples().first()["sample_name"] == str(tmp_path / "a.fa")
    for bad in ({}, {"manifest": "m", "paths": ["p"]}, {"paths": ["p"], "samples": ["a", "b"]}):
        with pytest.raises(ValueError):
            Index.build_files(spark, config, **bad)


def test_amino_acid_probes(spark):
    gene = spark.createDataFrame([("v", "ATGAAACCCTGG", 2, "K", "M"), ("x", "ATGAAACCCTGG", 1, "M", "X")], "variant string, gene string, pos int, ref string, alt string")
    rows = [tuple(r) for r in variants.amino_acid_probes(gene, 4).collect()]
    assert [r for r in rows if r[0] == "v"] == [("v", "ref", "ATGAAACCC"), ("v", "alt", "ATGATGCCC")]
    assert len([r for r in rows if r[:2] == ("x", "alt")]) == 64 - 3 - 1
    with pytest.raises(Exception, match="another amino acid"):
        variants.amino_acid_probes(gene.where("variant = 'v'").withColumn("ref", F.lit("W")), 4).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(f"k: 3\nm: 1000\nh: 3\npath: {tmp_path}/index\n")
    (tmp_path / "a.fa").write_text(">x\nATACACAAT\n")
    (tmp_path / "q.fa").write_text(">q\nATACACAAT\n>r\nACAGAGAAC\n")

    def run(*args):
        cli.main([args[0], "--config", str(tmp_path / "c.yaml"), *args[1:]], spark)
        return capsys.readouterr().out

    assert json.loads(run("build", str(tmp_path / "a.fa"), "--sample", "a"))["num_samples"] == 1
    (tmp_path / "b.fa").write_text(">y\nACAGAGAAC\n")
    run("bloom", str(tmp_path / "b.fa"), str(tmp_path / "b.bloom"))
    assert (tmp_path / "b.bloom").stat().st_size == 125
    assert json.loads(run("insert", str(tmp_path / "b.bloom"), "b"))["num_samples"] == 2
    assert json.loads(run("search", "ATACACAAT"))["results"][0]["sample_name"] == "a"
    assert run("search", "ACAGAGAAC", "--format", "csv").splitlines()[1] == '"ACAGAGAAC",6,6,100.0,"b"'
    assert [len(x["results"]) for x in json.loads(run("bulk_search", str(tmp_path / "q.fa")))] == [1, 1]
    assert len(run("bulk_search", str(tmp_path / "q.fa"), "--stream").splitlines()) > 2
    (tmp_path / "ref.fa").write_text(">r\nATACACAAT\n")
    # TACAC is in the sequence as it is, and so are all k-mers of TATAC.
    assert json.loads(run("variant_search", str(tmp_path / "ref.fa"), "C", "4", "T"))[0]["genotype"] == "0/1"
    run("delete_sample", "a")
    assert json.loads(run("search", "ATACACAAT"))["results"] == [] and json.loads(run("num_samples"))["num_samples"] == 2
    run("delete")
    with pytest.raises(FileNotFoundError):
        run("search", "ATACACAAT")


def test_tables_in_few_parts_are_dealt(spark):
    few = spark.range(100).coalesce(1)
    assert dealt(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt(few).count() == 100
    assert dealt(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Unset:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Unset()

    class Session:
        sparkContext, conf = Context(), Unset()

    with pytest.raises(RuntimeError):
        stage.shared_dir(Session())
    table = stage.staged(spark.range(3), "x")
    stage.release(table)
    with pytest.raises(Exception):
        table.count()


def test_components_of_the_graph(spark, tmp_path):
    (tmp_path / "g.ctx").write_bytes(cortex.write_graph([("AAC", [1], [2]), ("ACC", [1], [0]), ("GGA", [1], [0])], 3, ["x"]))
    rows = cortex.with_components(cortex.read_graph(spark, str(tmp_path / "g.ctx"))).collect()
    assert {(r["kmer"], r["component"]) for r in rows} == {("AAC", "AAC"), ("ACC", "AAC"), ("GGA", "GGA")}
