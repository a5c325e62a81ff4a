"""Binary de Bruijn graphs (version 6) and their link files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import kmers as km
from sigloom.operators.graph import components
from sigloom.sources import binary

MAGIC, VERSION = b"CORTEX", 6

RECORD = "path string, kmer_size int, kmer string, coverages array<bigint>, edges array<int>"
LINK = "path string, kmer string, direction string, num_kmers int, counts array<int>, junctions string"


def header(data: bytes) -> tuple[int, int, int, int]:
    """k-mer size, 64-bit words of a k-mer, colours, and where the records begin."""
    if data[:6] != MAGIC:
        raise ValueError("not a graph file")
    version, size, words, colours = struct.unpack_from("<4I", data, 6)
    if version != VERSION:
        raise ValueError(f"graph version {version}; only {VERSION} is known")
    at = 22 + 12 * colours  # mean read length and total sequence
    for _ in range(colours):  # names
        at += 4 + struct.unpack_from("<I", data, at)[0]
    at += 16 * colours  # error rates
    for _ in range(colours):  # cleaning
        at += 12
        at += 4 + struct.unpack_from("<I", data, at)[0]
    if at + len(MAGIC) > len(data):
        raise IndexError("more of the file is needed")
    if data[at : at + 6] != MAGIC:
        raise ValueError("the graph's header does not end where it should")
    return size, words, colours, at + 6


def _decode(values: np.ndarray, size: int) -> list[str]:
    shifts = np.arange(size - 1, -1, -1, dtype=np.uint64) * np.uint64(2)
    codes = (values[:, None] >> shifts & np.uint64(3)).astype(np.uint8)
    letters = np.frombuffer(km.ALPHABET.encode(), np.uint8)[codes]
    return letters.view(f"S{size}").ravel().astype(str).tolist() if len(values) else []


class Graphs(binary.Format):
    """A record is a k-mer of up to 31 bases, its coverages and its edge bytes."""

    name = "sigloom_graphs"
    columns = dict(c.split(" ", 1) for c in RECORD.split(", "))

    @staticmethod
    def layout(head: bytes) -> binary.Layout:
        size, words, colours, at = header(head)
        if words != 1 or size > 31:
            raise ValueError("k-mers of more than 31 bases are not supported")
        return binary.Layout(at, 8 + 5 * colours)

    @staticmethod
    def decode(path: str, head: bytes, n: int, data: bytes, wanted: list[str]) -> dict[str, pa.Array]:
        size, _, colours, _ = header(head)
        part = np.frombuffer(data, np.dtype([("kmer", "<u8"), ("coverage", "<u4", (colours,)), ("edges", "u1", (colours,))]))
        bounds = pa.array(np.arange(len(part) + 1, dtype=np.int32) * colours)
        made = {
            "path": lambda: pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), [path]).cast(pa.string()),
            "kmer_size": lambda: pa.array(np.full(len(part), size, np.int32)),
            "kmer": lambda: pa.array(_decode(part["kmer"], size), pa.string()),
            "coverages": lambda: pa.ListArray.from_arrays(bounds, pa.array(part["coverage"].astype(np.int64).ravel())),
            "edges": lambda: pa.ListArray.from_arrays(bounds, pa.array(part["edges"].astype(np.int32).ravel())),
        }
        return {c: made[c]() for c in wanted}


def read_graph(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """path, kmer_size, kmer (canonical), coverages and edges (a byte for each colour), or some of these; many tasks read a file."""
    found = binary.read(spark, Graphs, path, columns)
    return found.withColumn("kmer", km.canonical(F.col("kmer"))) if "kmer" in found.columns else found


def graph_kmers(graph: DataFrame, k: int) -> DataFrame:
    """path, kmer: the k-mers of size k of the records."""
    return graph.select("path", F.explode(km.kmers(F.col("kmer"), k)).alias("kmer"))


def neighbours(graph: DataFrame, colour: int = 0) -> DataFrame:
    """kmer, direction (0 forward, 1 backward), next: the edges of the graph."""
    edges = F.get(F.col("edges"), F.lit(colour))
    ways = F.array(*(F.struct(F.lit(d).alias("direction"), km.adjacent(F.col("kmer"), edges, d == 0).alias("next")) for d in (0, 1)))
    return graph.select("kmer", F.explode(ways).alias("w")).select("kmer", "w.direction", F.explode("w.next").alias("next"))


def _head(size: int, names: list[str]) -> bytes:
    out = [MAGIC, struct.pack("<4I", VERSION, size, 1, len(names)), bytes(12 * len(names))]
    out += [struct.pack("<I", len(n)) + n.encode() for n in names]
    return b"".join([*out, bytes(16 * len(names)), *(bytes(12) + struct.pack("<I", 0) for _ in names), MAGIC])


def _encoded(kmers: list[str], coverages: list[list[int]], edges: list[list[int]], size: int, colours: int) -> bytes:
    out = np.zeros(len(kmers), np.dtype([("kmer", "<u8"), ("coverage", "<u4", (colours,)), ("edges", "u1", (colours,))]))
    if kmers:
        letters = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(len(kmers), size)
        codes = np.searchsorted(np.frombuffer(km.ALPHABET.encode(), np.uint8), letters).astype(np.uint64)
        shifts = np.arange(size - 1, -1, -1, dtype=np.uint64) * np.uint64(2)
        out["kmer"] = np.bitwise_or.reduce(codes << shifts, axis=1)
        out["coverage"], out["edges"] = np.array(coverages), np.array(edges)
    return out.tobytes()


def write_graph(records: list[tuple[str, list[int], list[int]]], size: int, names: list[str]) -> bytes:
    """A graph file of (kmer, coverages, edge bytes); for tests and small exports."""
    kmers, coverages, edges = ([r[i] for r in records] for i in range(3))
    return _head(size, names) + _encoded(kmers, coverages, edges, size, len(names))


def write_graphs(records: DataFrame, size: int, names: list[str], directory: str) -> None:
    """(kmer, coverages, edges) as graph files, one for each task that has rows; all appear, or none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        some = (x for x in batches if len(x))
        first = next(some, None)
        if first is not None:
            own = (_encoded(*(x.column(i).to_pylist() for i in range(3)), size, len(names)) for x in chain([first], some))
            yield binary.part_name("ctx"), chain([_head(size, names)], own)

    binary.write(records.select("kmer", "coverages", "edges"), directory, encode)


def write_links(links: DataFrame, size: int, directory: str) -> None:
    """(kmer, direction, num_kmers, counts, junctions) as gzipped link files of version 3, one for each task that has rows, by Spark's text writer."""
    top = json.dumps({"file_format": "ctp", "format_version": 3, "graph": {"kmer_size": size}, "paths": {}})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            # An entry is one value of many lines, so a k-mer's links stay together.
            out = [] if begun or not len(batch) else [top + "\n"]
            begun = begun or len(batch) > 0
            for kmer, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append("\n".join([f"{kmer} {len(own)}", *(f"{r['direction']} {r['num_kmers']} {len(r['junctions'])} {','.join(map(str, r['counts']))} {r['junctions']}" for r in own)]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    own = links.groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("direction", "num_kmers", "counts", "junctions"))).alias("links"))
    own.mapInArrow(lines, "value string").write.mode("append").option("compression", "gzip").text(directory)


class _Links:
    """The lines of one link file, one after the other."""

    def __init__(self) -> None:
        self.top: list[str] | None = []
        self.kmer, self.left = "", 0

    def row(self, line: str) -> tuple | None:
        """The link that a line holds, if it does."""
        if self.top is not None:
            self.top.append(line)
            if line.rstrip().endswith("}"):
                try:
                    meta = json.loads("\n".join(self.top))
                except ValueError:
                    return None  # a brace inside the header
                kind, version = (meta.get("fileFormat"), meta.get("formatVersion")) if "fileFormat" in meta else (meta.get("file_format"), meta.get("format_version"))
                if kind != "ctp" or version not in (2, 3):
                    raise ValueError("not a link file of version 2 or 3")
                self.top = None
            return None
        fields = line.split()
        if not fields or line.lstrip().startswith("#"):
            return None
        if not self.left:
            self.kmer, self.left = fields[0], int(fields[1])
            return None
        direction, n, junctions, counts, bases = fields[:5]
        if len(bases) != int(junctions):
            raise ValueError(f"{self.kmer}: {junctions} junctions expected, {bases} found")
        self.left -= 1
        return self.kmer, direction, int(n), [int(x) for x in counts.split(",")], bases


def read_links(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, kmer, direction, num_kmers, counts, junctions of gzipped link files (versions 2 and 3), line by line.

    Spark reads a gzipped file in one task and its lines in order, of any length in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, _Links()
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            rows = []
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != name:
                    name, state = path, _Links()
                found = state.row(line)
                if found:
                    rows.append((path, *found))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "kmer", "direction", "num_kmers", "counts", "junctions"])

    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(run, LINK)


def with_components(graph: DataFrame, colour: int = 0) -> DataFrame:
    """The graph with `component`: the smallest k-mer of its connected part."""
    edges = neighbours(graph, colour).select(F.col("kmer").alias("a"), F.col("next").alias("b"))
    own = graph.select(F.col("kmer").alias("a"), F.col("kmer").alias("b"))
    labels = components(edges.join(graph.select(F.col("kmer").alias("b")), "b", "left_semi").unionByName(own))
    return graph.join(labels.select(F.col("node").alias("kmer"), F.col("label").alias("component")), "kmer")
