"""Annotated sequences in the GenBank flat format: features with joined and complementary locations, and their coding sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import kmers as km

SPAN = "array<struct<start:int,end:int>>"
FEATURE = f"contig string, kind string, gene string, complement boolean, spans {SPAN}, sequence string"
#: Columns of the flat format: where a feature's name begins, and where its location and qualifiers do.
NAME, REST = 5, 21


def spans_of(location: str) -> tuple[bool, list[tuple[int, int]]]:
    """Whether a location is on the other strand, and its spans in the order in which they are read, on the strand written down.

    complement(join(a,b)) and join(complement(b),complement(a)) are the same; marks of open ends are passed over.
    """
    text = re.sub(r"[\s<>]", "", location)
    flipped = [bool(x) for x, _, _ in re.findall(r"(complement\()?(\d+)(?:\.\.(\d+))?", text)]
    spans = [(int(a), int(b or a)) for a, b in re.findall(r"(\d+)(?:\.\.(\d+))?", text)]
    if text.startswith("complement(") or (flipped and all(flipped)):
        return True, sorted(spans)
    if any(flipped):
        raise ValueError(f"a location on both strands: {location}")
    return False, spans


def features_of(record: str) -> tuple[str, list[tuple], str]:
    """The name of a record, its features (kind, qualifiers, location) and its sequence."""
    head, _, origin = record.partition("\nORIGIN")
    found = re.search(r"^(?:LOCUS|ACCESSION)\s+(\S+)", head, re.M)
    table = re.search(r"^FEATURES[^\n]*\n((?:[ ].*\n?)*)", head, re.M)
    features: list[list] = []
    for line in (table[1] if table else "").splitlines():
        name, rest = line[NAME : REST - 1].strip(), line[REST:].strip()
        if name:
            features.append([name, rest, []])
        elif features and (rest.startswith("/") or features[-1][2]):
            if rest.startswith("/"):
                features[-1][2].append(rest)
            else:
                features[-1][2][-1] += " " + rest
        elif features:
            features[-1][1] += rest
    rows = []
    for kind, location, qualifiers in features:
        values = dict(re.match(r'/([^=]+)=?"?([^"]*)', q).groups() for q in qualifiers)
        rows.append((kind, values.get("gene") or values.get("locus_tag"), location))
    return found[1] if found else "", rows, re.sub("[^A-Za-z]", "", origin.partition("\n//")[0].partition("\n")[2]).upper()


def _rows(kinds: tuple[str, ...]):
    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(0).to_pylist():
                contig, features, sequence = features_of(record)
                rows = []
                for kind, gene, location in features:
                    if kind in kinds and gene:
                        flipped, spans = spans_of(location)
                        # Only the bases of the feature go on, not the whole sequence with each.
                        rows.append((contig, kind, gene, flipped, [{"start": a, "end": b} for a, b in spans], "".join(sequence[a - 1 : b] for a, b in spans)))
                columns = zip(*rows, strict=True) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["contig", "kind", "gene", "complement", "spans", "sequence"])

    return run


def read_features(spark: SparkSession, path: str | list[str], kinds: tuple[str, ...] = ("CDS",)) -> DataFrame:
    """contig, kind, gene, complement, spans, sequence (as it is read: joined, and the other strand's where that is meant) of the features that name a gene.

    Records are split at their end marks by Spark, so one record is a value, and a file of many records is read by many tasks.
    """
    records = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").contains("FEATURES"))
    found = records.mapInArrow(_rows(kinds), FEATURE)
    return found.withColumn("sequence", F.when(F.col("complement"), km.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def genes_at(positions: DataFrame, features: DataFrame, size: int = 1 << 14) -> DataFrame:
    """The rows of `positions` (contig, pos) with gene, codon (from 1) and base (1 to 3 of it) of each feature that holds the position.

    A binned interval join: each span goes to the bins that it touches, a position to one.
    """
    place = features.select("contig", "gene", "complement", F.posexplode("spans").alias("nth", "span"), F.col("spans").alias("_spans"))
    before = F.aggregate(F.slice("_spans", F.lit(1), F.col("nth")), F.lit(0), lambda n, s: n + s["end"] - s["start"] + 1)
    total = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"] + 1)
    spans = place.select("contig", "gene", "complement", F.col("span.start").alias("_start"), F.col("span.end").alias("_end"), before.alias("_before"), total.alias("_total"))
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor(F.col("_end") / size))))
    met = positions.withColumn("_bin", F.floor(F.col("pos") / size)).join(binned, ["contig", "_bin"]).where((F.col("pos") >= F.col("_start")) & (F.col("pos") <= F.col("_end")))
    at = F.col("_before") + F.col("pos") - F.col("_start")
    read = F.when(F.col("complement"), F.col("_total") - 1 - at).otherwise(at)
    return met.select(*positions.columns, "gene", (F.floor(read / 3) + 1).cast("int").alias("codon"), (read % 3 + 1).cast("int").alias("base"))


def amino_acid_sites(sites: DataFrame, features: DataFrame) -> DataFrame:
    """variant, gene (the coding sequence), pos, ref, alt for `variants.amino_acid_probes`: from (variant, gene name, pos, ref, alt)."""
    return sites.withColumnRenamed("gene", "_name").join(features.select(F.col("gene").alias("_name"), F.col("sequence").alias("gene")), "_name").select("variant", "gene", "pos", "ref", "alt")
