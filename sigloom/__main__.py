"""Command line: `python -m sigloom <verb> ...`, or the same by spark-submit.

Results go to standard output as JSON (or CSV for the searches). Settings come from --config, a file as `IndexConfig.load` reads it.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigloom.operators import search as so
from sigloom.operators import signature as sig
from sigloom.operators import variants
from sigloom.plans.config import IndexConfig
from sigloom.plans.index import Index
from sigloom.plans.session import ship
from sigloom.sources import bloomfile, cortex, fasta, genbank, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sigloom")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, **options: dict) -> argparse.ArgumentParser:
        one = verbs.add_parser(name, **options)
        one.add_argument("--config")
        return one

    one = verb("bloom", help="filter file of a graph or FASTA file")
    one.add_argument("source")
    one.add_argument("outfile")
    one = verb("build", help="index of a manifest or of files")
    one.add_argument("files", nargs="*")
    one.add_argument("--from-file")
    one.add_argument("--sample", action="append")
    one = verb("insert", help="one more sample from a filter file")
    one.add_argument("file")
    one.add_argument("sample")
    one = verb("merge", help="another index after this one")
    one.add_argument("other", help="path of the other index")
    one = verb("delete_sample")
    one.add_argument("sample")
    verb("delete")
    verb("tidy", help="merge parts of about one size")
    one = verb("compact", help="make one part of all")
    one.add_argument("--purge", action="store_true", help="without deleted samples")
    one = verb("vacuum", help="remove what no commit that is kept needs")
    one.add_argument("--keep", type=int, default=1)
    one.add_argument("--older-than", type=float, default=86_400.0, help="seconds")
    verb("num_samples")
    for name in ("search", "bulk_search"):
        one = verb(name)
        one.add_argument("query", help="a sequence" if name == "search" else "a FASTA file")
        one.add_argument("--threshold", type=float, default=1.0)
        one.add_argument("--score", action="store_true")
        one.add_argument("--format", choices=("json", "csv"), default="json")
        one.add_argument("--stream", action="store_true", help="one query at a time")
    one = verb("variant_search", help="genotypes of a base or, with --gene, of an amino acid")
    one.add_argument("reference", help="FASTA file: the reference, or with --gene the gene's coding sequence")
    one.add_argument("ref")
    one.add_argument("pos", type=int)
    one.add_argument("alt")
    one.add_argument("--gene")
    one.add_argument("--genbank", help="annotated sequence that has the gene; the reference is then not read")
    return parser


def _search(index: Index, queries, args: argparse.Namespace) -> None:
    so.warn_short(queries, index.k)
    hits = index.search(queries, args.threshold, args.score)
    if args.format == "csv":
        if args.verb == "search":
            for row in sinks.csv_text(queries, hits).collect():
                sys.stdout.write(row["csv"])
        else:
            for row in sinks.bulk_csv(queries, hits).toLocalIterator():
                print(row["line"])
        return
    rows = sinks.stream_rows(so.envelopes(queries, hits, args.threshold))
    if args.verb == "search" or args.stream:
        for text in rows:
            print(text)
    else:
        print("[" + ",\n".join(rows) + "]")


def _probes(spark: SparkSession, args: argparse.Namespace, k: int):
    if args.genbank:
        variants.check_annotation(args.gene, args.genbank)
        site = spark.createDataFrame([(f"{args.gene}_{args.ref}{args.pos}{args.alt}", args.gene, args.pos, args.ref, args.alt)], "variant string, gene string, pos int, ref string, alt string")
        return variants.amino_acid_probes(genbank.amino_acid_sites(site, genbank.read_features(spark, args.genbank)), k)
    seq = fasta.read_fasta(spark, args.reference).orderBy("query_id").first()["seq"]
    name = "_".join(x for x in (args.gene, f"{args.ref}{args.pos}{args.alt}") if x)
    site = spark.createDataFrame([(name, seq, args.pos, args.ref, args.alt)], "variant string, seq string, pos int, ref string, alt string")
    if args.gene:
        return variants.amino_acid_probes(site.withColumnRenamed("seq", "gene"), k)
    if args.alt == "X":
        site = site.withColumn("alt", F.explode(F.array(*(F.lit(b) for b in "ACGT" if b != args.ref))))
    elif len(args.ref) != 1 or len(args.alt) != 1:
        none = spark.createDataFrame([], "contig int, pos int, ref string, alt string")
        return variants.probes_on_backgrounds(site.withColumnRenamed("seq", "reference").withColumn("contig", F.lit(0)), none, k)
    return variants.snp_probes(site.withColumnRenamed("seq", "reference"), k)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName("sigloom").getOrCreate())
    config = IndexConfig.load(args.config)
    if args.verb == "bloom":
        if args.source.endswith(".ctx"):
            kmers = cortex.graph_kmers(cortex.read_graph(spark, args.source), config.k)
            bloom = sig.bloom_of_kmers(kmers, "path", config.h, config.m)
        else:
            bloom = sig.bloom_of_sequences(fasta.read_sequences(spark, args.source), "path", "seq", config.k, config.h, config.m)
        bloomfile.write_file(bloom.withColumn("path", F.lit("all")), config.m, args.outfile)
        print(json.dumps({"result": "success"}))
    elif args.verb == "build":
        index = Index.build_files(spark, config, args.from_file, args.files or None, args.sample)
        print(json.dumps({"result": "success", "num_samples": index.num_samples(), "config": dataclasses.asdict(config)}))
    elif args.verb == "delete":
        Index(spark, config.path).delete()
        print(json.dumps({"result": "success"}))
    else:
        index = Index(spark, config.path)
        if args.verb in ("search", "bulk_search"):
            queries = spark.createDataFrame([(0, args.query)], "query_id long, seq string") if args.verb == "search" else fasta.read_fasta(spark, args.query).select("query_id", "seq")
            _search(index, queries, args)
        elif args.verb == "variant_search":
            rows = index.variant_search(_probes(spark, args, index.k)).orderBy("variant", "sample_name").toLocalIterator()
            print(json.dumps([r.asDict() for r in rows], indent=4))
        elif args.verb == "num_samples":
            print(json.dumps({"num_samples": index.num_samples()}))
        else:
            if args.verb == "insert":
                index = index.insert(bloomfile.read_filters(spark, args.file, index.m), args.sample)
            elif args.verb == "merge":
                index = index.merge(Index(spark, args.other))
            elif args.verb == "tidy":
                index = index.tidy()
            elif args.verb == "compact":
                index = index.compact(args.purge)
            elif args.verb == "vacuum":
                index.vacuum(args.keep, args.older_than)
            else:
                index = index.delete_sample(args.sample)
            print(json.dumps({"result": "success", "num_samples": index.num_samples()}))


if __name__ == "__main__":
    main()
