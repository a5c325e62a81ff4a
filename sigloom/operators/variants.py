"""Genotypes from two exact searches: with the probes of the reference allele and with those of the alternative."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators.search import search_sequences


def variant_name(ref: Column, pos: Column, alt: Column | None = None, gene: Column | None = None) -> Column:
    name = F.concat(ref, pos.cast("string"), F.lit("X") if alt is None else alt)
    return name if gene is None else F.concat_ws("_", gene, name)


def probes_of_headers(records: DataFrame) -> DataFrame:
    """variant, kind, seq from (variant, header, seq): a header that contains `ref` marks the reference allele."""
    return records.select("variant", F.when(F.col("header").contains("ref"), "ref").otherwise("alt").alias("kind"), "seq")


def snp_probes(sites: DataFrame, k: int) -> DataFrame:
    """variant, kind, seq from (variant, reference, pos, ref, alt): k-1 bases on both sides; pos counts from 1.

    A site whose reference base differs from `ref` raises an error.
    """
    right = F.substring(F.col("reference"), F.col("pos") + 1, F.lit(k - 1))
    start = F.greatest(F.lit(1), F.col("pos") - (k - 1))
    left = F.substring(F.col("reference"), start, F.col("pos") - start)
    right_base = F.assert_true(F.substring(F.col("reference"), F.col("pos"), F.lit(1)) == F.col("ref"), F.lit("the reference has another base there")).isNull()
    both = F.array(F.struct(F.lit("ref").alias("kind"), F.concat(left, "ref", right).alias("seq")), F.struct(F.lit("alt").alias("kind"), F.concat(left, "alt", right).alias("seq")))
    return sites.where(right_base).select("variant", F.explode(both).alias("p")).select("variant", "p.kind", "p.seq")


def neighbours(sites: DataFrame, background: DataFrame, k: int) -> DataFrame:
    """variant, near: for each site (variant, contig, pos, ref) the variants (pos, ref, alt) of `background` (contig, pos, ref, alt) that a probe of it may hold.

    A binned interval join: a site asks the bins that its window touches. Variants that overlap the site's own bases are no neighbours.
    The window is `reach` bases wide on either side: k - 1, and what the longest background allele takes away.
    """
    longest = background.agg(F.coalesce(F.max(F.char_length("ref")), F.lit(0)).alias("n")).first()["n"]
    reach, size = k - 1 + longest, 4 * (k + longest)
    first, behind = F.col("pos") - reach, F.col("pos") + F.char_length("ref") + reach
    bins = F.explode(F.sequence(F.floor(first / size), F.floor(behind / size)))
    asked = sites.select("variant", "contig", F.col("pos").alias("_pos"), (F.col("pos") + F.char_length("ref")).alias("_end"), first.alias("_first"), behind.alias("_behind"), bins.alias("_bin"))
    held = background.select("contig", "pos", "ref", "alt", F.floor(F.col("pos") / size).alias("_bin")).distinct()
    met = asked.join(held, ["contig", "_bin"]).where((F.col("pos") >= F.col("_first")) & (F.col("pos") < F.col("_behind")))
    apart = met.where((F.col("pos") + F.char_length("ref") <= F.col("_pos")) | (F.col("pos") >= F.col("_end")))
    return apart.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))).alias("near"))


def _left(reference: Column, pos: Column, near: Column, k: int) -> Column:
    """The k-1 bases before a site with any choice of the variants there that do not overlap each other."""
    before = F.reverse(F.filter(near, lambda n: n["pos"] + F.char_length(n["ref"]) <= pos))
    start = F.array(F.struct(F.lit("").alias("text"), pos.cast("int").alias("at")))

    def apply(state: Column, n: Column) -> Column:
        end = n["pos"] + F.char_length(n["ref"])
        taken = F.struct(F.concat(n["alt"], F.substring(reference, end, state["at"] - end), state["text"]).alias("text"), n["pos"].cast("int").alias("at"))
        return F.when(end <= state["at"], F.array(state, taken)).otherwise(F.array(state))

    every = F.aggregate(before, start, lambda states, n: F.flatten(F.transform(states, lambda s: apply(s, n))))
    whole = F.transform(every, lambda s: F.concat(F.substring(reference, F.greatest(F.lit(1), s["at"] - (k - 1)), s["at"] - F.greatest(F.lit(1), s["at"] - (k - 1))), s["text"]))
    return F.array_distinct(F.transform(whole, lambda t: F.right(t, F.lit(k - 1))))


def _right(reference: Column, end: Column, near: Column, k: int) -> Column:
    """The k-1 bases from `end` on in the same way."""
    start = F.array(F.struct(F.lit("").alias("text"), end.cast("int").alias("at")))

    def apply(state: Column, n: Column) -> Column:
        text = F.concat(state["text"], F.substring(reference, state["at"], n["pos"] - state["at"]), n["alt"])
        taken = F.struct(text.alias("text"), (n["pos"] + F.char_length(n["ref"])).cast("int").alias("at"))
        return F.when(n["pos"] >= state["at"], F.array(state, taken)).otherwise(F.array(state))

    every = F.aggregate(F.filter(near, lambda n: n["pos"] >= end), start, lambda states, n: F.flatten(F.transform(states, lambda s: apply(s, n))))
    return F.array_distinct(F.transform(every, lambda s: F.left(F.concat(s["text"], F.substring(reference, s["at"], F.lit(k - 1))), F.lit(k - 1))))


def probes_on_backgrounds(sites: DataFrame, background: DataFrame, k: int, most: int = 12) -> DataFrame:
    """variant, kind, seq from (variant, contig, reference, pos, ref, alt): alleles of any length, on every haplotype of the variants around.

    `background` has (contig, pos, ref, alt); positions count from 1. Each probe has k-1 bases on both sides of the allele where the reference
    has them. More than `most` variants around a site are an error, as haplotypes double with each; so are bases that the reference does not have.
    """
    none = F.array().cast(f"array<struct<pos:{background.schema['pos'].dataType.simpleString()},ref:string,alt:string>>")
    known = sites.join(neighbours(sites, background, k), "variant", "left").withColumn("near", F.coalesce("near", none))
    reference, pos, near = F.col("reference"), F.col("pos"), F.col("near")
    there = lambda at, ref: F.substring(reference, at, F.char_length(ref)) == ref
    right_bases = F.assert_true(there(pos, F.col("ref")) & F.forall(near, lambda n: there(n["pos"], n["ref"])), F.lit("the reference has other bases there")).isNull()
    few = F.assert_true(F.size(near) <= most, F.lit(f"more than {most} variants around a site")).isNull()
    own = known.where(right_bases & few).select("variant", "ref", "alt", _left(reference, pos, near, k).alias("left"), _right(reference, pos + F.char_length("ref"), near, k).alias("right"))

    def probes(kind: str) -> Column:
        return F.flatten(F.transform("left", lambda x: F.transform(F.col("right"), lambda y: F.struct(F.lit(kind).alias("kind"), F.concat(x, F.col(kind), y).alias("seq")))))

    return own.select("variant", F.explode(F.array_distinct(F.concat(probes("ref"), probes("alt")))).alias("p")).select("variant", "p.kind", "p.seq")


# Fixed value: the standard genetic code, codons in the order of the bases T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


_CODONS = [("".join(c), CODE[i]) for i, c in enumerate(product("TCAG", repeat=3))]


def amino_acid(codon: Column) -> Column:
    """The letter of a codon, * for a stop; null for anything else."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _CODONS for x in pair)), codon)


def amino_acid_probes(sites: DataFrame, k: int) -> DataFrame:
    """variant, kind, seq from (variant, gene, pos, ref, alt): the gene's coding sequence, codon pos counted from 1, amino acids.

    The gene's own codon gives the ref probe, every codon of `alt` (X: of any other amino acid) an alt probe, with k-1 bases on both sides.
    A codon of another amino acid than `ref` raises an error.
    """
    start = (F.col("pos") - 1) * 3 + 1
    first = F.greatest(F.lit(1), start - (k - 1))
    own = sites.select(
        "variant", "ref", "alt", F.substring(F.col("gene"), start, F.lit(3)).alias("codon"),
        F.substring(F.col("gene"), first, start - first).alias("left"), F.substring(F.col("gene"), start + 3, F.lit(k - 1)).alias("right"),
    )
    right_one = F.assert_true(F.coalesce(amino_acid(F.col("codon")) == F.col("ref"), F.lit(False)), F.lit("the gene has another amino acid there")).isNull()
    every = F.array(*(F.struct(F.lit(c).alias("codon"), F.lit(a).alias("letter")) for c, a in _CODONS))
    wanted = F.filter(every, lambda c: (c["letter"] == F.col("alt")) | ((F.col("alt") == "X") & (c["letter"] != "*") & (c["letter"] != F.col("ref"))))
    probes = F.concat(F.array(F.struct(F.lit("ref").alias("kind"), F.col("codon").alias("codon"))), F.transform(wanted, lambda c: F.struct(F.lit("alt").alias("kind"), c["codon"].alias("codon"))))
    each = own.where(right_one).select("variant", "left", "right", F.explode(probes).alias("p"))
    return each.select("variant", "p.kind", F.concat("left", "p.codon", "right").alias("seq"))


def genotypes(refs: DataFrame, alts: DataFrame) -> DataFrame:
    """variant, sample_name, genotype: 0/1 with both alleles, 0/0 with the reference, 1/1 with the alternative."""
    marks = refs.select("variant", "sample_name", F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(alts.select("variant", "sample_name", F.lit(0).alias("r"), F.lit(1).alias("a")))
    seen = marks.groupBy("variant", "sample_name").agg(F.max("r").alias("r"), F.max("a").alias("a"))
    kind = F.when((F.col("r") == 1) & (F.col("a") == 1), "0/1").when(F.col("r") == 1, "0/0").otherwise("1/1")
    return seen.select("variant", "sample_name", kind.alias("genotype"))


def as_queries(probes: DataFrame) -> DataFrame:
    """query_id (variant, kind, seq), seq of the distinct probes."""
    return probes.select(F.struct("variant", "kind", "seq").alias("query_id"), "seq").distinct()


def of_hits(hits: DataFrame) -> DataFrame:
    """Genotypes from the exact hits of `as_queries`; a sample has an allele if any of the allele's probes is found whole."""
    named = hits.select("query_id.variant", "query_id.kind", "sample_name")
    return genotypes(named.where("kind = 'ref'"), named.where("kind = 'alt'"))


def variant_search(probes: DataFrame, samples: DataFrame, k: int, h: int, m: int) -> DataFrame:
    """Genotypes of every variant in samples given by their sequences (colour, sample_name, deleted, seq)."""
    return of_hits(search_sequences(as_queries(probes), samples, k, h, m, 1.0))


def check_annotation(gene: str | None, genbank: str | None) -> None:
    if (gene is None) != (genbank is None):
        raise ValueError("a gene and its annotation file come together")
