"""Features of annotated sequences: either strand, spliced, and the mutations in them."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import variants
from sigloom.sources import genbank

FLIP = str.maketrans("ACGT", "TGCA")


def record(name, sequence, features):
    lines = [f"LOCUS       {name}   {len(sequence)} bp    DNA", "DEFINITION  made for a test", "FEATURES             Location/Qualifiers", f"     source          1..{len(sequence)}", '                     /organism="none"']
    for kind, gene, location in features:
        lines += [f"     {kind:<16}{location[:30]}", *([" " * 21 + location[30:]] if location[30:] else []), f'                     /gene="{gene}"', '                     /note="a note of more', '                     than one line"']
    lines.append("ORIGIN")
    for i in range(0, len(sequence), 60):
        lines.append(f"{i + 1:>9} " + " ".join(sequence[i + j : i + j + 10].lower() for j in range(0, 60, 10)))
    return "\n".join([*lines, "//", ""])


@pytest.fixture
def annotated(tmp_path):
    rng = random.Random(6)
    one, two = ("".join(rng.choice("ACGT") for _ in range(700)) for _ in range(2))
    features = [("gene", "plain", "11..40"), ("CDS", "plain", "11..40"), ("CDS", "spliced", "join(101..130,201..206,301..324)"), ("CDS", "other", "complement(401..460)"), ("CDS", "both", "complement(join(501..530,601..612,651..659,671..671))"), ("CDS", "parts", "join(complement(601..612),complement(501..530))")]
    (tmp_path / "a.gb").write_text(record("one", one, features) + record("two", two, [("CDS", "open", "<1..>9")]))
    return str(tmp_path / "a.gb"), {"one": one, "two": two}


def test_coding_sequences(spark, annotated):
    path, seqs = annotated
    got = {r["gene"]: r["sequence"] for r in genbank.read_features(spark, path).collect()}
    one = seqs["one"]
    back = lambda s: s.translate(FLIP)[::-1]
    assert got == {
        "plain": one[10:40], "spliced": one[100:130] + one[200:206] + one[300:324], "other": back(one[400:460]), "both": back(one[500:530] + one[600:612] + one[650:659] + one[670:671]),
        "parts": back(one[500:530] + one[600:612]), "open": seqs["two"][:9],
    }
    assert [(r["gene"], r["kind"]) for r in genbank.read_features(spark, path, ("gene",)).collect()] == [("plain", "gene")]
    with pytest.raises(ValueError, match="both strands"):
        genbank.spans_of("join(1..5,complement(8..9))")


def test_mutations_meet_their_genes(spark, annotated):
    path, seqs = annotated
    features = genbank.read_features(spark, path)
    every = spark.createDataFrame([(c, p) for c in seqs for p in range(1, 701)], "contig string, pos int")
    want = set()
    for r in features.collect():
        places = [p for s in r["spans"] for p in range(s["start"], s["end"] + 1)]
        for i, p in enumerate(reversed(places) if r["complement"] else places):
            base = seqs[r["contig"]][p - 1]
            assert r["sequence"][i] == (base.translate(FLIP) if r["complement"] else base)
            want.add((r["contig"], p, r["gene"], i // 3 + 1, i % 3 + 1))
    for size in (16, 1 << 14):
        assert {tuple(r) for r in genbank.genes_at(every, features, size).collect()} == want


def test_amino_acids_of_an_annotated_gene(spark, annotated):
    path, _ = annotated
    features = genbank.read_features(spark, path)
    sites = features.where("gene IN ('other', 'spliced')").select(F.concat("gene", F.lit("_3")).alias("variant"), "gene", F.lit(3).alias("pos"), variants.amino_acid(F.substring("sequence", 7, 3)).alias("ref"), F.lit("W").alias("alt"))
    probes = variants.amino_acid_probes(genbank.amino_acid_sites(sites, features), 7).collect()
    whole = {r["gene"]: r["sequence"] for r in features.collect()}
    assert {r["variant"] for r in probes} == {"other_3", "spliced_3"}
    for r in probes:
        s = whole[r["variant"][:-2]]
        assert r["seq"] == (s[:15] if r["kind"] == "ref" else s[:6] + "TGG" + s[9:15])
