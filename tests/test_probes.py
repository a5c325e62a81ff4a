"""Probes of alleles of any length on all haplotypes around them, against brute force."""

import random
from itertools import combinations

import pytest

from sigloom.operators import variants

SITES = "variant string, contig int, reference string, pos int, ref string, alt string"
AROUND = "contig int, pos int, ref string, alt string"


def haplotypes(reference, pos, ref, near, k):
    """Both flanks of a site with every choice of variants that do not overlap it or each other."""
    out = set()
    for n in range(len(near) + 1):
        for chosen in combinations(sorted(near), n):
            ends = [(p, p + len(r)) for p, r, _ in chosen]
            if any(a[1] > b[0] for a, b in zip(ends, ends[1:])):
                continue
            left, right, at, to = "", "", 1, pos + len(ref)
            for p, r, a in chosen:
                if p + len(r) <= pos:
                    left += reference[at - 1 : p - 1] + a
                    at = p + len(r)
                else:
                    right += reference[to - 1 : p - 1] + a
                    to = p + len(r)
            left += reference[at - 1 : pos - 1]
            right += reference[to - 1 :]
            out.add((left[-(k - 1) :], right[: k - 1]))
    return out


@pytest.mark.parametrize("k", [5, 9])
def test_probes_against_brute_force(spark, k):
    rng = random.Random(k)
    sites, around = [], []
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for contig in range(25):
        reference = dna(rng.randint(30, 60))
        own = {(p, reference[p - 1 : p - 1 + rng.choice([1, 1, 2, 4])], dna(rng.choice([0, 1, 1, 3]))) for p in (rng.randint(1, len(reference)) for _ in range(rng.randint(0, 5)))}
        around += [(contig, *v) for v in own]
        for i in range(2):
            pos = rng.randint(1, len(reference) - 4)
            sites.append((f"v{contig}-{i}", contig, reference, pos, reference[pos - 1 : pos - 1 + rng.choice([1, 2, 4])], dna(rng.choice([0, 1, 1, 5]))))
    want = set()
    for name, contig, reference, pos, ref, alt in sites:
        near = [v[1:] for v in set(around) if v[0] == contig and (v[1] + len(v[2]) <= pos or v[1] >= pos + len(ref))]
        for left, right in haplotypes(reference, pos, ref, near, k):
            want |= {(name, "ref", left + ref + right), (name, "alt", left + alt + right)}
    got = [tuple(r) for r in variants.probes_on_backgrounds(spark.createDataFrame(sites, SITES), spark.createDataFrame([*around, *around[:3]], AROUND), k).collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_probes_of_wrong_or_crowded_sites(spark):
    site = spark.createDataFrame([("v", 1, "ACGTACGTACGT", 5, "AC", "")], SITES)
    none = spark.createDataFrame([], AROUND)
    assert {tuple(r) for r in variants.probes_on_backgrounds(site, none, 4).collect()} == {("v", "ref", "CGTACGTA"), ("v", "alt", "CGTGTA")}
    with pytest.raises(Exception, match="other bases"):
        variants.probes_on_backgrounds(site.replace("AC", "AA", ["ref"]), none, 4).collect()
    with pytest.raises(Exception, match="other bases"):
        variants.probes_on_backgrounds(site, spark.createDataFrame([(1, 3, "C", "A")], AROUND), 4).collect()
    crowd = spark.createDataFrame([(1, 7 + i, "GTACGT"[i], "NN") for i in range(3)], AROUND)
    with pytest.raises(Exception, match="more than 2"):
        variants.probes_on_backgrounds(site, crowd, 4, most=2).collect()
