"""Contigs by unitigs and rounds of walks against one walk after the other, base by base."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import contigs as walk

FLIP = str.maketrans("ACGT", "TGCA")


def back(s):
    return s.translate(FLIP)[::-1]


def ways(s, edges):
    """The bases that follow a k-mer as it is read."""
    return [b for i, b in enumerate("ACGT") if edges[min(s, back(s))] >> (i if s <= back(s) else 4 + i) & 1]


def plain_walk(seed, edges, links):
    here, out, open_links, met = seed, seed, [], set()
    while min(here, back(here)) in edges and (here, tuple(open_links)) not in met:
        met.add((here, tuple(open_links)))
        side = "F" if here <= back(here) else "R"
        open_links = list(dict.fromkeys(open_links + sorted(j for d, j in links.get(min(here, back(here)), ()) if d == side)))
        bases = ways(here, edges)
        if len(bases) > 1:
            turn = open_links[0][0] if open_links else ""
            open_links = list(dict.fromkeys(j[1:] for j in open_links if j[0] == turn and len(j) > 1))
            bases = [b for b in bases if b == turn]
        if not bases:
            break
        here, out = here[1:] + bases[0], out + bases[0]
    return out


def tables(spark, edges, links):
    graph = spark.createDataFrame([(x, [0, e]) for x, e in edges.items()], "kmer string, edges array<int>")
    rows = [(x, d, j) for x, own in links.items() for d, j in own]
    return graph, spark.createDataFrame(rows, "kmer string, direction string, junctions string")


def graph_of(sequences, k):
    edges = {}
    for seq in sequences:
        for i in range(len(seq) - k + 1):
            edges.setdefault(min(seq[i : i + k], back(seq[i : i + k])), 0)
        for i in range(len(seq) - k):
            for a, b in ((seq[i : i + k], seq[i + 1 : i + k + 1]), (back(seq[i + 1 : i + k + 1]), back(seq[i : i + k]))):
                edges[min(a, back(a))] |= 1 << ("ACGT".index(b[-1]) + (0 if a <= back(a) else 4))
    return edges


@pytest.mark.parametrize("seed", range(3))
def test_against_walks_base_by_base(spark, monkeypatch, seed):
    rng = random.Random(seed)
    k = [3, 4, 7][seed]
    monkeypatch.setattr(walk, "CHUNK", 5)
    edges = graph_of(["".join(rng.choice("ACGT") for _ in range(rng.randint(k, 60))) for _ in range(3)], k)
    for x in rng.sample(sorted(edges), len(edges) // 5):  # edges to k-mers that are not there, and lost ones
        edges[x] ^= 1 << rng.randrange(8)
    links = {x: [(rng.choice("FR"), "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 5)))) for _ in range(rng.randint(1, 3))] for x in rng.sample(sorted(edges), len(edges) // 2)}
    seeds = sorted({s for x in edges for s in (x, back(x))} | {"A" * k, "A" * (k + 2), "AC"})
    graph, link_table = tables(spark, edges, links)
    got = {r["seed"]: r["contig"] for r in walk.contigs(spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "seed string"), graph, link_table, colour=1).collect()}
    assert got == {s: plain_walk(s, edges, links) for s in seeds}


def test_rings_and_long_unitigs(spark, monkeypatch):
    """A ring that a walk goes round once, a ring with a way into it, and a list of which each node is far from its end."""
    rng = random.Random(8)
    monkeypatch.setattr(walk, "CHUNK", 64)
    k, ring, long = 9, "".join(rng.choice("ACGT") for _ in range(40)), "".join(rng.choice("ACGT") for _ in range(1500))
    edges = graph_of([ring + ring[:k], long[-20:] + ring[5:25], long], k)
    seeds = [ring[:k], back(ring[:k]), ring[7 : 7 + k], long[:k], long[700 : 700 + k], back(long[700 : 700 + k])]
    graph, _ = tables(spark, edges, {})
    got = {r["seed"]: r["contig"] for r in walk.contigs(spark.createDataFrame([(s,) for s in seeds], "seed string"), graph, colour=1).collect()}
    assert got == {s: plain_walk(s, edges, {}) for s in seeds}
    alone = graph_of([ring + ring[:k]], k)
    table, _ = tables(spark, alone, {})
    places = walk.unitigs(walk.nodes(table, k, 1), k)
    assert sorted(r["n"] for r in places.groupBy("head").agg(F.count("*").alias("n")).collect()) == [40, 40]
    assert walk.contigs(spark.createDataFrame([("ACG",)], "seed string"), table.limit(0)).first()["contig"] == "ACG"
