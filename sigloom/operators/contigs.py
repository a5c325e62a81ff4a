"""Contigs along a whole de Bruijn graph: unitigs by list ranking, then walks from unitig to unitig.

A node is a k-mer as it is read in walking direction, so each k-mer of the graph is two nodes, as 64-bit codes. A walk from a seed takes the
only way; at a fork the oldest open link says which base comes next (links whose next base is another one are dropped, the others
move on), and without an open link the walk ends, as it does where it would repeat itself: at a node it has been at with the same
open links. Of equal open links the oldest counts, as the others decide nothing; so there are finitely many states and each walk ends.

Unitigs. A node that is the only way of its predecessor and has no other predecessor continues the unitig of that; all others begin
one. The beginning of each node's unitig and its place in it come from pointer doubling over the predecessors: a join of the table with
itself for each doubling, 24 for a unitig of ten million k-mers. Rings have no beginning; theirs is the smallest node, found in the same way.
Only the texts of unitigs are kept, in chunks, so no task holds a unitig, much less a connected part of the graph.

Walks. All seeds walk at once, a unitig in each round; a round is two joins of the walks with tables of the unitigs. So rounds grow
with the most unitigs of a walk. Steps are written down, and each contig is put together from the chunks of its steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import kmers as km
from sigloom.plans.stage import release, staged

#: k-mers of a chunk of a unitig's text.
CHUNK = 1 << 16


def nodes(graph: DataFrame, k: int, colour: int = 0) -> DataFrame:
    """node, kmer, flipped, outs (codes 0 to 3 of the bases that follow): both strands of each k-mer, and one of a k-mer that is its own complement."""
    byte = F.get("edges", F.lit(colour)).cast("int")
    back = km.reverse_complement(F.col("kmer"))

    def outs(first: int) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: F.shiftright(byte, first).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)

    strands = F.array(
        F.struct(km.encode(F.col("kmer")).alias("node"), F.lit(False).alias("flipped"), outs(0).alias("outs")),
        F.when(back != F.col("kmer"), F.struct(km.encode(back).alias("node"), F.lit(True).alias("flipped"), outs(4).alias("outs"))),
    )
    rows = graph.groupBy("kmer").agg(F.first("edges").alias("edges"))
    return rows.select("kmer", F.explode(F.array_compact(strands)).alias("s")).select("s.node", "kmer", "s.flipped", "s.outs")


def following(node: Column, base: Column, k: int) -> Column:
    """The node that a base leads to."""
    return (node.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1).cast("bigint")) * 4 + base).cast("bigint")


def ranked(links: DataFrame) -> DataFrame:
    """node, head, pos of lists: from (node, before), where before is null for the head of a list. Nodes of rings are left out."""
    state = staged(links.select("node", F.coalesce("before", "node").alias("up"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("pos"), F.col("before").isNull().alias("done")), "ranks")
    open_ends = state.where("NOT done").count()
    while open_ends:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        waiting = state.where("NOT done").join(above, "up").select("node", F.col("_up").alias("up"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"))
        further = staged(state.where("done").unionByName(waiting), "ranks")
        release(state)
        state, before = further, open_ends
        open_ends = state.where("NOT done").count()
        if open_ends == before:  # each round reaches the heads of longer lists, as long as there are any
            break
    return state.where("done").select("node", F.col("up").alias("head"), "pos")


def ring_heads(rings: DataFrame) -> DataFrame:
    """node of the smallest node of each ring: from (node, before) of whole rings. The least of longer and longer stretches, until none falls."""
    state = staged(rings.select("node", F.col("before").alias("up"), F.least("node", "before").alias("low"), F.lit(True).alias("fell")), "rings")
    while not state.where("fell").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        further = staged(state.join(above, "up").select("node", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell")), "rings")
        release(state)
        state = further
    return state.where("node = low").select("node")


def unitigs(every: DataFrame, k: int) -> DataFrame:
    """node, head, pos, outs of every node: the node that its unitig begins with, and its place in it."""
    edges = every.select(F.col("node").alias("before"), F.size("outs").alias("ways"), F.explode("outs").alias("base")).select(following(F.col("before"), F.col("base"), k).alias("node"), "before", "ways")
    into = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("before").alias("before"), F.min("ways").alias("ways"))
    single = into.where("n = 1 AND ways = 1").select("node", "before")
    lists = staged(every.select("node").join(single, "node", "left"), "lists")
    found = staged(ranked(lists), "places")
    rings = staged(lists.join(found.select("node"), "node", "left_anti"), "ring")
    if not rings.isEmpty():
        heads = ring_heads(rings).withColumn("head", F.lit(True))
        cut = rings.join(heads, "node", "left").select("node", F.when(F.col("head").isNull(), F.col("before")).alias("before"))
        found = found.unionByName(ranked(staged(cut, "cut")))
    return staged(every.select("node", "outs").join(found, "node"), "unitigs")


def _last_base(node: Column) -> Column:
    return F.substring(F.lit(km.ALPHABET), (node.bitwiseAND(F.lit(3).cast("bigint")) + 1).cast("int"), F.lit(1))


def contigs(seeds: DataFrame, graph: DataFrame, links: DataFrame | None = None, colour: int = 0) -> DataFrame:
    """seed, contig of the distinct seeds: from (seed), a graph of (kmer, edges) and links of (kmer, direction, junctions).

    Links of one k-mer are as old as the order of their junctions. A seed that the graph does not have is its own contig, and an edge to a k-mer
    that it does not have adds that k-mer's base and ends the walk.
    """
    asked = staged(seeds.select("seed").where("seed IS NOT NULL").distinct(), "seeds")
    first = graph.select(F.char_length("kmer").alias("k")).first()
    if first is None:
        return asked.select("seed", F.col("seed").alias("contig"))
    k = first["k"]
    known = staged(nodes(graph, k, colour), "nodes")
    led_to = known.select(F.col("node").alias("from"), F.explode("outs").alias("base")).select(following(F.col("from"), F.col("base"), k).alias("node"))
    from_seeds = asked.where(F.char_length("seed") == k).select(km.encode(F.col("seed")).alias("node"))
    absent = led_to.unionByName(from_seeds).distinct().join(known.select("node"), "node", "left_anti").withColumn("outs", F.array().cast("array<int>"))
    placed = unitigs(known.select("node", "outs").unionByName(absent), k)

    tails = staged(placed.groupBy("head").agg(F.max(F.struct("pos", "node", "outs")).alias("tail")).select("head", F.col("tail.pos").alias("to"), F.col("tail.node").alias("node"), F.col("tail.outs").alias("outs")), "tails")
    held = F.sort_array(F.collect_list(F.struct("pos", "junctions")))
    if links is None:
        met = placed.select("head").limit(0).withColumn("links", F.lit(None).cast("array<struct<pos:bigint,junctions:string>>"))
    else:
        own = links.where(F.col("junctions") != "").select("kmer", (F.col("direction") == "R").alias("flipped"), "junctions")
        met = known.join(own, ["kmer", "flipped"]).select("node", "junctions").join(placed.select("node", "head", "pos"), "node").groupBy("head").agg(held.alias("links"))
    table = staged(tails.join(met, "head", "left"), "tails")

    begun = asked.select("seed", km.encode(F.col("seed")).alias("node")).where(F.char_length("seed") == k).join(placed.select("node", "head", "pos"), "node")
    nothing = F.array().cast("array<string>")
    walks = staged(begun.select("seed", "head", F.col("pos").alias("from"), nothing.alias("open"), F.lit(None).cast("bigint").alias("mark_head"), nothing.alias("mark_open")), "walks")
    steps, n = [], 0
    while not walks.isEmpty():
        here = walks.join(table, "head")
        every = F.coalesce("links", F.array().cast("array<struct<pos:bigint,junctions:string>>"))
        gathered = F.array_distinct(F.concat("open", F.transform(F.filter(every, lambda x: x["pos"] >= F.col("from")), lambda x: x["junctions"])))
        passed_by = F.exists(every, lambda x: x["pos"] < F.col("from"))
        moved = staged(here.select("seed", "head", "from", "to", "open", "node", "outs", gathered.alias("gathered"), passed_by.alias("passed_by"), "mark_head", "mark_open"), f"step{n}")
        steps.append(moved.select("seed", F.lit(n).alias("step"), "head", "from", "to", "open", "passed_by"))
        turn = F.substring(F.get("gathered", F.lit(0)), 1, 1)
        way = F.instr(F.lit(km.ALPHABET), turn) - 1
        forked = F.size("outs") > 1
        base = F.when(F.size("outs") == 1, F.get("outs", F.lit(0))).when(forked & (F.size("gathered") > 0) & F.array_contains("outs", way), way)
        later = F.when(forked, F.transform(F.filter("gathered", lambda j: (F.substring(j, 1, 1) == turn) & (F.char_length(j) > 1)), lambda j: F.substring(j, 2, 1 << 30))).otherwise(F.col("gathered"))
        after = moved.withColumn("base", base).where("base IS NOT NULL").select("seed", following(F.col("node"), F.col("base"), k).alias("head"), F.lit(0).cast("bigint").alias("from"), F.array_distinct(later).alias("open"), "mark_head", "mark_open")
        # A walk that meets the state marked last goes round; the mark moves on at each power of two, and what is too much is cut off below.
        after = after.where(~((F.col("head") == F.col("mark_head")) & (F.col("open") == F.col("mark_open"))).eqNullSafe(F.lit(True)))
        if n & (n + 1) == 0:
            after = after.withColumns({"mark_head": F.col("head"), "mark_open": F.col("open")})
        release(walks)
        walks, n = staged(after, "walks"), n + 1
    found = asked.select("seed", F.col("seed").alias("contig"))
    if not steps:
        return found
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    return _texts(found, staged(_without_rounds(every), "steps"), placed, k)


def _without_rounds(steps: DataFrame) -> DataFrame:
    """The steps of each walk up to its first repeated node: seed, step, head, from, to."""
    state = F.struct("head", "open")
    earlier = steps.where("from = 0").groupBy("seed", state.alias("state")).agg(F.min("step").alias("first"))
    # A seed in the middle of its unitig is come back to if nothing is open there: neither links brought along nor links of nodes before it.
    start = steps.where("step = 0 AND from > 0 AND NOT passed_by").select("seed", F.col("head").alias("_head"), F.col("from").alias("_at"))
    whole = steps.withColumn("state", state).join(earlier, ["seed", "state"], "left").join(start, "seed", "left")
    again = F.when((F.col("from") == 0) & (F.col("step") > F.col("first")), F.lit(0).cast("bigint"))
    passed = (F.col("step") > 0) & (F.col("head") == F.col("_head")) & (F.size("open") == 0)
    marked = whole.withColumn("end", F.coalesce(again, F.when(passed, F.col("_at"))))
    last = marked.where("end IS NOT NULL").groupBy("seed").agg(F.min("step").alias("last"))
    cut = marked.join(last, "seed", "left").where("last IS NULL OR step <= last")
    return cut.select("seed", "step", "head", "from", F.when(F.col("step") == F.col("last"), F.col("end")).otherwise(F.col("to")).alias("to"))


def _texts(found: DataFrame, steps: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """seed, contig: the first k - 1 bases of the seed, and then the last base of each node of the steps."""
    used = steps.select("head").distinct()
    chunk = (F.col("pos") / CHUNK).cast("bigint")
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _last_base(F.col("node")).alias("base")))), lambda x: x["base"]), "")
    chunks = placed.join(used, "head", "left_semi").groupBy("head", chunk.alias("chunk")).agg(bases.alias("text"))
    parts = steps.join(chunks, "head").where((F.col("chunk") * CHUNK <= F.col("to")) & ((F.col("chunk") + 1) * CHUNK > F.col("from")))
    skip = F.greatest(F.col("from") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    length = (F.least(F.col("to") + 1 - F.col("chunk") * CHUNK, F.lit(CHUNK)) - skip).cast("int")
    own = parts.select("seed", "step", "chunk", F.substring(F.col("text"), skip + 1, length).alias("text"))
    joined = own.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "chunk", "text"))), lambda x: x["text"]), "").alias("text"))
    return found.join(joined, "seed", "left").select("seed", F.when(F.col("text").isNull(), F.col("contig")).otherwise(F.concat(F.substring("seed", 1, k - 1), F.col("text"))).alias("contig"))
