"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

Sketch. Every shingle is thrown into one of T bins in round after round (bin and value come from a hash of
shingle and round); a bin keeps its smallest (round, value). After T random rounds, round T+i puts every
shingle into bin i, so each bin fills for sure and two sketches agree in a bin with the probability of
their resemblance, with the concentration of that scheme. Rows stop as soon as their bins are full.

Candidates. BANDS bands of ROWS bins become bucket keys: a pair at resemblance 0.75 misses all of them with
probability 1e-6. One bit of each of the T bins (of WIDE bins, for nodes of buckets that stay divided) estimates
resemblance; a pair whose estimate is more than five standard deviations below the threshold is not verified.

Rows of equal shingle sets are one node, told apart by a 128-bit digest of the whole set: a node is its first half, and
nodes of which the other half differs are numbered anew. Everything up to the last step works on nodes; an id only names
the component in the end. Inside a bucket not all pairs are made: every node is paired
with the bucket's smallest and largest node, which is linear; the pairs that pass the estimate are verified on
full sets and linked nodes united. Only nodes that are still apart from the largest component of their bucket are
then paired with its other components, so every candidate pair is either verified or already in one component. An
exact bound keeps these few: shingles that no other candidate holds cannot be common, so two nodes share at most the
smaller number of their other shingles. It settles most heavily edited copies without a pair. Buckets are dealt in
salted parts, and such pairs are made in blocks of BLOCK nodes, so one bucket may hold most nodes.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing; with
fewer than five words the whole sequence is one shingle. Rows with equal ids are rows of their own: each is in the component
of its own text. A component's id is the smallest id of its rows; rows without an id count only if no row of it has one,
and the id is then null. An empty table gives an empty result. `near_duplicates` reads only the id and text columns; other
columns pass through `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators.graph import SALTS, components, join_spread

from . import textkit as tk
from .stage import release, staged

T, WIDE = 512, 4096
ROWS, BANDS = 4, 36
BLOCK = 256
NO_ID = (1 << 63) - 1
U64 = np.uint64
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def sketches(flat: np.ndarray, at: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch (rows x t) of the sets flat[at[i]:at[i+1]]; rows of empty sets stay full of ones."""
    rows, sizes = len(at) - 1, np.diff(at)
    out = np.full(rows * t, _FULL, U64)
    owner = np.repeat(np.arange(rows), sizes)
    values, done = flat, 0
    low = U64((2 * t - 1).bit_length())  # of a bin's value, the high bits are the round
    while done < 2 * t and len(values):
        many = int(np.clip((1 << 14) // len(values), 1, (t if done < t else 2 * t) - done))
        for_round = np.arange(done, done + many, dtype=U64)
        g = tk.mix(values[None, :] + (for_round * U64(0x9E3779B97F4A7C15))[:, None])
        bins = (g & U64(t - 1)).astype(np.int64) if done < t else np.broadcast_to((for_round.astype(np.int64) - t)[:, None], g.shape)
        np.minimum.at(out, (owner[None, :] * t + bins).ravel(), ((for_round << (U64(64) - low))[:, None] | (g >> low)).ravel())
        done += many
        open_rows = (out.reshape(rows, t) == _FULL).any(axis=1)
        left = open_rows[owner]
        values, owner = values[left], owner[left]
    return out.reshape(rows, t)


def set_digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit digest of each sorted set: rows x 2."""
    data = memoryview(np.ascontiguousarray(flat)).cast("B")
    every = [blake2b(data[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(every), np.int64).reshape(len(at) - 1, 2)


def _keys(s: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of each sketch, flat."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[None, :], len(s), axis=0)
    for j in range(ROWS):
        key = tk.mix(key * U64(0xE7037ED1A0B428DB) + s[:, j : BANDS * ROWS : ROWS])
    return np.ascontiguousarray(key).ravel()


def _bits(s: np.ndarray) -> np.ndarray:
    """One bit of each bin of each sketch, packed, flat."""
    return np.packbits((s & U64(1)).astype(np.uint8), axis=1).view(U64).ravel()


_KEY = "doc_id long, k1 long, k2 long"
_SKETCHED = _KEY + ", n_shingles long, node long, twin long, bands array<long>, bits array<long>"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in tk.row_slices(batch.column(0)):
            flat, at = tk.shingles(piece)
            sizes = np.diff(at)
            has = sizes > 0
            s = sketches(flat, at)[has]
            digest = set_digests(flat, at)
            count = np.concatenate([[0], np.cumsum(has)])
            halves = [pa.array(np.ascontiguousarray(digest[:, i]), mask=~has) for i in (0, 1)]
            lists = [tk.long_lists(_keys(s), count * BANDS), tk.long_lists(_bits(s), count * (T // 64))]
            yield pa.RecordBatch.from_arrays([*(c.slice(piece.lo, piece.rows) for c in batch.columns[1:]), pa.array(sizes.astype(np.int64)), *halves, *lists], names=["doc_id", "k1", "k2", "n_shingles", "node", "twin", "bands", "bits"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the wanted nodes (text, node, twin)."""
    for batch in batches:
        node, twin = (np.asarray(batch.column(i)) for i in (1, 2))
        for piece in tk.row_slices(batch.column(0)):
            flat, at = tk.shingles(piece)
            good = np.flatnonzero((set_digests(flat, at)[:, 1] == twin[piece.lo : piece.hi]) & (np.diff(at) > 0))
            for lo in range(0, len(good), 256):
                rows = good[lo : lo + 256]
                bounds = np.concatenate([[0], np.cumsum(np.diff(at)[rows])])
                part = np.concatenate([flat[at[i] : at[i + 1]] for i in rows])
                every = np.arange(len(rows) + 1)
                lists = [tk.long_lists(part, bounds), tk.long_lists(_keys(sketches(part, bounds)), every * BANDS), tk.long_lists(_bits(sketches(part, bounds, WIDE)), every * (WIDE // 64))]
                yield pa.RecordBatch.from_arrays([pa.array(node[piece.lo + rows]), *lists], names=["node", "shingles", "bands", "bits"])


def _likely(x: str, y: str, percent: int, t: int = T) -> Column:
    """Sizes and one-bit estimate allow the threshold; x and y are aliases with n_shingles and bits."""
    differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(1, t // 64)), F.bit_count(F.col(f"{x}.bits")[0].bitwiseXOR(F.col(f"{y}.bits")[0])))
    share = (1 + percent / 100) / 2
    most = int(np.ceil(t * (1 - share) + 5 * np.sqrt(t * share * (1 - share))))
    small, large = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return (100 * small >= percent * large) & (differ <= most)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _hubs(pairs: DataFrame) -> DataFrame:
    """end, node: the nodes with more than BLOCK pairs at that end (a or b)."""
    ends = F.array(*(F.struct(F.lit(x).alias("end"), F.col(x).alias("node")) for x in ("a", "b")))
    return staged(pairs.select(F.inline(ends)).groupBy("end", "node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("end", "node"), "hubs")


def _with_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, hubs: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """The rows of `pairs` with the set of `key` as `name`. Pairs of a hub at that end are dealt over groups by `other`."""
    hubs = hubs.where(F.col("end") == key).select(F.col("node").alias(key))
    if hubs.isEmpty():
        return rows.join(sets.select(F.col("node").alias(key), F.col("shingles").alias(name)), key)
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).alias("_salt")
    groups = staged(pairs.join(hubs, key, "left_semi").select(key, salt).distinct().withColumn("_group", F.col("_salt")), "groups")
    dealt = rows.select("*", salt).join(groups, [key, "_salt"], "left").withColumn("_group", F.coalesce("_group", F.lit(-1))).drop("_salt")
    parts = groups.select(F.col(key).alias("node"), "_group")
    held = sets.select("node", "shingles").join(parts, "node", "left").select(F.col("node").alias(key), F.coalesce("_group", F.lit(-1)).alias("_group"), F.col("shingles").alias(name))
    return dealt.join(held, [key, "_group"]).drop("_group")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""
    hubs = _hubs(pairs)
    both = _with_sets(_with_sets(pairs, pairs, sets, hubs, "a", "b", "of_a"), pairs, sets, hubs, "b", "a", "of_b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    met = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return met.where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b").distinct()


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Id and 128 bits of the text: rows with equal keys are the same row twice."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(5), text).alias("k2")]


def _nodes(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and a row for each node: its smallest row (rep: doc, k1, k2), n_shingles, bits, twin."""
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    while True:
        nodes = staged(
            known.where("node IS NOT NULL").groupBy("node").agg(
                F.min(F.struct(doc, "k1", "k2")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.min("twin").alias("twin"), F.max("twin").alias("last")
            ),
            "nodes",
        )
        met = nodes.where("twin <> last").select("node", F.lit(True).alias("met"))
        if met.isEmpty():
            return known, nodes.drop("last")
        # Different sets with one first half of 64 bits: their nodes come from both halves.
        again = known.join(met, "node", "left").withColumn("node", F.when(F.col("met"), F.xxhash64("node", "twin")).otherwise(F.col("node")))
        known = staged(again.drop("met"), "sketches")


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component (a long, null without shingles) and component_id of every row."""
    keyed = docs.select(F.col(text_col).cast("string").alias("text"), *_row_key(docs, id_col, text_col))
    known, nodes = _nodes(staged(keyed.mapInArrow(tk.trimmed(_sketch_rows), _SKETCHED), "sketches"))

    banded = known.where("node IS NOT NULL").select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("p"), F.max("node").alias("q"), F.count("*").alias("size")).where("p <> q")
    members = staged(banded.join(shared, "bucket").distinct(), "members")

    star = members.select(F.explode(F.array(F.struct("node", F.col("p").alias("other")), F.struct("node", F.col("q").alias("other")))).alias("x")).where("x.node <> x.other")
    star = star.select(*_pair(F.col("x.node"), F.col("x.other"))).distinct()
    first = staged(_estimated(star, nodes, percent), "pairs")

    wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).unionByName(members.where("size > 3").select("node")).distinct()
    rows = wanted.join(nodes, "node").select("node", "twin", F.col("rep.doc").alias("doc"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    texts = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).drop("doc_id").join(rows, ["doc", "k1", "k2"])
    # A row that is there more than once gives its set once; the join has the rows of a key in one place already.
    once = texts.groupBy("doc", "k1", "k2", "node", "twin").agg(F.first("text").alias("text")).select("text", "node", "twin")
    sets = staged(once.mapInArrow(tk.trimmed(_set_rows), "node long, shingles array<long>, bands array<long>, bits array<long>"), "sets")

    edges = staged(_verified(first, sets, percent), "edges")
    named = _named(nodes, components(edges, tk.trimmed))

    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = staged(held.where("node = last").groupBy("node").agg(F.count("*").alias("alone")), "alone")
    rows = _divided(members.where("size > 3"), named, alone, percent)
    second = staged(_apart(rows, sets, percent).join(first, ["a", "b"], "left_anti"), "apart")
    release(members, alone, first, rows)
    if not second.isEmpty():
        more = staged(_verified(second, sets, percent), "more")
        if not more.isEmpty():
            named = _named(nodes, components(edges.unionByName(more), tk.trimmed))
    release(sets, second)

    ids = named.groupBy("component").agg(F.min("doc").alias("least"))
    named = join_spread(named.select("node", "component"), ids, "component", "node")
    # Exact copies of one text may be most of all rows.
    rows = known.select("doc_id", "k1", "k2", "n_shingles", "node")
    found = join_spread(rows.where("node IS NOT NULL"), named, "node", "doc_id").select("doc_id", "k1", "k2", "n_shingles", "component", F.nullif("least", F.lit(NO_ID)).alias("component_id"))
    none = rows.where("node IS NULL").select("doc_id", "k1", "k2", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return found.unionByName(none)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _components(docs, id_col, text_col, percent).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row of each component, that of the smallest id and then text hash; rows without shingles all stay.

    Works on rows: rows that share an id with others are judged by their own text, and of a row that is there more than
    once, or of rows without an id and with one text, one stays.
    """
    found = _components(docs, id_col, text_col, percent).where("component IS NOT NULL")
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "k1", "k2")
    best = found.groupBy("component").agg(F.min(key).alias("best"))
    chosen = best.select(F.col("best.doc").alias("_nd_doc"), F.col("best.k1").alias("_nd_k1"), F.col("best.k2").alias("_nd_k2"))
    doc, k1, k2 = _row_key(docs, id_col, text_col)
    keyed = docs.withColumns({"_nd_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_nd_k1": k1, "_nd_k2": k2})
    worded = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = keyed.where(worded).join(chosen, ["_nd_doc", "_nd_k1", "_nd_k2"], "left_semi").dropDuplicates(["_nd_doc", "_nd_k1", "_nd_k2"])
    return left.select(*docs.columns).unionByName(keyed.where(~worded).select(*docs.columns))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    slim = nodes.select("node", "n_shingles", "bits")
    joined = pairs.join(slim.alias("x"), F.col("a") == F.col("x.node")).join(slim.alias("y"), F.col("b") == F.col("y.node"))
    return joined.where(_likely("x", "y", percent)).select("a", "b")


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, n_shingles, doc and component of every node."""
    return staged(nodes.join(labels, "node", "left").select("node", "n_shingles", F.col("rep.doc").alias("doc"), F.coalesce("label", "node").alias("component")), "named")


def _divided(members: DataFrame, named: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """Rows of the buckets that more than one component is in, without sets, of nodes that may still have a link.

    `alone` has the number of each node's shingles that no other candidate holds.
    """
    state = named.join(alone, "node", "left").select("node", "n_shingles", F.col("component").alias("label"), (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("shared"))
    placed = staged(members.select("band", "bucket", "node").join(state, "node"), "placed")
    per_label = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = per_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1")
    main = main.select("bucket", F.col("top.label").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / F.lit(float(BLOCK))).cast("int").alias("parts"))
    rows = staged(join_spread(placed.where(100 * F.col("shared") >= percent * F.col("n_shingles")), main, "bucket", "node"), "divided")
    release(placed)
    return rows


def _apart(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between components: in each bucket of `_divided`, nodes outside its largest one against the rest."""
    slim = sets.select("node", "bands", "bits")
    # Nodes outside the largest component are dealt into blocks, and every other node of the bucket meets each block.
    x = rows.where("label <> main").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts"))).join(slim, "node").alias("x")
    y = rows.join(slim, "node").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - F.lit(1).cast("bigint")))).alias("y")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    common = F.least("x.shared", "y.shared")
    enough = 100 * common >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles") - common)
    # Only in the first bucket that both are in.
    here = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block"))
    met = x.join(y, same & (F.col("x.label") != F.col("y.label")) & once & enough & _likely("x", "y", percent, WIDE) & here)
    return met.select(*_pair(F.col("x.node"), F.col("y.node"))).distinct()


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*)))
"""


def _closure() -> str:
    return ORACLE.replace("WITH w", "WITH RECURSIVE w") + """,
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


SQL = _closure()
