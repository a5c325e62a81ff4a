"""Connected components of an edge table, by label propagation with pointer jumping.

A node's label is a node, so nothing but the edges says what belongs together. Every round is two equi-joins and partial
minimum aggregations; a node with very many links is combined before the shuffle, and in the joins its rows are spread by
`join_spread`. Each round's labels are staged. The number of rounds grows with the logarithm of the longest path.

At most ONE_TASK edges of longs are united by one task instead, with the same labels: each round is some twenty shuffles and
broadcasts, and what the driver holds for them (plans, threads, generated code) does not shrink with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.plans.stage import release, staged

SALTS = 256
#: Edges that one task may unite.
ONE_TASK = 1 << 20


def join_spread(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """Inner join of `left` with `right`, which has one row for each key; a key may hold most rows of `left`.

    Rows of a key are dealt over `salts` groups by a hash of `by`; the row of `right` is repeated only for the groups that exist.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    places = salted.select(key, "_salt").distinct().join(right, key)
    return salted.join(places, [key, "_salt"]).drop("_salt")


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node that each reaches.

    In each round every root that is linked to a smaller one hangs on its smallest; two rounds at least halve the roots.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        x, y = np.maximum(x, y), np.minimum(x, y)
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, x, y)
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    if parts:
        nodes, labels = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, labels)], names=["node", "label"])


def components(edges: DataFrame, task: Callable[[Callable], Callable] = lambda run: run, one_task: int = ONE_TASK) -> DataFrame:
    """node, label: the smallest node reachable from each node that has an edge.

    `edges` has a, b (of one type that has an order). No edges give no rows. `task` wraps the function of the one task.
    """
    links = staged(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "links")
    if links.dtypes == [("a", "bigint"), ("b", "bigint")] and links.count() <= one_task:
        labels = staged(links.coalesce(1).mapInArrow(task(_united), "node long, label long"), "labels")
        release(links)
        return labels
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    release(links)
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = join_spread(both, labels.select(F.col("node").alias("b"), "label"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        moved = join_spread(step, jump, "next", "node").select("node", F.least("next", "up").alias("new"), "label")
        new = staged(moved.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        release(labels)
        labels = new
        if labels.where("moved").isEmpty():
            release(both)
            return labels.select("node", "label")
