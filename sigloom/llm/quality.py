"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once and staged. The model is fitted on the driver on a bounded sample
of labelled rows (`max_rows`, chosen by a hash of the id), with features cut into at most BINS quantile bins
and second-order histogram splits. Its complete trees are flattened into two arrays (feature and threshold
by tree and node), which a batch walks level by level in numpy. Scoring covers every row.

Defined cases: null and empty texts have zero statistics and get a score. Labels other than 0 and 1, null
labels and labels of unknown documents are not learned. Repeated rows are scored alike. Without labels of both
classes every score is the share of ones, or 0.5. An empty table gives an empty result. `labels`, `lang`,
`source` and the id are never inputs of a score; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics
from .stage import staged

BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 4, 120, 0.15, 1.0, 5.0


@dataclass
class Trees:
    """feature, threshold: trees x inner nodes; leaf: trees x leaves. A walk goes right where x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.bias)
        if trees:
            base = np.arange(trees) * inner
            node = np.zeros((len(x), trees), np.int64)
            row = np.arange(len(x))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                at = base + node
                node = 2 * node + 1 + (x[row, self.feature.ravel()[at]] > self.threshold.ravel()[at])
            total += self.leaf.ravel()[np.arange(trees) * (inner + 1) + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic loss; deterministic in the order of the rows."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    flat = binned + np.arange(m) * bins
    bias = float(np.log(share / (1 - share)))
    raw = np.full(n, bias)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            key = (local[:, None] * (m * bins) + flat).ravel()
            size = width * m * bins
            hg = np.bincount(key, np.repeat(g, m), size).reshape(width, m, bins).cumsum(axis=2)
            hh = np.bincount(key, np.repeat(h, m), size).reshape(width, m, bins).cumsum(axis=2)
            sum_g, sum_h = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + L2) + (sum_g - hg) ** 2 / (sum_h - hh + L2) - sum_g**2 / (sum_h + L2)
            gain[(hh < LEAST / 4) | (sum_h - hh < LEAST / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, c = divmod(int(best[k]), bins)
                if gain[k, j, c] > 1e-6 and c < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        raw += leaf[t, at]
    return Trees(feature, threshold, leaf, bias)


def crc_part(id_col: Column, parts: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, held_part: int = 1, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, stats of every row; rows of the held part are not learned from."""
    fed = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    known = staged(fed.mapInArrow(statistics.rows, f"stats array<float>, doc_id {docs.schema[id_col].dataType.simpleString()}"), "statistics")
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = marked.where(crc_part(F.col("doc_id"), parts) != held_part)
    n = marked.count()
    # A hash of the id keeps about max_rows of n labelled rows; the limit is met exactly below.
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.98 * max_rows / max(n, 1)))
    sample = known.join(marked.where(share), "doc_id").select("stats", "y", "doc_id").orderBy("doc_id", "stats").limit(max_rows).toArrow()
    x = statistics.matrix(sample.column("stats")) if sample.num_rows else np.zeros((0, len(statistics.NAMES)), np.float32)
    model = docs.sparkSession.sparkContext.broadcast(fit(x, np.asarray(sample.column("y")).astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(statistics.matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *batch.columns], names=["score", "predicted", *batch.schema.names])

    done = known.mapInArrow(run, "score double, predicted int, stats array<float>, doc_id " + docs.schema[id_col].dataType.simpleString())
    held = F.coalesce(crc_part(F.col("doc_id"), parts) == held_part, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", "predicted", "stats")
