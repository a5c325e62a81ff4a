"""Mixing to target weights with soft membership.

A classifier learned from a labelled table (id, domain) predicts each document's domain posteriors. A document then
gets a rate (how often it is drawn), starting at 1, so that the expected domain totals

    total[d] = sum over documents of tokens * rate * posterior[d]

match the targets in relative least squares under rate >= 0, by projected gradient: in the norm that weighs documents by
tokens, a step changes a document's rate by a linear function of its posteriors, so the history of these few numbers is
all the state. A step is scaled by the second moments of the posteriors over the documents with a rate above 0, which come with
the totals, and shortened until the error falls; at worst it is the plain gradient step with the least length, at which it always falls.
Each pass is one aggregation over a staged narrow table, with no join and nothing per document on the driver. `Fit.converged`
says whether every domain with a target is within TOLERANCE of it; if not, there is a warning.

With a `whole` domain the shares of the others are upper bounds, never below what expected tokens they have in documents that are likeliest
of the whole domain, as these are not to be thinned: only what is above them counts as an error, so steps only lower
rates, none is above 1 and no document is repeated. The norm then weighs a document by its tokens over its posterior of all other
domains together, so that documents which are surely of the whole domain keep their rate. The fit converges if the bounds hold.

Documents are drawn by systematic sampling: they are ordered by likeliest domain and size, rates are added up along this order, and a document
is drawn whenever the sum passes a whole number. So the drawn totals of a domain are off by little more than single documents, while each
document is drawn by its own rate. The order is made by range partitions; only their sums (one row per task) meet on the driver.

Classifier: softmax regression on document statistics and on the presence of telling words, fitted in one executor
task on a bounded sample of labelled rows (`max_rows`, by a hash of the id). A word is telling if its document frequency
in one domain is far from that in the others (Z standard errors, at least LEAST documents, or a quarter of the smallest domain's where that
is less, FEWEST at least); all such words count. Words
are kept as pairs of row and word, never as a matrix.

Defined cases: null and empty texts have no tokens and get posteriors and a rate like all others. Null domains are not
learned. Without any labelled document every rate is 1.0 and the posteriors are empty. A domain with weight 0
has target 0; a domain without available tokens is left out of the fit. Repeated rows are each scored. An empty
table gives an empty result. Other columns pass through `draw` and `mix`; the fit reads id and text only.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics
from . import textkit as tk
from .langid import _LETTER
from .stage import staged

U64 = np.uint64
BITS = 20
Z, LEAST, FEWEST = 5.0, 8, 3
ROUNDS, TOLERANCE = 60, 1e-3
NO_ID = -(1 << 63)


def word_slots(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each distinct word (run of letters) of each row."""
    s, e, bounds = piece.runs(_LETTER[piece.b])
    owner = np.repeat(np.arange(piece.rows), np.diff(bounds)).astype(U64)
    slot = piece.hashes(s, e, True) >> U64(64 - BITS)
    both = np.unique(owner << U64(BITS) | slot)
    return (both >> U64(BITS)).astype(np.int64), (both & U64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Classifier:
    domains: list[str]
    place: np.ndarray  # slot to telling word, or -1
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (words + statistics + 1) x domains

    def stats(self, table: np.ndarray) -> np.ndarray:
        scaled = np.clip((table - self.mean) / self.scale, -5, 5).astype(np.float32)
        return np.concatenate([scaled, np.ones((len(scaled), 1), np.float32)], axis=1)

    def posteriors(self, piece: tk.Slice) -> np.ndarray:
        row, slot = word_slots(piece)
        at = self.place[slot]
        held = at >= 0
        n = len(self.weights) - len(statistics.NAMES) - 1
        return _softmax(self.stats(statistics.table(piece)) @ self.weights[n:] + _sums(row[held], at[held], self.weights[:n], piece.rows))


def _sums(group: np.ndarray, at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[at] by group, which must be sorted."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(group):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for d in range(values.shape[1]):
            out[group[first], d] = np.add.reduceat(np.ascontiguousarray(values[:, d])[at], first)
    return out


def _softmax(raw: np.ndarray) -> np.ndarray:
    out = np.exp(raw - raw.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def learn(texts: pa.Array, domains: list[str], steps: int = 400, l2: float = 1e-3) -> Classifier | None:
    names = sorted(set(domains))
    if not names:
        return None
    gold = np.array([names.index(d) for d in domains])
    hot = np.eye(len(names))[gold]
    k = len(names)
    found = np.zeros((1 << BITS) * k, np.int32)
    stats, words = [], []
    # One slice at a time: each keeps many times its bytes.
    for piece in tk.row_slices(texts, 1 << 18):
        row, slot = word_slots(piece)
        np.add.at(found, slot * k + gold[piece.lo + row], 1)
        words.append((piece.lo + row, slot))
        stats.append(statistics.table(piece))
    x = np.concatenate(stats)
    size = hot.sum(axis=0)
    found = found.reshape(-1, k)
    often = np.flatnonzero(found.sum(axis=1) >= np.clip(size.min() / 4, FEWEST, LEAST))
    own = found[often].astype(float)
    rest_n, rest = len(gold) - size, own.sum(axis=1, keepdims=True) - own
    p, q = (own + 0.5) / (size + 1), (rest + 0.5) / (rest_n + 1)
    both = (own + rest + 1) / (len(gold) + 2)
    z = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / np.maximum(size, 1) + 1 / np.maximum(rest_n, 1)))
    telling = often[z.max(axis=1) > Z]
    place = np.full(1 << BITS, -1, np.int32)
    place[telling] = np.arange(len(telling))
    model = Classifier(names, place, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros((len(telling) + x.shape[1] + 1, len(names)), np.float32))
    inputs = model.stats(x)
    row, at = (np.concatenate(c) for c in zip(*((r[place[t] >= 0], place[t][place[t] >= 0]) for r, t in words), strict=True))
    by_word = np.argsort(at, kind="stable")
    rows_of, word = row[by_word], at[by_word]
    n = len(telling)
    # Balanced classes, so a rare domain is not drowned; the prior is put back into the bias.
    share = np.maximum(size, 1) / len(gold)
    row_weight = ((1 / share)[gold] / len(names) / len(gold)).astype(np.float32)[:, None]
    w, squares, hot = model.weights, np.full_like(model.weights, 1e-8), hot.astype(np.float32)
    for _ in range(steps):
        off = (_softmax(inputs @ w[n:] + _sums(row, at, w[:n], len(gold))) - hot) * row_weight
        grad = np.concatenate([_sums(word, rows_of, off, n), inputs.T @ off]) + np.float32(l2) * w
        squares += grad**2
        w -= np.float32(0.3) * grad / np.sqrt(squares)
    w[-1] += np.log(share).astype(np.float32)
    return model


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = 6_000) -> tuple[DataFrame, list[str]]:
    """doc, row, n_tokens, posteriors of every row (staged), and the domains in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(domain_col).alias("domain")).where("doc is not null and domain is not null").groupBy("doc").agg(F.max("domain").alias("domain"))
    n = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("doc", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * max_rows / max(n, 1))))

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([("doc", "ascending"), ("row", "ascending")])
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        model = learn(texts, rows.column("domain").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # Ordered by the row's own key, so repeated ids choose the same rows however the table is dealt; one task sees the sample.
    sample = keyed.join(chosen, "doc").select("doc", "row", F.col("text").cast("string"), F.col("domain").cast("string")).orderBy("doc", "row").limit(max_rows)
    made = sample.mapInArrow(tk.trimmed(taught), "model binary").collect()
    model = pickle.loads(made[0]["model"]) if made else None
    domains = model.domains if model else []
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in tk.row_slices(batch.column(0)):
                p = known.posteriors(piece).astype(float) if known else np.zeros((piece.rows, 0))
                _, _, bounds = piece.words()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.rows + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(piece.lo, piece.rows) for c in batch.columns[1:]), pa.array(np.diff(bounds)), lists], names=["doc", "row", "n_tokens", "posteriors"])

    return staged(keyed.mapInArrow(tk.trimmed(run), "doc long, row long, n_tokens long, posteriors array<double>"), "posteriors"), domains


def _spare(whole: int | None) -> Column:
    """What a document's change is multiplied with: its posterior of the domains other than the whole one."""
    return F.lit(1.0) if whole is None else F.greatest(F.lit(0.0), F.lit(1.0) - F.col("posteriors")[whole])


def _rate(history: list[list[float]], whole: int | None = None) -> Column:
    rate = F.lit(1.0)
    for step in history:
        change = F.lit(0.0)
        for d, x in enumerate(step):
            change = change + F.col("posteriors")[d] * F.lit(float(x))
        rate = F.greatest(F.lit(0.0), rate - change * _spare(whole))
    return rate


@dataclass
class Fit:
    domains: list[str]
    available: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    history: list[list[float]]
    converged: bool = True
    whole: int | None = None


def _scaled(bend: np.ndarray, off: np.ndarray, lower_only: bool) -> np.ndarray:
    """The step that the second moments ask for; with `lower_only` without negative parts, of the domains that are too large."""
    if not lower_only:
        return np.linalg.lstsq(bend, off, rcond=1e-12)[0]
    step, active = np.zeros(len(off)), off > 0
    while active.any():
        found = np.linalg.lstsq(bend[np.ix_(active, active)], off[active], rcond=1e-12)[0]
        if (found >= 0).all():
            step[active] = found
            break
        active[np.flatnonzero(active)[found < 0]] = False
    return step


def fit(known: DataFrame, domains: list[str], weights: Mapping[str, float], total: float | None = None, rounds: int = ROUNDS, whole: str | None = None) -> Fit:
    """Projected gradient for the rates. Without a total, the largest at which no domain has to be repeated.

    With a `whole` domain, its available tokens are its target, and the shares of the others are upper bounds (see above).
    """
    k = len(domains)
    w = np.array([max(float(weights.get(d, 0.0)), 0.0) for d in domains])
    w = w / w.sum() if w.sum() else w
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def totals(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and second moments of the posteriors where the rate is above 0."""
        p, rate = [F.col("posteriors")[d] for d in range(k)], F.col("_rate")
        live = F.when(rate > 0, F.col("n_tokens") * F.col("_spare")).otherwise(0)
        rated = known.select("n_tokens", "posteriors", _rate(history, at).alias("_rate"), _spare(at).alias("_spare"))
        row = rated.agg(*(F.sum(F.col("n_tokens") * rate * p[d]) for d in range(k)), *(F.sum(live * p[i] * p[j]) for i, j in pairs)).first()
        a = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            a[i, j] = a[j, i] = x or 0.0
        return np.array([x or 0.0 for x in row[:k]]), a

    at = domains.index(whole) if whole in domains and w[domains.index(whole)] > 0 else None
    if not k:
        return Fit([], np.zeros(0), np.zeros(0), np.zeros(0), [])
    have, a = totals([])
    there = have > 0
    if total is None:
        total = min((have[d] / w[d] for d in range(k) if w[d] > 0 and there[d]), default=0.0)
    target = np.where(there, w * total, 0.0)
    if at is not None:
        likeliest = F.array_position("posteriors", F.array_max("posteriors")) == at + 1
        row = known.where(likeliest).agg(*(F.sum(F.col("n_tokens") * F.col("posteriors")[d]) for d in range(k))).first()
        target = np.where(there, np.minimum(np.maximum(w * (have[at] / w[at]), [x or 0.0 for x in row]), have), 0.0)
    # Errors are relative to the target, those of a domain with target 0 to what there is of it.
    scale = np.where(target > 0, target, np.where(there, have, 1.0))

    def wrong(reached: np.ndarray) -> np.ndarray:
        off = np.where(there, reached - target, 0.0)
        return off if at is None else np.where(np.arange(k) == at, 0.0, np.maximum(off, 0.0))

    def error(reached: np.ndarray) -> float:
        return float(((wrong(reached) / scale) ** 2).sum())

    def met(reached: np.ndarray) -> bool:
        return bool((np.abs(wrong(reached)) <= TOLERANCE * target)[target > 0].all())

    bend = a / (scale[:, None] * scale[None, :])
    least = 1.0 / max(float(np.linalg.eigvalsh(bend)[-1]), 1e-300)
    history: list[list[float]] = []
    reached, passes = have, 0
    while passes < rounds and error(reached) > 1e-8:
        off = wrong(reached)
        plain = least * off / scale**2
        scaled = _scaled(a / (scale[:, None] * scale[None, :]), off / scale, at is not None) / scale
        for step in (scaled, scaled / 2, scaled / 8, plain):
            tried, moments = totals([*history, step.tolist()])
            passes += 1
            if error(tried) < error(reached) * (1 - 1e-3):
                history.append(step.tolist())
                reached, a = tried, moments
                break
        else:
            break
    done = met(reached)
    if not done:
        warnings.warn(f"rates after {passes} passes: {dict(zip(domains, reached.round(), strict=True))} for targets {dict(zip(domains, target.round(), strict=True))}", stacklevel=2)
    return Fit(domains, have, target, reached, history, done, at)


def rates(known: DataFrame, found: Fit) -> DataFrame:
    """doc, row, n_tokens, posteriors, rate."""
    return known.withColumn("rate", _rate(found.history, found.whole))


def _times(rated: DataFrame) -> DataFrame:
    """_mx_doc, _mx_row, _mx_times: how often each document is drawn."""
    spark, given = rated.sparkSession, rated.columns
    top = F.coalesce(F.array_position("posteriors", F.array_max("posteriors")), F.lit(0)) if "posteriors" in given else F.lit(0).cast("bigint")
    size = F.col("n_tokens") if "n_tokens" in given else F.lit(0)
    one = rated.groupBy("doc", "row").agg(F.max("rate").alias("rate"), F.max(top).alias("top"), F.max(size).alias("size"))
    order = ["top", "size", "doc", "row"]
    ranged = staged(one.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "drawn")
    before, sums = 0.5, []
    for x in ranged.groupBy("part").agg(F.sum("rate").alias("sum")).orderBy("part").collect():
        sums.append((x["part"], before))
        before += x["sum"]
    # From an Arrow table, which takes no Python workers; these would be others than those of mapInArrow.
    places = spark.createDataFrame(pa.table([pa.array([x[0] for x in sums], pa.int32()), pa.array([x[1] for x in sums], pa.float64())], ["part", "before"]))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task.
    summed = ranged.join(F.broadcast(places), "part").withColumn("low", F.col("before") + F.coalesce(F.sum("rate").over(inside), F.lit(0.0)))
    # Sums that differ by less than a rounding are the same whole number on both sides of a place.
    times = F.floor(F.round(F.col("low") + F.col("rate"), 9)) - F.floor(F.round("low", 9))
    return summed.select(F.col("doc").alias("_mx_doc"), F.col("row").alias("_mx_row"), times.cast("int").alias("_mx_times")).where("_mx_times > 0")


def draw(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more where the sum of rates passes a whole number.

    Rows of one id and text are drawn alike.
    """
    times = _times(rated)
    keyed = docs.withColumns({"_mx_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_mx_row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    joined = keyed.join(times, ["_mx_doc", "_mx_row"])
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_mx_times")).alias("_mx_n")).select(*docs.columns)


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", whole: str | None = None) -> DataFrame:
    known, domains = posteriors(docs, labels, id_col, text_col, domain_col)
    return draw(docs, rates(known, fit(known, domains, weights, whole=whole)), id_col, text_col)


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain (clean, poor or toxic) from a table with quality and toxic marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
