"""Language identification of words and texts by a linear-chain conditional random field.

Tokens are maximal runs of letters (ASCII letters and all non-ASCII bytes). A token's emission scores are sums of
learned weights of its hashed features: the word, prefixes and suffixes of 1 to 4 bytes, byte trigrams, and a lexicon
of word frequencies per language. Together with learned transitions, forward-backward gives each token's
posterior over the languages. Long texts are cut into blocks whose transfer matrices are multiplied first, so the
sums are exact over the whole text and still vectorised.

Training is on the driver, on a bounded sample (`per_lang` texts of each language, chosen by a hash of the id); every language
that occurs is learned, so sample and model grow with the number of languages.
Pieces of texts of several languages are joined into sequences, so that the transitions see code-switching.

Defined cases: a text that is null or has no letter is `und` with score 0.0; so is every text if nothing can be
learned. Ties go to the first language in alphabetical order. Repeated rows are each returned. An empty table gives
an empty result. `lang`, `source` and the id are never inputs of a prediction; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .quality import crc_part

U64 = np.uint64
BITS = 17
SIZE = 1 << BITS
BLOCK = 128
SEQUENCE, PIECE = 48, (6, 40)
EPOCHS, BATCH, STEP = 2, 64, 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (tk.mix(hashes ^ U64(kind * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - BITS)).astype(np.int64)


def token_slots(piece: tk.Slice, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the fixed features (tokens x 9); the first is the word's."""
    cols = [_slot(piece.hashes(s, e, True), 0)]
    for k in range(1, 5):
        cols.append(_slot(piece.hashes(s, np.minimum(s + k, e), True), k))
        cols.append(_slot(piece.hashes(np.maximum(e - k, s), e, True), 8 + k))
    return np.stack(cols, axis=1)


def trigram_slots(piece: tk.Slice, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all byte trigrams of the tokens, and the token bounds."""
    n = np.maximum(e - s - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(s - bounds[:-1], n) + np.arange(bounds[-1])
    low = tk._LOWER[piece.b].astype(U64)
    code = low[at] << U64(16) | low[at + 1] << U64(8) | low[at + 2] if len(at) else np.zeros(0, U64)
    return _slot(code, 20), bounds


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SIZE x languages
    lexicon: np.ndarray  # SIZE x languages: log share of a word's occurrences
    lexicon_weight: np.ndarray
    transitions: np.ndarray  # log, from x to

    def emissions(self, piece: tk.Slice, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        fixed = token_slots(piece, s, e)
        out = self.weights[fixed].sum(axis=1) + self.lexicon[fixed[:, 0]] * self.lexicon_weight
        slots, bounds = trigram_slots(piece, s, e)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if len(some):
            out[some] += np.add.reduceat(self.weights[slots], bounds[some], axis=0)
        return out


def posteriors(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over every row of tokens; tokens x languages."""
    m = scores.shape[1]
    if not len(scores):
        return np.zeros((0, m))
    t = np.exp(transitions)
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    begin = np.repeat(bounds[:-1], blocks) + nth * BLOCK
    size = np.minimum(np.repeat(bounds[1:], blocks) - begin, BLOCK)
    width = int(size.max())
    index = np.minimum(begin[:, None] + np.arange(width), len(scores) - 1)
    valid = np.arange(width) < size[:, None]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))[index]
    e /= e.sum(axis=2, keepdims=True)
    power = np.broadcast_to(np.eye(m), (len(begin), m, m)).copy()
    if blocks.max() > 1:
        for i in range(width):
            step = (power @ t) * e[:, i, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            power = np.where(valid[:, i, None, None], step, power)
    start, end = np.full((len(begin), m), 1.0 / m), np.ones((len(begin), m))
    for k in range(1, int(blocks.max())):
        at = first[:-1][blocks > k] + k
        v = np.einsum("bi,bij->bj", start[at - 1], power[at - 1])
        start[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(blocks.max()) - 1, 0, -1):
        at = first[:-1][blocks > k] + k
        v = np.einsum("bij,bj->bi", power[at], end[at])
        end[at - 1] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((width, len(begin), m))
    v = start
    for i in range(width):
        v = (v @ t) * e[:, i]
        v /= v.sum(axis=1, keepdims=True)
        forward[i] = v
    v = end
    for i in range(width - 1, -1, -1):
        live = valid[:, i, None]
        forward[i] *= np.where(live, v, 1.0)
        step = (v * e[:, i]) @ t.T
        v = np.where(live, step / step.sum(axis=1, keepdims=True), v)
    both = forward.transpose(1, 0, 2)[valid]
    return both / both.sum(axis=1, keepdims=True)


def _chains(scores: np.ndarray, gold: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of equally long chains (chains x steps x languages) in scores and transitions."""
    b, n, m = scores.shape
    t = np.exp(transitions)
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, z = np.empty((n, b, m)), np.ones((n, b, m))
    v = np.full((b, m), 1.0 / m)
    for i in range(n):
        v = (v @ t) * e[:, i]
        v /= v.sum(axis=1, keepdims=True)
        a[i] = v
    for i in range(n - 2, -1, -1):
        v = (z[i + 1] * e[:, i + 1]) @ t.T
        z[i] = v / v.sum(axis=1, keepdims=True)
    node = a * z
    node /= node.sum(axis=2, keepdims=True)
    edge = a[:-1, :, :, None] * t * (e.transpose(1, 0, 2)[1:] * z[1:])[:, :, None, :]
    edge /= edge.sum(axis=(2, 3), keepdims=True)
    hot = np.eye(m)[gold]
    seen = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    return hot - node.transpose(1, 0, 2), seen - edge.sum(axis=(0, 1))


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    m = len(names)
    fixed, grams, gram_n, labels, doc = [], [], [], [], []
    for piece in tk.row_slices(pa.array(texts, pa.string())):
        s, e, bounds = piece.runs(_LETTER[piece.b])
        slots, at = trigram_slots(piece, s, e)
        fixed.append(token_slots(piece, s, e))
        grams.append(slots)
        gram_n.append(np.diff(at))
        of = np.repeat(np.arange(piece.rows), np.diff(bounds)) + piece.lo
        doc.append(of)
        labels.append(np.array([names.index(langs[i]) for i in of], np.int64))
    fixed_slots, gram_slots, gram_count = np.concatenate(fixed), np.concatenate(grams), np.concatenate(gram_n)
    gold, owner = np.concatenate(labels).astype(np.int64), np.concatenate(doc)
    if not len(gold):
        return None
    counts = np.stack([np.bincount(fixed_slots[gold == k, 0], minlength=SIZE) for k in range(m)], axis=1).astype(float)
    known = counts.sum(axis=1, keepdims=True) >= 3
    lexicon = np.where(known, np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)), 0.0)
    gram_at = np.concatenate([[0], np.cumsum(gram_count)])
    weights, squares = np.zeros((SIZE, m)), np.full((SIZE, m), 1e-8)
    lex, lex_squares = np.zeros(m), np.full(m, 1e-8)
    trans, trans_squares = np.zeros((m, m)), np.full((m, m), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        # Pieces of one text each, in random order, then cut into chains of one length.
        cuts, at = [0], 0
        steps = rng.integers(*PIECE, size=len(gold) // PIECE[0] + 2)
        change = np.flatnonzero(np.diff(owner)) + 1
        for step in steps:
            at += int(step)
            if at >= len(gold):
                break
            cuts.append(at)
        bounds = np.unique(np.concatenate([cuts, change, [len(gold)]]))
        order = rng.permutation(len(bounds) - 1)
        tokens = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in order])
        chains = np.resize(tokens, (-(-len(tokens) // SEQUENCE), SEQUENCE))
        for lo in range(0, len(chains), BATCH):
            part = chains[lo : lo + BATCH]
            flat = part.ravel()
            n = gram_count[flat]
            token_of = np.concatenate([np.repeat(np.arange(len(flat)), 9), np.repeat(np.arange(len(flat)), n)])
            inner = np.concatenate([[0], np.cumsum(n)])
            slots = np.concatenate([fixed_slots[flat].ravel(), gram_slots[np.repeat(gram_at[flat] - inner[:-1], n) + np.arange(inner[-1])]])
            rows, back = np.unique(slots, return_inverse=True)
            dense = weights[rows]
            score = np.stack([np.bincount(token_of, dense[back, k], len(flat)) for k in range(m)], axis=1)
            lex_rows = lexicon[fixed_slots[flat, 0]]
            score += lex_rows * lex
            up, up_trans = _chains(score.reshape(len(part), SEQUENCE, m), gold[part], trans)
            up = up.reshape(-1, m) / len(part)
            grad = np.stack([np.bincount(back, up[token_of, k], len(rows)) for k in range(m)], axis=1)
            squares[rows] += grad**2
            weights[rows] += STEP * grad / np.sqrt(squares[rows])
            g = (up * lex_rows).sum(axis=0)
            lex_squares += g**2
            lex += STEP * g / np.sqrt(lex_squares)
            g = up_trans / len(part)
            trans_squares += g**2
            trans += STEP * g / np.sqrt(trans_squares)
    return Model(names, weights.astype(np.float32), lexicon.astype(np.float32), lex.astype(np.float32), trans)



def _labeller(model: Model | None, with_runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.row_slices(batch.column(0), 1 << 20):
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII[piece.b])])[piece.o]
                speaks = np.diff(ascii_letters) > 0
                for i in np.flatnonzero(~speaks & (np.diff(piece.o) > 0)):
                    text = bytes(piece.b[piece.o[i] : piece.o[i + 1]]).decode("utf-8", "replace")
                    speaks[i] = any(c.isalpha() for c in text)
                s, e, bounds = piece.runs(_LETTER[piece.b])
                pred, score = np.full(piece.rows, "und", object), np.zeros(piece.rows)
                runs: list[list[dict]] = [[] for _ in range(piece.rows)]
                n = np.diff(bounds)
                if model is not None and len(s):
                    post = posteriors(model.emissions(piece, s, e).astype(float), bounds, model.transitions)
                    some = np.flatnonzero((n > 0) & speaks)
                    full = np.flatnonzero(n > 0)
                    total = np.zeros((piece.rows, len(model.langs)))
                    total[full] = np.add.reduceat(post, bounds[full], axis=0)
                    best = total.argmax(axis=1)
                    for i in some:
                        pred[i] = model.langs[best[i]]
                    score[some] = np.clip(total[some, best[some]] / n[some], 0.0, 1.0)
                if with_runs and model is not None and len(s):
                    word = post.argmax(axis=1)
                    cut = np.ones(len(word), bool)
                    cut[1:] = word[1:] != word[:-1]
                    cut[bounds[:-1][n > 0]] = True
                    at = np.flatnonzero(cut)
                    length = np.diff(np.concatenate([at, [len(word)]]))
                    owner = np.searchsorted(bounds, at, "right") - 1
                    for i, k, x in zip(owner.tolist(), word[at].tolist(), length.tolist(), strict=True):
                        runs[i].append({"lang": model.langs[k], "words": x})
                cols = [pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([*cols, *(c.slice(piece.lo, piece.rows) for c in batch.columns[1:])], names=["lang_pred", "score", "runs", *batch.schema.names[1:]])

    return run


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, parts: int, held_part: int, per_lang: int) -> list[tuple[str, str]]:
    """At most `per_lang` (text, language) of each language, by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.coalesce(crc_part(F.col(id_col), parts), F.lit(held_part)) != held_part))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000))
    # A row for each language, far less than the model that is broadcast later: no text is shuffled for it.
    chosen = known.join(F.broadcast(sizes), "lang").where(place < F.least(F.lit(1e6), F.lit(0.95e6 * per_lang) / F.col("n")))
    # A hash of the id gives about as many; rows that share an id come together, so the number is held here.
    ranked = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", "text"))).where(F.col("_nth") <= per_lang)
    return [(r["text"] or "", r["lang"]) for r in ranked.orderBy("lang", "_nth").select("text", "lang").collect()]


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_part: int = 2, per_lang: int = 300, with_runs: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and runs (language and number of words; empty if not asked for) of each row."""
    rows = sample(docs, id_col, text_col, lang_col, parts, held_part, per_lang)
    model = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in rows], [x for _, x in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _labeller(model.value, with_runs)(batches)

    kind = docs.schema[id_col].dataType.simpleString()
    done = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).mapInArrow(run, f"lang_pred string, score double, runs array<struct<lang:string,words:int>>, doc_id {kind}")
    held = F.coalesce(crc_part(F.col("doc_id"), parts) == held_part, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "lang_pred", "score", "runs")
