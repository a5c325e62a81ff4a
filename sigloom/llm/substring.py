"""Removal of passages that an earlier document has, by difference-cover anchors.

A window is `width` consecutive words of one document. Each word is removed that is covered by a window whose word sequence
also starts in a document with a smaller id; all windows are judged on the input.

Copies. Rows of an equal text are one text (its key: 60 bits of SHA-256): all but those of its smallest id lose every word, if they have a window,
and only that one is looked at further.

Anchors. D is a difference cover of the residues modulo P: any difference of two residues is one of two members. Two equal
windows at positions i and j of their texts therefore meet a shift d < P at which both i + d and j + d are in D modulo P,
and the width - P + 1 words from there on lie in both windows. So only these shorter windows, the anchors, at cover positions
are hashed (6 of 31 positions), and every equal pair of windows shares an aligned anchor. Their rows (hash, text, position) are
range-partitioned and sorted; each task streams them and passes on the anchors that more than one text has. Texts that
collide in this hash only add windows to the next step.

Extension. Only windows around such an anchor are extended to their full width: 128 bits of BLAKE2b of their words joined by one
space, range-partitioned by digest and document, sorted and streamed. All but the rows of a digest's first document are
repeats. No pairs of documents are made, a passage that a third of all documents holds is spread over many tasks, and only the
first and last hash of a task may go on in others: their undecided rows are settled by a join with one row for each task edge.

Defined cases: a null or empty text has no words. Rows with equal ids are one document: none removes words of the other, and
each keeps its own. Rows without an id (or with the id -2^63) are together one document before all others. With fewer words
than a window nothing is removed. An empty table gives an empty result. Other columns pass through; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.graph import SALTS, join_spread

from . import textkit as tk
from .stage import release, staged

NO_ID = -(1 << 63)
WIDTH, PERIOD = 50, 31
SPACES = r"[\x20\x09-\x0D]+"


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues of which every residue is a difference; sizes are tried in order, members depth first."""

    def grow(cover: list[int], met: frozenset[int], size: int) -> list[int] | None:
        if len(met) == period:
            return cover
        left = size - len(cover)
        # A new member brings two differences with each member before it.
        if len(met) + sum(2 * (len(cover) + i) for i in range(left)) < period:
            return None
        for x in range(cover[-1] + 1, period):
            found = grow([*cover, x], met | {(x - y) % period for y in cover} | {(y - x) % period for y in cover}, size) if left else None
            if found:
                return found
        return None

    if period == 1:
        return [0]
    return next(found for size in range(1, period + 1) if (found := grow([0], frozenset([0]), size)))


def _list(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(rows.astype(np.int32)))


def _anchor_rows(width: int, period: int):
    """hash, text's key, salt, pos of the anchors of (key, salt, text)."""
    cover, size = np.array(difference_cover(period)), width - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, salt = (np.asarray(batch.column(i)) for i in (0, 1))
            for piece in tk.row_slices(batch.column(2)):
                s, e, bounds = piece.words()
                n = np.diff(bounds)
                have = np.where(n >= width, n - size + 1, 0)  # a shorter text has no window to be an anchor of
                at = np.concatenate([[0], np.cumsum(have)])
                if not at[-1]:
                    continue
                row = np.repeat(np.arange(piece.rows), have)
                pos = np.arange(at[-1]) - at[row]
                taken = np.flatnonzero(np.isin(pos % period, cover))
                row, pos = row[taken], pos[taken]
                words, total = piece.hashes(s, e, False), np.zeros(len(taken), np.uint64)
                first = bounds[row] + pos
                for j in range(size):
                    total = total * np.uint64(0xE7037ED1A0B428DB) + words[first + j]
                cols = [tk.mix(total).view(np.int64), doc[piece.lo + row], salt[piece.lo + row], pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h0", "doc", "salt", "pos"])

    return run


def _window_rows(width: int, period: int):
    """h0, h1, doc, row, pos of the windows around the anchors: from (text, doc, row, anchors)."""
    size = width - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for large in batches for small in tk.small_batches(large)):
            doc, row = (np.asarray(batch.column(i)) for i in (1, 2))
            for i, text in enumerate(batch.column(0)):
                anchors = np.asarray(batch.column(3)[i].values)
                piece = next(tk.row_slices(pa.array([text.as_py()], pa.string())))
                s, e, _ = piece.words()
                if len(s) < width:
                    continue
                edge = np.zeros(len(s) + 1, np.int64)  # windows from `first` to the anchor hold it whole
                anchors = anchors[anchors + size <= len(s)]
                np.add.at(edge, np.maximum(anchors - period + 1, 0), 1)
                np.add.at(edge, anchors + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(s) - width + 1] > 0)
                length = e - s
                start = np.concatenate([[0], np.cumsum(length + 1)])  # of each word where the words are joined by one space
                plain = b" ".join(memoryview(piece.b)[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True))
                held = memoryview(plain)
                digests = b"".join([blake2b(held[x:y], digest_size=16).digest() for x, y in zip(start[at].tolist(), (start[at + width] - 1).tolist(), strict=True)])
                keys = np.frombuffer(digests, np.int64).reshape(len(at), 2)
                cols = [np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), np.full(len(at), doc[i]), np.full(len(at), row[i]), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h0", "h1", "doc", "row", "pos"])

    return run


def _stream(hashes: int, first_too: bool):
    """Decides rows of (hashes, doc, salt or row, pos) that are sorted by the hashes and the document (of anchors: the text).

    Yields kind 0: rows of a later document than the first of their hash, and with `first_too` also those of the first one if
    there is a later one; kind 2: rows of the first document that a hash has in this task, which other tasks decide; kind 1, for
    the hashes at the task's edges: their first document, and the last one in `last`. Between batches only the open hash is kept,
    with rows of one document at most; `ghost` marks kept rows that have been yielded or never are.
    """
    names = [*(f"h{i}" for i in range(hashes)), "doc", "salt" if hashes == 1 else "row", "pos"]

    def part(kind: int, rows: np.ndarray, last: np.ndarray | None = None) -> pa.RecordBatch:
        cols = [np.full(rows.shape[1], kind, np.int32), *rows[: hashes + 1], rows[hashes + 1].astype(np.int32 if hashes == 1 else np.int64), rows[-1].astype(np.int32), rows[hashes] if last is None else last]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["kind", *names, "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ghost, leading = np.zeros((len(names), 0), np.int64), np.zeros(0, bool), True
        for batch in chain(batches, [None]):
            final, rows = batch is None, kept
            if not final:
                fresh = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
                rows, ghost = np.concatenate([kept, fresh], axis=1), np.concatenate([ghost, np.zeros(fresh.shape[1], bool)])
            if not rows.shape[1]:
                continue
            start = np.ones(rows.shape[1], bool)
            start[1:] = (rows[:hashes, 1:] != rows[:hashes, :-1]).any(axis=0)
            head, group = np.flatnonzero(start), np.cumsum(start) - 1
            end = np.append(head[1:], rows.shape[1]) - 1
            doc = rows[hashes]
            later = doc != doc[head][group]
            many = doc[end] != doc[head]
            closed, edge = np.ones(len(head), bool), np.zeros(len(head), bool)
            closed[-1], edge[0] = final, leading
            edge[-1] |= final
            told = later | many[group] if first_too else later
            if (out := told & ~ghost).any():
                yield part(0, rows[:, out])
            open_ends = ~told & ~ghost & edge[group]
            if first_too:
                open_ends &= closed[group]  # a later document may still come in this task
            else:
                open_ends &= (group == 0) & leading
            if open_ends.any():
                yield part(2, rows[:, open_ends])
            if len(known := np.flatnonzero(edge & closed)):
                yield part(1, rows[:, head[known]], doc[end[known]])
            if final:
                return
            at = np.arange(head[-1], rows.shape[1])
            if first_too and not many[-1]:
                ghost = ghost[at]
            else:
                at = np.array([head[-1], end[-1]])  # both are told, or never are
                ghost = np.ones(2, bool)
            kept, leading = rows[:, at], leading and len(head) == 1

    return run


def _decided(rows: DataFrame, hashes: int, first_too: bool, name: str) -> DataFrame:
    """The told rows of `_stream` over all tasks: doc, salt or row, pos. `rows` is a staged table and is removed."""
    keys = [f"h{i}" for i in range(hashes)]
    kinds = "kind int, " + ", ".join(f"{k} {t}" for k, t in rows.dtypes) + ", last long"
    cuts = [*keys, "doc", "salt"] if "salt" in rows.columns else [*keys, "doc"]
    in_order = rows.repartitionByRange(*cuts).sortWithinPartitions(*keys, "doc")
    judged = staged(in_order.mapInArrow(tk.trimmed(_stream(hashes, first_too)), kinds), name)
    release(rows)
    # At most two rows per task: as many as there are tasks, whatever the data.
    totals = judged.where("kind = 1").groupBy(*keys).agg(F.min("doc").alias("first_doc"), F.max("last").alias("last_doc"))
    settled = judged.where("kind = 2").join(F.broadcast(totals), keys).where("last_doc <> first_doc" if first_too else "doc <> first_doc")
    cols = [c for c in rows.columns if c not in keys]
    return judged.where("kind = 0").select(*cols).unionByName(settled.select(*cols))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With the document and the key of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return docs.withColumns({"_ss_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_ss_row": key})


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """_ss_doc, _ss_row, _ss_at: the positions, in words, of the windows of each document that an earlier one has; null: all of them."""
    if not 1 <= period <= width:
        raise ValueError("period must be between 1 and width")
    keyed = _keys(docs, id_col, text_col)
    slim = keyed.select("_ss_row", F.pmod("_ss_doc", F.lit(SALTS)).cast("int").alias("salt"), F.col(text_col).cast("string").alias("text"))
    anchors = staged(slim.mapInArrow(tk.trimmed(_anchor_rows(width, period)), "h0 long, doc long, salt int, pos int"), "anchors")
    shared = _decided(anchors, 1, True, "shared").groupBy(F.col("doc").alias("_ss_row")).agg(F.collect_set("pos").alias("anchors"))
    own = staged(keyed.select("_ss_doc", "_ss_row").distinct(), "keys")
    firsts = staged(own.groupBy("_ss_row").agg(F.min("_ss_doc").alias("first_doc"), F.max("_ss_doc").alias("last_doc")), "firsts")
    asked = shared.join(firsts, "_ss_row").select("_ss_row", F.col("first_doc").alias("_ss_doc"), "anchors")
    texts = keyed.select(F.col(text_col).cast("string").alias("text"), "_ss_doc", "_ss_row").join(asked, ["_ss_doc", "_ss_row"]).select("text", "_ss_doc", "_ss_row", "anchors")
    windows = staged(texts.mapInArrow(tk.trimmed(_window_rows(width, period)), "h0 long, h1 long, doc long, row long, pos int"), "windows")
    found = _decided(windows, 2, False, "repeats").groupBy(F.col("doc").alias("_ss_doc"), F.col("row").alias("_ss_row")).agg(F.collect_set("pos").alias("_ss_at"))
    copied = firsts.where("first_doc <> last_doc").select("_ss_row", "first_doc")
    copies = join_spread(own, copied, "_ss_row", "_ss_doc").where("_ss_doc <> first_doc")
    return found.unionByName(copies.select("_ss_doc", "_ss_row", F.lit(None).cast("array<int>").alias("_ss_at")))


def _apply(width: int):
    """Text (column 0), repeated windows (column 1) and whether there are any (column 2) to the kept text and two counts; other columns follow as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for large in batches for small in tk.small_batches(large)):
            texts, counts, gone = batch.column(0).to_pylist(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for piece in tk.row_slices(batch.column(0)):
                s, e, bounds = piece.words()
                counts[piece.lo : piece.hi] = np.diff(bounds)
                for i in range(piece.lo, piece.hi):
                    (lo, hi), at = bounds[i - piece.lo : i - piece.lo + 2], batch.column(1)[i]
                    if not batch.column(2)[i].as_py() or hi - lo < width:
                        continue
                    at = np.asarray(at.values) if at.is_valid else np.arange(hi - lo - width + 1)
                    edge = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    drop = np.concatenate([np.cumsum(edge)[:-1] > 0, [False]])
                    gone[i] = drop.sum()
                    # Of a removed run its words go, and the white space behind it; behind the last word all that follows.
                    ends = np.append(s[lo:hi], piece.o[i - piece.lo + 1])
                    turn = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0))
                    cuts = [int(piece.o[i - piece.lo]), *ends[turn].tolist(), int(piece.o[i - piece.lo + 1])]
                    texts[i] = b"".join(bytes(piece.b[x:y]) for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            cols = [pa.array(texts, pa.string()), pa.array(counts), pa.array(gone), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(cols, names=["_ss_text", "_ss_words", "_ss_removed", *batch.schema.names[3:]])

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """The documents with their kept text, and n_words (before) and n_removed (replaced if present)."""
    found = repeats(docs, id_col, text_col, width, period)
    docs = docs.drop("n_words", "n_removed")
    rest = [c for c in docs.columns if c != text_col]
    joined = _keys(docs, id_col, text_col).join(found.withColumn("_ss_any", F.lit(True)), ["_ss_doc", "_ss_row"], "left")
    fed = joined.select(F.col(text_col).cast("string").alias("_ss_text"), "_ss_at", "_ss_any", *rest)
    done = fed.mapInArrow(tk.trimmed(_apply(width)), "_ss_text string, _ss_words long, _ss_removed long" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in rest))
    return done.select(*(F.col("_ss_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), F.col("_ss_words").alias("n_words"), F.col("_ss_removed").alias("n_removed"))


def digest(done: DataFrame) -> DataFrame:
    """The query's columns: the kept words joined by one space; a text without words has the digest of the empty text."""
    one_spaced = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), "^ | $", "")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(one_spaced.cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS first_doc FROM w GROUP BY k HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM w JOIN f ON w.k = f.k AND w.doc_id <> f.first_doc),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t FROM x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
