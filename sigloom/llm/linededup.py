"""Line deduplication by sorted line hashes.

A line's key is the line with 0x20 and 0x09-0x0D stripped at both ends and A-Z lower-cased. A key of at
least `min_chars` code points found in at least `min_docs` documents loses all its lines except in the
largest document id that holds it.

Each long enough line becomes a row (128-bit hash, document, position). The rows are range-partitioned by
(hash, document) and sorted by document, descending, and position, so even one line that a third of all
documents hold is spread over many tasks, and each task streams its rows: the first document of a hash is
the one that keeps it. Only the first and the last hash of a task can go on in another one; their few
undecided rows are settled by a join with one summary row per task edge. The result is a compressed keep
bitmap per document; text is read once more to apply it and never sorted.

Defined cases: a null or empty text is one empty line. Rows that share a document id count as one document;
each row keeps its own lines. Rows without an id count together as one document, smaller than all others.
Repeated lines inside the keeping document all stay. An empty table gives an empty result. Other columns pass
through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .stage import staged

NO_ID = -(1 << 63)
_ROWS = "h1 long, h2 long, doc long, row long, pos int, n_lines int"
_FIELDS = ("h1", "h2", "doc", "row", "pos", "n_lines")


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (np.asarray(batch.column(i)) for i in (0, 1))
            for piece in tk.row_slices(batch.column(2)):
                s, e, bounds = piece.lines()
                ws, we, _ = piece.words()
                first = np.searchsorted(ws, s)
                last = np.searchsorted(we, e, "right") - 1
                keep = np.flatnonzero(first <= last)
                a, z = ws[first[keep]], we[last[keep]]
                long = piece.count((piece.b & 0xC0) != 0x80, a, z) >= min_chars
                keep, a, z = keep[long], a[long], z[long]
                owner = np.searchsorted(bounds, keep, "right") - 1
                n = np.diff(bounds)
                key = piece.wide_digests(a, z, True).view(np.int64)
                cols = [
                    key[:, 0],
                    key[:, 1],
                    doc[piece.lo + owner],
                    row[piece.lo + owner],
                    (keep - bounds[owner]).astype(np.int32),
                    n[owner].astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=list(_FIELDS))

    return run


def _stream(min_docs: int):
    """Decides the rows of one sorted partition.

    Yields kind 0: a row to drop; kind 2: a row of the partition's first or last hash that other
    partitions decide; kind 1: for these hashes, the first document and the number of documents
    (`pos`, at most min_docs). Between batches only the open hash is kept, with rows of fewer than
    min_docs documents; `ghost` marks kept rows that have been yielded or never are.
    """

    def part(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        cols = [np.full(rows.shape[1], kind, np.int32), *rows[:4], *rows[4:].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ghost, leading = np.zeros((6, 0), np.int64), np.zeros(0, bool), True
        for batch in chain(batches, [None]):
            final = batch is None
            rows = kept
            if not final:
                fresh = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(6)])
                rows = np.concatenate([kept, fresh], axis=1)
                ghost = np.concatenate([ghost, np.zeros(fresh.shape[1], bool)])
            if not rows.shape[1]:
                continue
            start = np.ones(rows.shape[1], bool)
            start[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            first = np.flatnonzero(start)
            group = np.cumsum(start) - 1
            doc = start.copy()
            doc[1:] |= rows[2, 1:] != rows[2, :-1]
            nth = np.cumsum(doc)
            nth -= nth[first][group]
            docs = nth[np.concatenate([first[1:], [rows.shape[1]]]) - 1] + 1
            many, whole, edge = docs >= min_docs, np.ones(len(first), bool), np.zeros(len(first), bool)
            whole[-1] = final
            edge[0], edge[-1] = leading, edge[-1] or final or (leading and len(first) == 1)
            later = (nth > 0) & ~ghost
            drop = later & many[group]
            open_ends = later & (edge & whole & ~many)[group]
            if leading:
                open_ends |= (group == 0) & (nth == 0) & ~ghost
            if drop.any():
                yield part(0, rows[:, drop])
            if open_ends.any():
                yield part(2, rows[:, open_ends])
            told = np.flatnonzero(edge & whole)
            if len(told):
                summary = rows[:, first[told]].copy()
                summary[4] = np.minimum(docs[told], min_docs)
                yield part(1, summary)
            if final:
                return
            at = np.arange(first[-1], rows.shape[1])
            if many[-1]:
                heads = at[doc[at]][: min_docs - 1]
                at = np.concatenate([heads, at[-1:]])
                ghost = np.ones(len(at), bool)
            else:
                at = at[(nth[at] > 0) | (at == first[-1])]
                ghost = ghost[at] | (nth[at] == 0)
            kept, leading = rows[:, at], leading and len(first) == 1

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            keep = np.ones(n, bool)
            keep[np.asarray(dropped.values)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["_ld_doc", "_ld_row", "_ld_lines", "_ld_keep"])


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With the document key and a hash of the text, which tells rows of one id apart."""
    return docs.withColumns({"_ld_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_ld_row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document that loses lines: _ld_doc, _ld_row, _ld_lines, _ld_keep (zlib of packed bits)."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    keyed = _keys(docs, id_col, text_col)
    rows = staged(keyed.select("_ld_doc", "_ld_row", text_col).mapInArrow(tk.trimmed(_line_rows(min_chars)), _ROWS), "lines")
    sorted_rows = rows.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
    judged = staged(sorted_rows.mapInArrow(tk.trimmed(_stream(min_docs)), "kind int, " + _ROWS), "judged")
    # One or two rows per task and hash: as many as there are tasks, whatever the data.
    totals = judged.where("kind = 1").groupBy("h1", "h2").agg(F.sum("pos").alias("docs"), F.max("doc").alias("top"))
    settled = judged.where("kind = 2").join(F.broadcast(totals), ["h1", "h2"]).where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("top")))
    cols = ["doc", "row", "pos", "n_lines"]
    dropped = judged.where("kind = 0").select(*cols).unionByName(settled.select(*cols))
    lists = dropped.groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return lists.mapInArrow(tk.trimmed(_bitmaps), "_ld_doc long, _ld_row long, _ld_lines int, _ld_keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text (column 0) and bitmap (column 1) to the kept text and two counts; other columns follow as they are."""
    for batch in (small for large in batches for small in tk.small_batches(large)):
        texts, n_lines, n_dropped = [], [], []
        for text, keep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = 1 + text.count("\n") if text else 1
            if keep is None:
                n_dropped.append(0)
            else:
                parts = text.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=lines).tolist()
                kept = [x for x, b in zip(parts, bits, strict=True) if b]
                n_dropped.append(lines - len(kept))
                text = "\n".join(kept)
            texts.append(text)
            n_lines.append(lines)
        cols = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(cols, names=["_ld_text", "_ld_n_lines", "_ld_n_dropped", *batch.schema.names[2:]])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their kept text and the columns n_lines and n_dropped (replaced if present)."""
    marks = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    docs = docs.drop("n_lines", "n_dropped")
    rest = [c for c in docs.columns if c != text_col]
    joined = _keys(docs, id_col, text_col).join(marks, ["_ld_doc", "_ld_row"], "left")
    fed = joined.select(F.col(text_col), "_ld_keep", *rest)
    done = fed.mapInArrow(tk.trimmed(_apply), "_ld_text string, _ld_n_lines long, _ld_n_dropped long" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in rest))
    return done.select(*(F.col("_ld_text").alias(c) if c == text_col else F.col(c) for c in docs.columns), F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_n_dropped").alias("n_dropped"))


def digest(done: DataFrame) -> DataFrame:
    """The query's columns; a null text has the digest of the empty text."""
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS k FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) t,
    LATERAL (SELECT translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key) k),
hot AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, h.k IS NOT NULL AND l.doc_id <> h.top AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
