"""Quality rules: base counts of each text, and cross-document line frequency per host.

Lines are normalised (0x20 and 0x09-0x0D stripped at both ends, A-Z lower-cased) and hashed. A line's
frequency is the number of distinct texts of its host that hold it, so exact copies of one text count once. A line
above max(min_docs, max_share of the host's distinct texts) is boilerplate and is removed; a document of
which less than min_left of its words remain is depleted and rejected, as is one that fails the base
counts. One pass computes counts and line hashes; lines are counted with partial aggregation, so a very
common line or host is combined before the shuffle, and hosts are never gathered in one task.

Defined cases: a null text has no words and fails; an empty or null host is one host of its own; lines
without a word are never boilerplate; repeated rows are judged alike, each row is returned. An empty table
gives an empty result. Other columns pass through `reject`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .stage import staged

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.08, 0.3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
U64 = np.uint64


def _per_row(mask: np.ndarray, o: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[o[1:]] - sums[o[:-1]]


def _of_row(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def line_keys(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: the hash of its normalised form (0 without a word), its number of words; and row bounds."""
    s, e, bounds = piece.lines()
    ws, we, _ = piece.words()
    first, last = np.searchsorted(ws, s), np.searchsorted(we, e, "right")
    n = np.maximum(last - first, 0)
    keys, some = np.zeros(len(s), U64), np.flatnonzero(n)
    keys[some] = piece.digests(ws[first[some]], we[last[some] - 1], True)
    return keys, n, bounds


def counts(piece: tk.Slice) -> dict[str, np.ndarray]:
    s, e, bounds = piece.words()
    letter = (piece.b & 0xC0) != 0x80
    inside = letter & ~tk._SPACE[piece.b]
    w, at = tk.windows(piece.digests(s, e, False), bounds)
    owner = _of_row(at)
    keyed = w ^ tk.mix(owner.astype(U64))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    where = np.flatnonzero(again)
    start = bounds[owner[where]] + where - at[owner[where]]
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + 5, -1)
    covered = np.cumsum(step)[: len(s)] > 0
    ls, le, lb = piece.lines()
    worded = np.searchsorted(s, ls) < np.searchsorted(s, le)
    row = _of_row(lb)[worded]
    line = piece.digests(ls[worded], le[worded], False) ^ tk.mix(row.astype(U64))
    _, first = np.unique(line, return_index=True)
    rows = piece.rows
    return {
        "n_words": np.diff(bounds),
        "word_chars": _per_row(inside, piece.o),
        "n_symbols": _per_row(_SYMBOL[piece.b], piece.o),
        "n_dup_lines": np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows),
        "n_repeat_words": _per_row(covered, bounds),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in tk.row_slices(batch.column(0)):
            keys, n, bounds = line_keys(piece)
            row = _of_row(bounds)
            some = np.flatnonzero(n)
            keyed = keys[some] ^ tk.mix(row[some].astype(U64))
            _, first, back = np.unique(keyed, return_index=True, return_inverse=True)
            words = np.bincount(back, weights=n[some], minlength=len(first)).astype(np.int64)
            at = some[first]
            order = np.lexsort((at, row[at]))
            sizes = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=piece.rows))])
            got = counts(piece)
            cols = [pa.array(got[c].astype(np.int64)) for c in COUNTS]
            lists = [tk.long_lists(keys[at][order], sizes), tk.long_lists(words[order].view(U64), sizes)]
            rest = [c.slice(piece.lo, piece.rows) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*rest, *cols, *lists], names=[*batch.schema.names[1:], *COUNTS, "line_keys", "line_words"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _boilerplate(measured: DataFrame, min_docs: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    """Lines of each distinct text (host, row, key, words), and the boilerplate (host, key)."""
    texts = staged(measured.groupBy("host", "row").agg(F.first("line_keys").alias("line_keys"), F.first("line_words").alias("line_words")), "texts")
    lines = texts.select("host", "row", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("host", "row", F.col("l.line_keys").alias("key"), F.col("l.line_words").alias("words"))
    sizes = texts.groupBy("host").agg(F.count("*").alias("texts"))
    often = lines.groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hot = often.join(sizes, "host").where(F.col("docs") > F.col("texts") * max_share).select("host", "key")
    return lines, staged(hot, "boilerplate")


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_removed_words, host and row of every row."""
    schema = "doc_id long, host string, row long, " + ", ".join(f"{c} long" for c in COUNTS) + ", line_keys array<long>, line_words array<long>"
    measured = staged(_keyed(docs, id_col, text_col, host_col).mapInArrow(tk.trimmed(_measure), schema), "measured")
    lines, hot = _boilerplate(measured, min_docs, max_share)
    removed = lines.join(hot, ["host", "key"]).groupBy("host", "row").agg(F.sum("words").alias("removed"), F.collect_list("key").alias("keys"))
    out = measured.select("doc_id", "host", "row", *COUNTS).join(removed, ["host", "row"], "left")
    gone = F.coalesce("removed", F.lit(0))
    depleted = F.col("n_words") - gone < min_left * F.col("n_words")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~depleted).alias("kept"), gone.alias("n_removed_words"), "host", "row", "keys")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text (column 0) without the lines whose hashes are in column 1; other columns follow."""
    for batch in (small for large in batches for small in tk.small_batches(large)):
        texts = batch.column(0).to_pylist()
        for piece in tk.row_slices(batch.column(0)):
            marked = [i for i in range(piece.rows) if batch.column(1)[piece.lo + i].is_valid]
            if not marked:
                continue
            keys, _, bounds = line_keys(piece)
            for i in marked:
                bad = np.asarray(batch.column(1)[piece.lo + i].values).view(U64)
                own = np.isin(keys[bounds[i] : bounds[i + 1]], bad)
                texts[piece.lo + i] = "\n".join(x for x, out in zip(texts[piece.lo + i].split("\n"), own, strict=True) if not out)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=["_qr_text", *batch.schema.names[2:]])


def reject(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The kept documents without their boilerplate lines; the columns of `docs`."""
    kept = judge(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col("host").alias("_qr_host"), F.col("row").alias("_qr_row"), F.col("keys").alias("_qr_keys"))
    kept = kept.dropDuplicates(["_qr_host", "_qr_row"])
    keyed = docs.withColumns({"_qr_host": F.coalesce(F.col(host_col).cast("string"), F.lit("")), "_qr_row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    rest = [c for c in docs.columns if c != text_col]
    fed = keyed.join(kept, ["_qr_host", "_qr_row"]).select(F.col(text_col), "_qr_keys", *rest)
    done = fed.mapInArrow(tk.trimmed(_strip), "_qr_text string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in rest))
    return done.select(*(F.col("_qr_text").alias(c) if c == text_col else F.col(c) for c in docs.columns))


ORACLE = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) q, range(5) t(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
tx AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM w),
hl AS (SELECT host, text, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
       FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM tx)),
hot AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS docs FROM hl WHERE k <> '' GROUP BY host, k)
        JOIN (SELECT host, count(*) AS texts FROM tx GROUP BY host) USING (host) WHERE docs > {MIN_DOCS} AND docs > texts * {MAX_SHARE}::DOUBLE),
gone AS (SELECT host, text, CAST(sum(len(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n FROM hl JOIN hot USING (host, k) GROUP BY host, text),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone ON gone.host = coalesce(w.source, '') AND gone.text = w.text)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT (n_words - n_removed_words < {MIN_LEFT}::DOUBLE * n_words) AS kept
FROM c
"""
