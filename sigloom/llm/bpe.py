"""Byte-level BPE encoding and decoding by a rank file.

Text is split by a pattern; each match is encoded on its own. Its bytes start as a linked list of parts. A queue
keyed by merge rank holds positions: one bucket (a heap of positions) per rank, and a two-level bitmap of
256-bit words over the ranks that have a bucket. Find-first-set on each level gives the lowest rank in two
steps whatever the length, the bucket its leftmost position; entries whose pair has changed since are stale and
skipped. A match of n bytes takes O(n log n), so a single very long match is no special case. Encoded
matches of up to MEMO_CHARS characters are kept in a memo of bounded size.

Defined cases: a null or empty text has no ids and decodes to the empty text. Ids are those of the rank file;
no special tokens. Repeated rows are encoded alike. An empty table gives an empty result. `encode` and `decode`
pass all other columns through; a column named like the added one is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MEMO_SIZE, MEMO_CHARS = 350_000, 48
NO_RANK = -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one match.

    `buckets` holds positions by rank, `low` a word of 256 bits for each group of ranks with a bucket, `top`
    one bit for each group. The queue is written out in place: most matches are a few bytes long.
    """
    find = ranks.get
    whole = find(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [find(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    pair.append(NO_RANK)
    # A bucket of one position is that position; of more, a heap.
    buckets: dict[int, int | list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    fresh = range(n - 1)
    while True:
        for i in fresh:
            rank = pair[i]
            if rank < 0:
                continue
            if rank in buckets:
                bucket = buckets[rank]
                if bucket.__class__ is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            else:
                buckets[rank] = i
                group = rank >> 8
                top |= 1 << group
                if group in low:
                    low[group] |= 1 << (rank & 255)
                else:
                    low[group] = 1 << (rank & 255)
        if not top:
            break
        group = (top & -top).bit_length() - 1
        bits = low[group]
        rank = group << 8 | (bits & -bits).bit_length() - 1
        i = buckets[rank]
        if i.__class__ is not int:
            bucket, i = i, heappop(i)
        else:
            bucket = None
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                low[group] = bits
            else:
                del low[group]
                top &= top - 1
        if pair[i] != rank:
            fresh = ()
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = NO_RANK
        h = before[i]
        if k < n:
            before[k] = i
            pair[i] = find(piece[i : after[k]], NO_RANK)
        else:
            pair[i] = NO_RANK
        if h >= 0:
            pair[h] = find(piece[h:k], NO_RANK)
            fresh = (h, i)
        else:
            fresh = (i,)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class Encoder(dict):
    """Ids of a match, as the bytes of 32-bit numbers, by the match; `text` gives those of a text.

    The memo has two generations: when the young one (this dict) is full it becomes the old one, and what is
    still used moves back, so frequent matches stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split, self.old = ranks, regex.compile(pattern).findall, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.old.pop(match, None)
        if ids is None:
            ids = array("i", merge(match.encode(), self.ranks)).tobytes()
        if len(match) <= MEMO_CHARS:
            self[match] = ids
        return ids

    def text(self, text: str) -> np.ndarray:
        ids = np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), np.int32)
        if len(self) > MEMO_SIZE:
            self.old = dict(self)
            self.clear()
        return ids


_workers: dict[tuple[int, str], Encoder] = {}
tk.caches.append(_workers.clear)


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One per worker process, whose memo then serves all its tasks, until other operators use the worker."""
    key = (hash(data), pattern)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(read_ranks(data), pattern)
    return _workers[key]


def _others(df: DataFrame, *names: str) -> tuple[list[str], str]:
    rest = [c for c in df.columns if c not in names]
    return rest, "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in rest)


def _tokens(data: bytes) -> Callable[[int], bytes]:
    return {rank: token for token, rank in read_ranks(data).items()}.__getitem__


def _token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Token bytes by id."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def _joined(tokens: pa.Array, ids: np.ndarray, bounds: list[int]) -> pa.Array:
    """The bytes of the tokens between one bound and the next, as one value each."""
    taken = tokens.take(pa.array(ids))
    _, places, data = taken.buffers()
    ends = np.frombuffer(places, np.int64, len(ids) + 1)[bounds]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), data or pa.py_buffer(b"")]).cast(pa.binary())


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """With the ids of each text; and with the bytes that these stand for, as `decode` gives them, if a column for them is named.

    The rank file is read here and broadcast: its size is fixed, about 1 MB.
    """
    with open(rank_file, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    both = bytes_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        tokens = _token_table(encoder.ranks) if both else None
        for batch in batches:
            done, flat = 0, []
            bounds = [0]
            for i, text in enumerate(batch.column(0)):
                ids = encoder.text(text.as_py() or "")
                flat.append(ids)
                bounds.append(bounds[-1] + len(ids))
                if bounds[-1] >= 1 << 20 or i == batch.num_rows - 1:
                    every = np.concatenate(flat)
                    made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(every))]
                    if both:
                        made.append(_joined(tokens, every, bounds))
                    part = batch.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([*made, *part.columns], names=["_bpe_ids", *["_bpe_bytes"] * both, "_bpe_text", *part.schema.names[1:]])
                    done, flat, bounds = i + 1, [], [0]

    rest, types = _others(docs, text_col, ids_col, bytes_col or ids_col)
    fed = docs.select(F.col(text_col).alias("_bpe_text"), *rest)
    out = fed.mapInArrow(run, "_bpe_ids array<int>, " + "_bpe_bytes binary, " * both + "_bpe_text string" + types)
    kept = [F.col("_bpe_text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in (ids_col, bytes_col)]
    return out.select(*kept, F.col("_bpe_ids").alias(ids_col), *([F.col("_bpe_bytes").alias(bytes_col)] if both else []))


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """With the bytes that the ids of each row stand for."""
    with open(rank_file, "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(ranks.value)
        for batch in batches:
            done = [b"".join(map(token, np.asarray(ids.values).tolist())) if ids.is_valid else b"" for ids in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), *batch.columns], names=["_bpe_bytes", *batch.schema.names])

    rest, types = _others(encoded, ids_col, bytes_col)
    fed = encoded.select(F.col(ids_col).alias("_bpe_ids"), *rest)
    out = fed.mapInArrow(run, "_bpe_bytes binary, _bpe_ids array<int>" + types)
    return out.select(*(F.col("_bpe_ids").alias(c) if c == ids_col else F.col(c) for c in encoded.columns if c != bytes_col), F.col("_bpe_bytes").alias(bytes_col))


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    done = encode(docs.select("doc_id", "text"), rank_file, pattern, bytes_col="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
