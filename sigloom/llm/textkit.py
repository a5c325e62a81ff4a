"""Vectorised text primitives over Arrow string columns.

All helpers work on the UTF-8 bytes of many rows at once, so a Python worker spends its time in numpy
and not in a loop over words. Rows are visited in slices of a bounded number of bytes (`slices`), which
bounds the temporary arrays; one row is never split, so a single very long text is a slice of its own.

Word: a maximal run of bytes outside 0x20 and 0x09-0x0D. UTF-8 lead and continuation bytes are all
above 0x20, so this equals the pattern `[^\\x20\\x09-\\x0D]+` over code points.

Where equal hashes must mean equal text, `wide_digests` gives 128 bits of BLAKE2b and `digests` 64; `windows` folds the digests of
words one by one through a mixer, so that no sum of them can be solved for. `hashes` is only for features of models and for
choosing candidates, where a collision costs nothing: it is polynomial in the bytes modulo 2**64 with an odd base (its powers are
invertible, so the hash of any byte range is a difference of prefix sums) and then mixed with the length; texts that collide in it are easy to build.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SLICE_ROWS = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WIDE = {False: (np.arange(256) + 1).astype(np.uint64), True: (_LOWER.astype(np.uint64) + 1)}

_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []

U64 = np.uint64


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse, both modulo 2**64; grown by doubling."""
    if not _tables or len(_tables[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        _tables.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, U64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _tables.append(np.cumprod(out, dtype=U64))
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
SHORT = 16


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_ROWS rows and `most` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, n)
        yield lo, hi
        lo = hi


class Slice:
    """Rows lo..hi of a string column: bytes `b`, row offsets `o`."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi, self.rows = lo, hi, hi - lo
        self.b = raw[offsets[lo] : offsets[hi]]
        self.o = offsets[lo : hi + 1] - offsets[lo]
        self._sums: dict[bool, np.ndarray] = {}
        self._lower: np.ndarray | None = None
        self._padded: dict[bool, np.ndarray] = {}

    def cased(self, lower: bool) -> np.ndarray:
        """The bytes, A-Z lower-cased if so asked."""
        if lower and self._lower is None:
            self._lower = _LOWER[self.b]
        return self._lower if lower else self.b

    def prefix(self, lower: bool) -> np.ndarray:
        if lower not in self._sums:
            powers, _ = _powers(len(self.b))
            sums = np.empty(len(self.b) + 1, U64)
            sums[0] = 0
            np.cumsum(_WIDE[lower][self.b] * powers[: len(self.b)], out=sums[1:])
            self._sums[lower] = sums
        return self._sums[lower]

    def hashes(self, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
        """Mixed hash of each byte range s..e; for features only."""
        sums, (_, inverse) = self.prefix(lower), _powers(len(self.b))
        return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))

    def digests(self, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit digest of each byte range s..e."""
        data, n = self.cased(lower), e - s
        if self._padded.get(lower) is None:
            self._padded[lower] = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        eight = np.ndarray(len(data) + 9, "<u8", self._padded[lower], 0, (1,))  # the eight bytes from each byte on
        low = eight[s] & _MASK[np.minimum(n, 8)]
        high = eight[np.minimum(s + 8, len(data))] & _MASK[np.clip(n - 8, 0, 8)]
        # Neighbours of one content in this order are hashed once; texts that collide in the order only lie among each other.
        order = np.argsort(mix(low ^ mix(high ^ mix(n.astype(U64)))), kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (n[order[1:]] > SHORT) | (n[order[1:]] != n[order[:-1]]) | (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        heads, held = order[new], memoryview(self._padded[lower])
        found = np.frombuffer(b"".join([blake2b(held[x:y], digest_size=8).digest() for x, y in zip(s[heads].tolist(), e[heads].tolist(), strict=True)]), U64)
        out = np.empty(len(order), U64)
        out[order] = found[np.cumsum(new) - 1]
        return out

    def wide_digests(self, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
        """128-bit digest of each byte range s..e: two columns of 64 bits."""
        data = memoryview(np.ascontiguousarray(self.cased(lower)))
        every = [blake2b(data[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        return np.frombuffer(b"".join(every), U64).reshape(len(s), 2)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the row bounds (rows+1) of all words."""
        return self.runs(~_SPACE[self.b])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for maximal runs of marked bytes inside a row."""
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = self.o[:-1][np.diff(self.o) > 0]
        start[cut] = inside[cut]
        stop = self.o[1:][np.diff(self.o) > 0] - 1
        end[stop] = inside[stop]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, self.o)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row bounds of the lines that \\n splits; an empty row has one empty line."""
        nl = np.flatnonzero(self.b == 10)
        row = np.searchsorted(self.o, nl, "right") - 1
        starts = np.concatenate([self.o[:-1], nl + 1])
        ends = np.concatenate([nl, self.o[1:]])
        order = np.lexsort((starts, np.concatenate([np.arange(self.rows), row])))
        eorder = np.lexsort((ends, np.concatenate([row, np.arange(self.rows)])))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.rows) + 1)])
        return starts[order], ends[eorder], bounds

    def count(self, mask: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How many bytes of each range s..e are in the mask."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[e] - sums[s]


def row_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    raw, offsets = strings(column)
    for lo, hi in slices(offsets, most):
        yield Slice(raw, offsets, lo, hi)


def small_batches(batch: pa.RecordBatch, column: int = 0, most: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of at most `most` bytes of text, or of one row."""
    for lo, hi in slices(strings(batch.column(column))[1], most):
        yield batch.slice(lo, hi - lo)


#: Empties what a worker keeps from task to task for one operator; `trimmed` tasks of the others call these.
caches: list[Callable[[], object]] = []


def give_back() -> None:
    """Empties the caches, and returns to the system what the allocators hold of freed memory."""
    for empty in caches:
        empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; when its task ends, freed memory goes back to the system.

    Workers outlive their tasks, so what their allocators keep of the largest task would stay beside all later stages.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def windows(word_hash: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `width` words inside one row, and the row bounds of the windows."""
    n = np.diff(bounds)
    have = np.maximum(n - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(have)])
    if at[-1] == 0:
        return np.zeros(0, U64), at
    first = np.repeat(bounds[:-1] - at[:-1], have) + np.arange(at[-1])
    total = np.zeros(len(first), U64)
    for j in range(width):
        total = mix(total ^ word_hash[first + j])
    return total, at


def shingles(piece: Slice, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their row bounds.

    Words are lower-cased A-Z. A row with fewer than `width` words has its whole sequence as one
    shingle; a row without words has none.
    """
    s, e, bounds = piece.words()
    h = piece.digests(s, e, True)
    w, at = windows(h, bounds, width)
    n = np.diff(bounds)
    parts, sizes = [], np.zeros(piece.rows, np.int64)
    for i in range(piece.rows):
        if n[i] >= width:
            u = np.unique(w[at[i] : at[i + 1]])
        elif n[i]:
            u = n[i : i + 1].astype(U64)
            for x in h[bounds[i] : bounds[i + 1]]:
                u = mix(u ^ x)
        else:
            continue
        parts.append(u)
        sizes[i] = len(u)
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list<int64> column from flat 64-bit values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
