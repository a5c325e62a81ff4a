"""k-mers of many texts at once, in numpy: distinct ones, and the Bloom rows of canonical ones.

The helpers of tasks that Spark deals texts to. A batch's texts are laid end to end as code points, and an operation takes all
windows of them at a time; those that cross from one text into the next are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points taken at a time, and windows hashed at a time, so that their columns stay in a core's cache.
BLOCK, STRIP = 1 << 19, 1 << 14
C1, C2, ADD = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32(0xE6546B64)
F1, F2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def blocks(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points, lengths) of runs of a batch's texts that have a window of k."""
    rows: list[int] = []
    texts: list[str] = []
    size = 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        if text is None or len(text) < k:
            continue
        rows.append(i)
        texts.append(text)
        size += len(text)
        if size >= BLOCK:
            yield _laid(rows, texts)
            rows, texts, size = [], [], 0
    if rows:
        yield _laid(rows, texts)


def whole(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of a batch's texts of one length each, so that a text is one window."""
    texts = batch.column(column).to_pylist()
    sizes = np.array([-1 if t is None else len(t) for t in texts])
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        yield _laid(rows, [texts[i] for i in rows])


def _laid(rows: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(rows), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts])


def starts(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and where it starts."""
    counts = lengths - (k - 1)
    of = np.repeat(np.arange(len(lengths)), counts)
    ends = np.cumsum(lengths)
    first = (ends - lengths)[of] + np.arange(counts.sum()) - (np.cumsum(counts) - counts)[of]
    return of, first


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _digests(codes: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each window of k: those of two halves that overlap where k is no power of two."""
    part, size = codes.astype(np.uint64), 1
    while size < k:
        step = min(size, k - size)
        part = _mixed(part[: len(part) - step], part[step:])
        size += step
    return part


def distinct(codes: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The number of different windows of each text. Digests sort them; windows of one digest are then compared whole."""
    of, first = starts(lengths, k)
    key = _mixed(_digests(codes, k)[first], of.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    left, right = order[same], order[same + 1]
    equal = of[left] == of[right]
    for t in range(k):
        equal &= codes[first[left] + t] == codes[first[right] + t]
    if equal.all():
        fresh = np.ones(len(order), bool)
        fresh[same + 1] = False
        return np.bincount(of[order[fresh]], minlength=len(lengths))
    whole = np.lib.stride_tricks.sliding_window_view(codes, k)
    return np.array([len(np.unique(whole[first[of == i]], axis=0)) for i in range(len(lengths))])


def _smaller_behind(codes: np.ndarray, turned: np.ndarray, first: np.ndarray, behind: np.ndarray, k: int) -> np.ndarray:
    """Whether the reverse complement of a window comes before the window."""
    less, open_ = np.zeros(len(first), bool), np.arange(len(first))
    for t in range(k):
        a, b = codes[first[open_] + t], turned[behind[open_] + t]
        less[open_[b < a]] = True
        open_ = open_[a == b]
        if not len(open_):
            break
    return less


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _murmur(words: np.ndarray, at: np.ndarray, size: int, seeds: int) -> np.ndarray:
    """MurmurHash3 x86 32 of the `size` bytes from each place, under seeds 0, 1, ...; words are the four bytes from each place on."""
    out = [np.full(len(at), seed, np.uint32) for seed in range(seeds)]
    for j in range(0, size - size % 4, 4):
        k = _rotated(words[at + j] * C1, 15) * C2
        out = [_rotated(h ^ k, 13) * np.uint32(5) + ADD for h in out]
    if size % 4:
        tail = words[at + (size - size % 4)] & np.uint32((1 << 8 * (size % 4)) - 1)
        k = _rotated(tail * C1, 15) * C2
        out = [h ^ k for h in out]
    done = []
    for h in out:
        h = h ^ np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * F1
        h = (h ^ (h >> np.uint32(13))) * F2
        done.append(h ^ (h >> np.uint32(16)))
    return np.stack(done, axis=1).view(np.int32)


def bloom_rows(codes: np.ndarray, lengths: np.ndarray, k: int, h: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(the text of each window, its h Bloom rows) of the canonical windows, some at a time and in no order."""
    other = np.arange(128, dtype=np.uint32)
    other[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]
    turned = np.where(codes < 128, other[np.minimum(codes, 127)], codes)[::-1]
    both = np.concatenate([codes, turned])
    wide = 1 + (both >= 0x80).astype(np.int64) + (both >= 0x800) + (both >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(wide)])
    data = np.frombuffer(both.astype("<u4").tobytes().decode("utf-32-le").encode() + bytes(4), np.uint8).astype(np.uint32)
    words = data[:-3] | (data[1:-2] << np.uint32(8)) | (data[2:-1] << np.uint32(16)) | (data[3:] << np.uint32(24))
    of, first = starts(lengths, k)
    behind = len(codes) - k - first
    place = np.where(_smaller_behind(codes, turned, first, behind, k), len(codes) + behind, first)
    at = byte[place]
    sizes = byte[place + k] - at
    order = np.argsort(sizes, kind="stable") if len(sizes) and sizes.min() != sizes.max() else None
    if order is not None:
        of, at, sizes = of[order], at[order], sizes[order]
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
    for lo, hi in zip(edges, edges[1:]):
        for a in range(lo, hi, STRIP):
            b = min(a + STRIP, hi)
            yield of[a:b], np.remainder(_murmur(words, at[a:b], int(sizes[a]), h).astype(np.int64), m)
