"""Document statistics: one numeric row per text, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textkit as tk
from .rules import _of_row, _per_row, counts

NAMES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "symbol", "bang", "bar", "comma", "stop", "other_punct", "non_ascii",
    "space", "distinct_words", "next_equal", "repeat_windows", "dup_lines", "words_per_line", "log_lines", "capital_words", "short_words", "symbol_words", "entropy",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _mask(bytes(range(65, 91)))
_DIGIT = _mask(b"0123456789")
_SYMBOL = _mask(b"#*$%&|<>")
_PUNCT = _mask(bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "#*$%&|<>!.,"))


def table(piece: tk.Slice) -> np.ndarray:
    """rows x len(NAMES), finite; an empty text has zeros (and entropy 0)."""
    b, o, rows = piece.b, piece.o, piece.rows
    s, e, bounds = piece.words()
    n = np.diff(bounds)
    owner = _of_row(bounds)
    base = counts(piece)
    letters = (b & 0xC0) != 0x80
    chars = _per_row(letters, o)
    size = np.maximum(chars, 1)
    word_n = np.maximum(n, 1)
    length = piece.count(letters, s, e)
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    h = piece.hashes(s, e, True)
    keyed = h ^ tk.mix(owner.astype(np.uint64))
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(owner[first], minlength=rows)
    next_equal = np.zeros(len(s), bool)
    if len(s) > 1:
        next_equal[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    sums = {k: _per_row(m[b], o) for k, m in {"upper": _UPPER, "digit": _DIGIT, "symbol": _SYMBOL, "bang": _mask(b"!"), "bar": _mask(b"|"), "comma": _mask(b","), "stop": _mask(b"."), "other_punct": _PUNCT}.items()}
    lines = _per_row(b == 10, o) + 1
    in_words = piece.count(_SYMBOL[b], s, e) > 0
    kinds = np.zeros((rows, 16))
    row_of_byte = np.repeat(np.arange(rows), np.diff(o))
    np.add.at(kinds, (row_of_byte, b >> 4), 1) if len(b) < 4096 else kinds.__iadd__(np.bincount(row_of_byte * 16 + (b >> 4), minlength=rows * 16).reshape(rows, 16))
    share = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    cols = [
        np.log1p(chars), np.log1p(n), base["word_chars"] / word_n, longest, sums["upper"] / size, sums["digit"] / size, sums["symbol"] / size, sums["bang"] / word_n,
        sums["bar"] / word_n, sums["comma"] / word_n, sums["stop"] / word_n, sums["other_punct"] / word_n, _per_row(b >= 0xC0, o) / size, (chars - base["word_chars"]) / size,
        distinct / word_n, np.bincount(owner[next_equal], minlength=rows) / word_n, base["n_repeat_words"] / word_n, base["n_dup_lines"] / lines, n / lines, np.log1p(lines) * (chars > 0),
        np.bincount(owner[_UPPER[b[s]]], minlength=rows) / word_n, np.bincount(owner[length <= 2], minlength=rows) / word_n, np.bincount(owner[in_words], minlength=rows) / word_n, entropy,
    ]
    return np.stack(cols, axis=1).astype(np.float32)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text (column 0) to a list of floats `stats`; other columns follow."""
    for batch in batches:
        for piece in tk.row_slices(batch.column(0)):
            x = table(piece)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *(c.slice(piece.lo, piece.rows) for c in batch.columns[1:])], names=["stats", *batch.schema.names[1:]])


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of `rows` as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))
