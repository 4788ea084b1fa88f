"""Vectorised text kernels: Arrow strings to code points, words, word hashes and n-gram hashes in numpy.

All kernels work on a slice of rows at a time; slices() bounds the bytes of one, so that memory stays small
for any length of text. Whole texts are processed, never prefixes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOW = 0x3000
SLICE_BYTES = 1 << 19
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def is_word_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


_WORD_LOW = np.array([is_word_char(chr(i)) for i in range(_LOW)])


def word_mask(cp: np.ndarray) -> np.ndarray:
    """Which code points are letters, numbers or the underscore."""
    mask = _WORD_LOW[np.minimum(cp, _LOW - 1)]
    high = np.flatnonzero(cp >= _LOW)
    if len(high):
        seen, back = np.unique(cp[high], return_inverse=True)
        mask[high] = np.array([is_word_char(chr(i)) for i in seen])[back]
    return mask


def strings(column: pa.Array) -> pa.Array:
    """The column as valid UTF-8 strings without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def lowered(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        rows = [x.decode("utf-8", "replace").lower() for x in column.cast(pa.large_binary()).to_pylist()]
        return pa.array(rows, pa.large_string())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about `limit` bytes; a longer text makes a run of its own."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, column.slice(at, end - at)
        at = end


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, where each row starts, with the end as the last)."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = data[offsets[0] : offsets[-1]].to_pybytes() if data is not None else b""
    try:
        text = raw.decode("utf-8")
        lens = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    except (UnicodeDecodeError, pa.ArrowInvalid):
        rows = [x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]
        text, lens = "".join(rows), np.array([len(x) for x in rows])
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), starts


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, the number of words before each row, with the total as the last).

    A word is a longest run of word characters; it never crosses rows.
    """
    mask = word_mask(cp)
    if not mask.any():
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    first = np.zeros(len(cp) + 1, bool)
    first[starts] = True
    begin = mask & first[:-1]
    begin[1:] |= mask[1:] & ~mask[:-1]
    chars = cp[mask].astype(np.uint64)
    at = np.flatnonzero(begin[mask])
    lens = np.diff(at, append=len(chars))
    pos = np.arange(len(chars)) - np.repeat(at, lens)
    values = mix(chars + GOLDEN) * _powers(int(lens.max()))[pos]
    hashes = mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * GOLDEN)
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(begin, out=before[1:])
    return hashes, before[starts]


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, GOLDEN | np.uint64(1))]))
    return _POWERS


def ngram_hashes(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word n-gram, the number of n-grams before each row).

    A row of 1 to n-1 words has a single n-gram of all its words; a row without words has none.
    """
    counts = np.diff(before)
    grams = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    starts = np.zeros(len(before), np.int64)
    np.cumsum(grams, out=starts[1:])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.uint64), starts
    at = np.arange(total) + np.repeat(before[:-1] - starts[:-1], grams)
    size = np.repeat(np.minimum(counts, n), grams)
    out = np.zeros(total, np.uint64)
    last = len(hashes) - 1
    for k in range(n):
        step = mix(out * GOLDEN + hashes[np.minimum(at + k, last)])
        out = step if k == 0 else np.where(k < size, step, out)
    return out, starts
