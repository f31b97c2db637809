"""Words of many texts at once as numpy arrays: boundaries and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE, _FULL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Bytes of a word from which on it is hashed alone.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishes a hash so that all its bits count (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_bytes each; a longer text has a range of its own. Bounds the memory of the arrays."""
    _, starts = text_bytes(column)
    n, begin = len(column), 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + most_bytes, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def parts(batch: pa.RecordBatch, at: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most_bytes each in column `at`, so that what Python makes of them at once is bounded; one without rows stays as it is."""
    if not len(batch):
        yield batch
    for a, b in slices(batch.column(at).cast(pa.large_binary()), most_bytes):
        yield batch.slice(a, b - a)


#: Bytes of words: other than blanks; ASCII letters and digits and all other bytes of UTF-8; letters alone.
FILLED = ~np.isin(np.arange(256), [32, *range(9, 14)])
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def split_words(raw: np.ndarray, starts: np.ndarray, solid_bytes: np.ndarray = FILLED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, by default `[^\\x20\\x09-\\x0D]+`, else runs of solid_bytes: (lower-cased bytes (A-Z only), begins, ends, index of each text's first word, one more at the end)."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    solid = solid_bytes[low]
    n = len(low)
    if not n:
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, begins, ends, np.searchsorted(begins, starts)


def hashed(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes: eight bytes after the other are mixed in, so that no structure of a word survives."""
    n = len(begins)
    if not n:
        return np.zeros(0, np.uint64)
    sizes = ends - begins
    eight = np.ndarray(len(low) + 1, "<u8", np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))
    out = mixed(sizes.astype(np.uint64) * np.uint64(_BASE))
    rows = np.flatnonzero((sizes > 0) & (sizes < LONG))
    at, left = begins[rows], sizes[rows]
    while len(rows):
        block = eight[at] & (np.uint64(_FULL) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        out[rows] = mixed((out[rows] ^ block) * np.uint64(_BASE) + np.uint64(0xD6E8FEB86659FD93))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes >= LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(low[begins[k] : ends[k]].tobytes())
    return out


def hashed_points(cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of code points."""
    return hashed(np.ascontiguousarray(cp, "<u4").view(np.uint8), 4 * begins, 4 * ends)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct hashes of width-word shingles of each text, ascending; fewer words make one shingle, none make none."""
    n = len(words)
    out = []
    if n >= width:
        rolled = words[: n - width + 1].copy()
        for k in range(1, width):
            rolled = mixed(rolled * np.uint64(_BASE) + words[k : n - width + 1 + k])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mixed(whole * np.uint64(_BASE) + words[k])
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
