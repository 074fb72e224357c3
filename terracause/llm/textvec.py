"""Vectorised text kernels that run inside Spark tasks on Arrow string columns.

A batch of texts is one byte buffer with offsets. Words and shingles of the whole
batch are hashed with a handful of numpy passes, never word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multiplier of the polynomial hash and its inverse modulo 2**64.
ROOT = 0x9E3779B97F4A7C15
ROOT_INV = pow(ROOT, -1, 1 << 64)
#: Bytes of text that one numpy pass handles; bounds the memory of a task.
SLICE_BYTES = 4 << 20
#: Bytes of it that are hashed at once.
HASH_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(ROOT))
_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root**0 … root**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES + 4096)
        full = np.full(size, root, dtype=U64)
        full[0] = 1
        _POWERS[root] = have = np.multiply.accumulate(full)
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with at most ``most`` bytes each (one row may be longer)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, break_at: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-breaking bytes, and for each row the index of its first run (n + 1 entries)."""
    size = len(data)
    inside = np.zeros(size + 1, bool)
    inside[:size] = ~break_at[data]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    before = np.zeros(size + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, equal for equal bytes wherever they stand."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(ROOT, len(data)), out=sums[1:])
    back = powers(ROOT_INV, len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))


_STEP = mix64(np.arange(11, 75, dtype=U64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a row with 1 … k-1 words has one shingle, all of them."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = len(hashes)
    rows, out = [], []
    if n >= k:
        acc = np.zeros(n - k + 1, U64)
        for j in range(k):
            acc += hashes[j : n - k + 1 + j] * _STEP[j]
        whole = row[: n - k + 1] == row[k - 1 :]
        rows.append(row[: n - k + 1][whole])
        out.append(mix64(acc[whole]))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = np.full(len(short), 0, U64)
        for j in range(k - 1):
            has = count[short] > j
            acc[has] += hashes[first[short[has]] + j] * _STEP[j]
        rows.append(short)
        out.append(mix64(acc + count[short].astype(U64) * _STEP[k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    rows_, out_ = np.concatenate(rows), np.concatenate(out)
    if len(out) > 1:
        order = np.argsort(rows_, kind="stable")
        rows_, out_ = rows_[order], out_[order]
    return rows_, out_


def text_shingles(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): the row numbers (from a) and hashes of the word shingles of their whole texts.

    A-Z are lower-cased; words are the runs of bytes other than space and 0x09-0x0D.
    """
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        rows, hashes = [], []
        for c, d in slices(offsets[a : b + 1] - offsets[a], HASH_BYTES):
            c, d = a + c, a + d
            part = LOWER[data[offsets[c] : offsets[d]]]
            starts, ends, first = word_spans(part, offsets[c : d + 1] - offsets[c])
            found = shingle_hashes(span_hashes(part, starts, ends), first, k)
            rows.append(found[0] + (c - a))
            hashes.append(found[1])
        yield a, b, np.concatenate(rows), np.concatenate(hashes)
