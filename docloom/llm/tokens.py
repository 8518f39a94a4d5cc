"""Words of Arrow string columns as 64-bit hashes, computed on the raw UTF-8 bytes with numpy.

Words are the runs of 0-9, a-z (A-Z lower-cased) and bytes from 0x80, as in common.code_words.
A word's hash is a polynomial of its bytes, read off one running sum per chunk and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer document makes a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32

_powers: list[np.ndarray] = []


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes of words, A-Z lower-cased; 0 for all others."""
    return _LOWER[data]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most size bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows of bytes, and n + 1 offsets of the rows' words."""
    x = _LOWER[data]
    n = len(x)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = x != 0
    edge = np.zeros(n + 1, bool)  # where a row begins
    edge[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(n)
    total = np.cumsum(x * up[:n], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else np.zeros(0, np.uint64)
    hashes = mix((total[ends] - before) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)


def _long_row(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long row, a chunk at a time; a chunk ends between words, however long they are."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            gaps = np.flatnonzero(_LOWER[data[end : end + CHUNK]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + CHUNK)
        out.append(_hashed(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def hash_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, the words' hashes, and n + 1 offsets of the rows' words."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets, CHUNK):
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > 2 * CHUNK:
            hashes = _long_row(part)
            yield i, j, hashes, np.array([0, len(hashes)])
        else:
            yield i, j, *_hashed(part, offsets[i : j + 1] - offsets[i])
