"""Vectorised word and shingle hashing of Arrow string columns.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. A word's
hash depends on its bytes alone; it is 64 bits wide and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 20

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(salt << 32)) * _BASE)


_byte = seeds(256, 7)
_byte_lower = _byte.copy()
_byte_lower[65:91] = _byte[97:123]


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about BLOCK bytes; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        chunk = chunk.cast(pa.large_binary()) if chunk.null_count == 0 else chunk.cast(pa.large_binary()).fill_null(b"")
        _, offs, data = chunk.buffers()
        offs = np.frombuffer(offs, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, "right")) - 1)
            yield row + i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
        row += len(chunk)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and for each row where its words start among them."""
    n = data.size
    rows = offs.size - 1
    if n == 0:
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    word = ~_space[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    start[first] = word[first]
    at = np.flatnonzero(word)
    if at.size == 0:
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    begins = np.flatnonzero(start[at])
    lens = np.diff(np.append(begins, at.size))
    rel = np.arange(at.size) - np.repeat(begins, lens)
    powers = np.full(int(lens.max()), _BASE, _U)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(powers)
        h = np.add.reduceat((_byte_lower if lower else _byte)[data[at]] * powers[rel], begins)
        h = mix(h + lens.astype(_U) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(at[begins], offs).astype(np.int64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k hashes; len(h) - k + 1 of them."""
    m = h.size - k + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(m, _U(k), _U)
        for i in range(k):
            out = (out ^ h[i : i + m]) * _BASE
            out ^= out >> _U(29)
        return mix(out)


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; shorter rows have their whole sequence as one."""
    for _, data, offs in blocks(column):
        h, at = word_hashes(data, offs, lower)
        for i in range(offs.size - 1):
            own = h[at[i] : at[i + 1]]
            if own.size == 0:
                yield own
            elif own.size < k:
                yield rolling(own, own.size)
            else:
                s = np.sort(rolling(own, k))
                yield s[np.append(True, s[1:] != s[:-1])] if s.size > 1 else s
