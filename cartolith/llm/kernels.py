"""Vectorised text kernels over Arrow string columns.

A word is a run of bytes other than ASCII white space (x20, x09-x0D); as those
bytes never occur inside a UTF-8 sequence this equals the character rule.
Hashes are 64-bit: a polynomial over the word's bytes, finished with a bijective
mixer, then combined over the words of a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = (1 << 19) - 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of rows of about most_bytes; a longer
    text is a run of its own. Null texts are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if n:
            off = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
            data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1)
                j = min(j, n)
                yield base + i, data[off[i] : off[j]], off[i : j + 1] - off[i]
                i = j
        base += n


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, off: np.ndarray, lower: bool, apart: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word and the number of the first word of each
    row, with one more entry at the end. Words never cross rows. The ASCII bytes
    of apart end words too."""
    if lower:
        data = lower_ascii(data)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13, *apart]] = True
    is_word = ~blank[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= is_word[inner]
    ends[inner - 1] |= is_word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # sum of byte * BASE^position, taken back to the word's start by the power of
    # the distance to the end of the run of rows
    p = _power(BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * p[:n], out=total[1:])
    h = (total[end] - total[start]) * p[n - start]
    # p[n - start] * BASE^start is the same power for all words of the run, but
    # not for other runs: divide it out
    h = h * _U(pow(BASE, -n, 1 << 64))
    h = mix(h ^ ((end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return start, end, h, np.searchsorted(start, off)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; window i begins at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _U(0x2545F4914F6CDD1D)
        out += h[i : i + n]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; a text of fewer words is one
    shingle, a text without words none."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        return shingles(h, n)[:1] ^ _U(n)
    return np.unique(shingles(h, k))
