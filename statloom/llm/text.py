"""Vectorised work on UTF-8 text: Arrow buffers as numpy arrays, word spans, word and shingle hashes.

All functions take whole texts; ``pieces`` only bounds how many documents are worked on at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

# Characters that part words.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges (i, j) of documents with about ``limit`` bytes together, one document at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_codes(fold: bool = True) -> np.ndarray:
    """A 64-bit code for every byte value; with ``fold`` A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(r**i, r**-i) modulo 2**64 for i in 0..n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_MULT, _INV):
            out = np.full(size, base, _U)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of data[i:j], times r**i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; equal bytes give equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, np.bool_)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each document (len(docs) + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[offs] = True
    before = np.zeros(len(data), np.bool_)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    after = np.zeros(len(data), np.bool_)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, table: np.ndarray, codes: np.ndarray):
    """64-bit hashes of the words in order and the first word's index of each document."""
    starts, ends, first = word_spans(data, offs, table)
    return span_hash(prefix_hash(data, codes), starts, ends), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and offsets into them.

    A document of fewer than ``size`` words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    out: list[np.ndarray] = []
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), _U)
    for k in range(size):
        rolled = rolled * _U(0xC2B2AE3D27D4EB4F) + words[k : n - size + 1 + k] if n >= size else rolled
    rolled = mix(rolled) if len(rolled) else rolled
    lens = np.zeros(len(counts) + 1, np.int64)
    for d in range(len(counts)):
        c, f = counts[d], first[d]
        if c >= size:
            s = np.sort(rolled[f : f + c - size + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            h = int(c)
            for x in words[f : f + c]:
                h = (h * 0xC2B2AE3D27D4EB4F + int(x)) & _MASK
            s = mix(np.array([h], _U) ^ _U(0x5851F42D4C957F2D))
        else:
            s = rolled[:0]
        out.append(s)
        lens[d + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.cumsum(lens)
