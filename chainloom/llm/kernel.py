"""Vectorised word kernels over Arrow string buffers.

A word is a run of bytes outside {0x20, 0x09-0x0D}. Texts are worked in blocks of whole texts with
about BLOCK bytes each, so memory follows the block (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_ROOT = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse. Those of a block are kept; a longer text has its own."""
    made = _POWERS
    if not made or len(made[0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate(([U(1)], np.full(size - 1, U(b))))) for b in (_BASE, _ROOT)]
        if size == BLOCK + 1:
            _POWERS[:] = made
    return made[0], made[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@dataclass
class Words:
    """Words of a block of texts: text (index in the block), first byte, end byte, hash."""

    data: np.ndarray  # the block's bytes
    at: np.ndarray  # offsets of its texts, from 0
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """n + 1 offsets of the texts' words."""
        return np.searchsorted(self.text, np.arange(len(self.at)))


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    at = at - at[0]
    data = LOWER[data] if lower else data
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))
    text = np.searchsorted(at, start, "right") - 1
    return Words(data, at, text, start, end, h)


def text_words(column: pa.Array, lower: bool = True, size: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """Blocks of a string column: first text, end text, their words."""
    data, at = buffers(column)
    for i, j in blocks(at, size):
        yield i, j, words(data[at[i] : at[j]], at[i : j + 1], lower)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, U(k) * U(0x9FB21C651E98DF25))
        for j in range(k):
            out += h[j : j + n] * U(pow(_BASE, 2 * j + 3, 1 << 64))
        return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every k-word shingle; a text of fewer words (one at least) has its whole
    sequence as one shingle."""
    h = grams(w.hash, k)
    at = w.text[: len(h)]
    keep = at == w.text[k - 1 :] if len(h) else np.zeros(0, bool)
    h, at = h[keep], at[keep]
    bounds = w.bounds()
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    if len(few):
        own = np.array([grams(w.hash[bounds[i] : bounds[i + 1]], int(bounds[i + 1] - bounds[i]))[0] for i in few], np.uint64)
        h, at = np.concatenate((h, own)), np.concatenate((at, few))
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at
