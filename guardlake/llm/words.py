"""Words of whole Arrow batches as numpy arrays: positions, hashes, hashes of windows.

A batch of texts is one byte array with offsets; nothing loops over words in Python.
Hashes mix bits at every step and are nowhere linear in the words, so structured texts
(such as Thue-Morse sequences, on which all polynomials modulo 2**64 agree) do not collide.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd numbers, and the mask that keeps the first bytes of eight.
ODD, STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes that separate words: space and 09 to 0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair of hashes; the order counts."""
    return mix(a * ODD + mix(b + STEP))


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive hashes, by doubling. Halves are mixed, never summed,
    so no arrangement of the same values cancels out."""
    have = 1
    while have < length:
        by = min(have, length - have)
        h, have = joined(h[:-by], h[by:]), have + by
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: every eight bytes are mixed with their place and the
    seed; the results are summed and mixed with the length."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size, key = end - start, np.uint64((0x5851F42D4C957F2D + (2 * seed + 1) * int(ODD)) % 2**64)
    out = mix((eight[start] & MASKS[np.minimum(size, 8)]) ^ key)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        word = np.repeat(long, more)
        place = np.arange(len(word)) - np.repeat(first, more) + 1
        at = start[word] + 8 * place
        rest = mix((eight[at] & MASKS[np.minimum(end[word] - at, 8)]) ^ (key + place.astype(np.uint64) * STEP))
        out[long] += np.add.reduceat(rest, first)
    return mix(out + size.astype(np.uint64) * STEP)


def packed_hashes(packed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`word_hashes` of words of eight bytes at most, each given as a little-endian integer."""
    return mix(mix(packed ^ np.uint64((0x5851F42D4C957F2D + int(ODD)) % 2**64)) + size.astype(np.uint64) * STEP)


def trim() -> None:
    """Give freed memory back to the system: Python workers live on, and share it with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary column without nulls in slices of whole rows, of about ``limit`` bytes at most
    (or one row): first row, number of rows, bytes, offsets into them."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type != pa.large_binary() else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to - at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    trim()


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1

