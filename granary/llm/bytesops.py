"""Vectorised work on the UTF-8 bytes of whole Arrow batches of texts.

All hashes here are 64-bit and the same in every process; none depends on PYTHONHASHSEED.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Up to so many bytes a word is hashed eight bytes at a time, beyond by BLAKE2.
STEPWISE = 128
_KEY = b"granary words"
#: The low bytes of a word of eight, by how many of them count.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def trimmed(run: Callable) -> Callable:
    """A function of a task's batches that, when it ends, gives the memory it has freed back to the system: a
    worker lives on, and others on its machine need that memory. Where the C library cannot, nothing is done."""

    def out(batches):
        yield from run(batches)
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give_back:
            give_back(0)

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8) if where else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row number of each run of non-separator bytes; runs end where a row ends."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, its length included. Each step is a bijection of what went before and
    of the next eight bytes, so spans of eight bytes or fewer of one length never collide, and longer ones do
    as random numbers do, whatever their structure."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15))
    eight = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    own = np.flatnonzero(size <= STEPWISE)
    at, left = starts[own], size[own]
    while len(own):
        word = eight[at].view("<u8").ravel() & _LOW[np.minimum(left, 8)]
        out[own] = mix((out[own] ^ word) * U64(0xD6E8FEB86659FD93))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > STEPWISE).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=_KEY).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles, A-Z lower-cased.

    A row of fewer words has its whole word sequence as one shingle; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, row = words(low, offsets)
    value = span_hashes(low, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    grams = value.copy()
    for k in range(1, min(width, len(grams))):
        grams[: len(grams) - k] = mix(grams[: len(grams) - k] * U64(0xD6E8FEB86659FD93) + value[k:])
    out = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            whole = value[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix(whole * U64(0xD6E8FEB86659FD93) + value[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out
