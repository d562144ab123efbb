"""Vectorised word splitting and hashing over UTF-8 buffers (numpy, inside tasks).

All functions work on one buffer of bytes that holds several texts, with the
texts' offsets, so no Python code runs per word. ``blocks`` cuts a long array
of texts into buffers of bounded size; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the polynomial hashes and of the mixer.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Arrays of 64-bit numbers for each byte of a block, and the tables of powers that a worker keeps, bound a task's memory.
BLOCK_BYTES = 1 << 18

#: Separators of raw words: the bytes 0x20 and 0x09 to 0x0D.
RAW = np.ones(256, dtype=bool)
RAW[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Normal words: ASCII letters and digits and every byte of a non-ASCII character.
NORMAL = np.zeros(256, dtype=bool)
NORMAL[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    NORMAL[_c] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i below n (kept per process)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an array of texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    _, offs, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, end text, bytes, offsets)`` of runs of whole texts of about ``limit`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (n + 1). Words never span texts."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = table[data]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(word)]] = False
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    up, down = powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of ``n`` words that lies in one text, and the window's 64-bit hash."""
    counts = np.diff(bounds)
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(total)
    first = at[np.repeat(bounds[1:], counts) - at >= n]
    return first, hash_windows(hashes, first, n, base)


def hash_windows(hashes: np.ndarray, first: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """64-bit hash of the ``n`` words from each of ``first``."""
    up, down = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mix((sums[first + n] - sums[first]) * down[first])
