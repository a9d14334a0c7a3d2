"""Word and shingle hashes of many texts at once, straight from their UTF-8 bytes.

Texts lie end to end in one byte array. A word's hash is a sum over its bytes of a random 64-bit value per byte times a
power of an odd number for the place in the word, modulo 2^64, then mixed; a shingle's hash combines its words' hashes
with another odd multiplier per place. Distinct shingles share a 64-bit hash with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)


def byte_tables(is_word) -> tuple[np.ndarray, np.ndarray]:
    """Tables over byte values: whether a byte belongs to words, and its random value with A-Z as a-z (0 outside)."""
    word = np.array([bool(is_word(b)) for b in range(256)])
    lower = np.arange(256)
    lower[ord("A") : ord("Z") + 1] += 32
    return word, np.where(word, _BYTE_VALUES[lower], np.uint64(0))


#: Words as runs of anything but ASCII white space.
SPACED = byte_tables(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words as runs of ASCII letters and digits and of all other code points above 0x7F.
ALNUM = byte_tables(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words in them."""
    if len(data) > 2 * BLOCK_BYTES and len(offsets) == 2:
        parts = [_block_hashes(part, np.array([0, len(part)]), tables)[0] for part in long_pieces(data, tables[0])]
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    return _block_hashes(data, offsets, tables)


def _block_hashes(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = tables[0][data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _powers(len(data))
    sums = np.add.reduceat(tables[1][data] * up[: len(data)], starts)
    return mix64(sums * down[starts]), np.searchsorted(starts, offsets)


def long_pieces(data: np.ndarray, word: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text cut between words into pieces of about a block (a longer word stays whole)."""
    a = 0
    while a < len(data):
        b = min(a + BLOCK_BYTES, len(data))
        if b < len(data):
            outside = np.flatnonzero(~word[data[a:b]])
            if len(outside):
                b = a + int(outside[-1]) + 1
            else:
                while b < len(data) and word[data[b]]:
                    b += 1
        yield data[a:b]
        a = b


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; run ``k`` begins at word ``k``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _LENGTHS[size % 64], np.uint64)
    for k in range(size):
        out += words[k : k + n] * (_PLACES[k % 64] + np.uint64(2 * (k // 64)))
    return mix64(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text's words; with fewer words the whole sequence is the only one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(size, len(words))))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string or binary column: (first row, end row, bytes, offsets); null counts as empty.

    A block holds at most ``limit`` bytes, or one text where that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
