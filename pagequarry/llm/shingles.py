"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case; in
UTF-8 those bytes stand only for themselves, so texts needn't be decoded.  A word's
hash is a sum over its bytes of a random odd number of the byte times a power of its
place; a shingle's mixes the hashes of its words.  Hashes are the same on every
machine.  64 bits for some 10^8 shingles meet by chance with odds under 1 in 1,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_slices

WORDS = 5
_SEGMENT = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


with np.errstate(over="ignore"):
    #: A fixed random number for each byte; capitals have that of their small letter; 0 marks white space.
    _BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 64), _STEP, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a run of bytes."""
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    long = end - start
    # Bytes of the words only, one after the other, with their places in the word.
    first = np.cumsum(long) - long
    total = int(long.sum())
    place = np.arange(total) - np.repeat(first, long)
    value = _BYTE[data[solid]] * _power_table(int(long.max()))[place]
    return _mix(np.add.reduceat(value, first) ^ (long.astype(np.uint64) << np.uint64(48))), start


def _segments(data: np.ndarray):
    """Pieces of some megabytes that end at white space, with their offsets."""
    at = 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        if end < len(data):
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        yield at, data[at:end]
        at = end


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and for each row where its own begin (one more entry than rows)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if column.null_count:
        column = column.fill_null("")
        return word_hashes(column)
    with np.errstate(over="ignore"):
        hashes, starts = [], []
        joined, gaps = data, np.zeros(n + 1, dtype=np.int64)
        if n > 1 and len(data):  # row ends must part words: one space before each row's bytes
            gaps = np.arange(n + 1)
            joined = np.full(len(data) + n, 0x20, dtype=np.uint8)
            joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        for at, piece in _segments(joined):
            h, s = _words_of(piece)
            hashes.append(h)
            starts.append(s + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    return h, np.searchsorted(s, offsets + gaps)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of fewer words the whole is one; of none, none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size), dtype=np.uint64)
        for k in range(size):
            out = (out ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return _mix(out)


def shingle_sets(column: pa.Array, size: int = WORDS):
    """For each row its sorted distinct shingle hashes; works through the column in slices of some megabytes."""
    for part in text_slices(column, _SEGMENT):
        words, begins = word_hashes(part)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], size))
