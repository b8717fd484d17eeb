"""Words and word windows of many texts as 64-bit hashes, in numpy.

A word is a run of characters other than the six of ``\\x20\\x09-\\x0D``.  Hashes are
polynomials over the bytes (random values for each byte, modulo 2^64), mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20240501)
PLAIN = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = PLAIN.copy()
LOWER[65:91] = PLAIN[97:123]
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 2**64)
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 21

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and owners' word offsets of the words in texts that lie end to end in data."""
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
    """The hash of each word."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        at, to = starts[i], ends[j - 1]
        total = np.empty(to - at + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data[at:to]] * powers(P, to - at), out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * powers(P_INVERSE, to - at)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, whoever owns them: entry i covers words i to i+n-1."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(P, len(words)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(P_INVERSE, len(words))[: len(words) - n + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each piece have about ``most`` bytes; a longer text stands alone."""
    for b in batches:
        if not len(b):
            continue
        _, offsets = buffers(b.column(text))
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, i + 60_000)
            yield b.slice(i, j - i)
            i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, end to end."""
    if not len(counts) or not counts.sum():
        return np.empty(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(firsts - starts, counts)
