"""Words, shingles and their hashes over whole Arrow batches of UTF-8 text.

All functions work on the bytes of many texts at once: white space is ASCII, so cutting the bytes cuts the code points too.
Hashes are 64 bits wide, made from the bytes alone, and equal on every machine and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
# odd multipliers of the mixing steps
_M1, _M2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its n rows (n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~gap[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word; A-Z count as a-z if ``lower``."""
    out = np.zeros(len(start), dtype=_U)
    table = _BYTE[_LOWER] if lower else _BYTE
    length = end - start
    # column by column: words still running at byte k take one more step
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    state = np.full(len(start), _BASE, dtype=_U)
    alive = len(start)
    k = 0
    while True:
        alive = np.searchsorted(-left, -k, side="left") if k else len(start)
        if not alive:
            break
        if k == 64 and alive:  # the few very long words, each for itself
            for i in range(alive):
                h = state[i : i + 1].copy()
                rest = table[raw[at[i] + k : at[i] + left[i]]]
                power = np.cumprod(np.full(len(rest), _M1, dtype=_U))
                state[i] = mix(h + (mix(rest + power) * power).sum(dtype=_U))[0]
            break
        part = state[:alive]
        part ^= table[raw[at[:alive] + k]]
        part *= _M1
        part ^= part >> _U(29)
        k += 1
    state = mix(state + left.astype(_U))
    out[order] = state
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (one fewer than words by width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = np.full(n, _BASE, dtype=_U)
    for k in range(width):
        h ^= words[k : k + n]
        h *= _M2
        h ^= h >> _U(32)
    return mix(h)


def row_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of one text in ascending order; a shorter text is one shingle; none without words."""
    if not len(words):
        return words
    return np.unique(shingle_hashes(words, min(width, len(words))))
