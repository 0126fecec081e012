"""Batch-wide text kernels: words, hashes and sliding minima over Arrow buffers.

A batch of texts is one byte buffer with offsets, so every step below is a numpy
pass over the whole batch; there is no Python loop per document or word.
Null and empty texts are zero-length ranges and have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes (mod 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _nonalnum_table() -> np.ndarray:
    """True for the bytes that separate words of [0-9a-z] and non-ASCII (after lower-casing)."""
    table = np.zeros(256, bool)
    table[:0x80] = True
    table[0x30:0x3A] = False
    table[0x61:0x7B] = False
    return table


SPACE = _space_table()
NON_ALNUM = _nonalnum_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; the longest run so far is kept for the next batch."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.empty(max(1 << 16, 1 << max(n, 1).bit_length()), np.uint64)
        known[0] = 1
        done, step = 1, base
        while done < len(known):
            take = min(done, len(known) - done)
            np.multiply(known[:take], np.uint64(step), out=known[done : done + take])
            done += take
            step = step * step & MASK
        if len(known) <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); a bijection, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Random value of each byte, so that the polynomial hash does not see plain codes.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls become empty ranges."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte of every word, and the number of words before each text (n+1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    edge = np.zeros(len(raw), bool)
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    edge[inner] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    stops = inside
    stops[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 4 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span (position-free); `step` bytes at a time, so a very long text stays small."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) > step and ends[-1] - starts[0] > step and len(starts) > 1:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + step)))
            base = starts[i]
            out[i:j] = _span_hashes(raw[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
            i = j
        return out
    return _span_hashes(raw, starts, ends)


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODES[raw] * powers(BASE, len(raw)), out=total[1:])
    back = powers(BASE_INV, len(raw))
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values (len - k + 1 of them, ignoring text ends)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(BASE_INV, n))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n]) if span < w else out[:n]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """(first, last) text ranges of at most `limit` bytes, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last
