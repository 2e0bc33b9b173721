"""Words of whole texts and their 64-bit polynomial (Rabin-Karp) hashes, in NumPy.

A chunk is a run of documents whose UTF-8 bytes lie one after another in an Arrow
buffer. Words are found and hashed for the chunk at once; memory per byte of text
is two bytes, as hashing proceeds in slices of SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK, SLICE = 2 << 20, 1 << 19
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, x, U)])) for x in (_BASE, _INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` values: prefix sums of value * base**i, moved back to power 0."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.empty(n, U)
    step = 1 << 16
    for at in range(0, n, step):
        part = values[at : min(n, at + step) + width - 1]
        up, down = powers(step + width)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)])])
        k = len(part) - width + 1
        out[at : at + k] = (sums[width : width + k] - sums[:k]) * down[:k]
    return mix(out)


def words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, and for each document the index of its first word (one entry more at the end).

    bounds: byte offsets of the documents in data, from 0 to its length.
    """
    space = _SPACE[data]
    first = ~space
    if len(data):
        before = np.concatenate([np.ones(1, bool), space[:-1]])
        before[bounds[:-1][bounds[:-1] < len(data)]] = True
        first &= before
    starts = np.flatnonzero(first)
    last = ~space
    if len(data):
        after = np.concatenate([space[1:], np.ones(1, bool)])
        ends_at = bounds[1:] - 1
        after[ends_at[ends_at >= 0]] = True
        last &= after
    ends = np.flatnonzero(last) + 1
    of = np.searchsorted(starts, bounds)
    values = _LOWER if lower else _BYTE
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE)))
        part = data[starts[at] : ends[to - 1]]
        up, down = powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values[part] * up[: len(part)])])
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out), of


def chunks(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document bounds) of runs of rows of at most CHUNK bytes, or one row."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
