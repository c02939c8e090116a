"""Arrow and numpy helpers for tasks that read whole texts in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit value.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sized_slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text is at most ``most`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
    pa.default_memory_pool().release_unused()  # workers live on, and what a batch took is for the next stage


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and each row's limits in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, limits, data = texts.buffers()
    if n == 0 or limits is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    ends = np.frombuffer(limits, dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one entry more).

    A word is a run of bytes other than space and 0x09 to 0x0D; rows end words.
    """
    solid = ~SPACE[data]
    first = solid.copy()
    last = solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = ends[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run, eight bytes at a time; another one for each ``seed``."""
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    held = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=held, strides=(1,))
    left = stops - starts
    out = scramble(left.astype(np.uint64) + _STEP + np.uint64(seed))
    out = (out ^ (eight[starts] & _FIRST[np.minimum(left, 8)])) * _STEP
    out ^= out >> np.uint64(32)
    go = np.flatnonzero(left > 8)
    at = 8
    while len(go):
        rest = left[go] - at
        part = (out[go] ^ (eight[starts[go] + at] & _FIRST[np.minimum(rest, 8)])) * _STEP
        out[go] = part ^ (part >> np.uint64(32))
        at += 8
        go = go[rest > 8]
    return scramble(out)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values; runs may straddle rows, the caller drops those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : n + j]
    return scramble(out)


def rolling(x: np.ndarray, w: int, best=np.minimum) -> np.ndarray:
    """Minimum (or another ``best``) of every run of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = best(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return best(out[:n], out[rest : rest + n]) if rest else out[:n]
