"""Words of many texts as 64-bit hashes, with numpy over Arrow's buffers.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums; it depends on the
bytes alone, so that every task and every run gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]

#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters and all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, _BLOCK), base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int = 1, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """`batch` in parts with some `size` bytes of text each, so that arrays over bytes stay small."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and last byte (inclusive) of each word."""
    inside = kind[raw]
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def word_hashes(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of each text in order, words in each text); A-Z are taken as a-z."""
    raw, offsets = buffers(column)
    starts, ends = word_spans(raw, offsets, kind)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK)))
        low, high = int(starts[i]), int(ends[j - 1]) + 1
        up, down = power(high - low)
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_LOWER[raw[low:high]] * up[: high - low], dtype=np.uint64, out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low + 1
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
        i = j
    counts = np.diff(np.searchsorted(starts, offsets))
    return out, counts.astype(np.int64)


def rolling(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position in words) of every run of k words inside a text."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h += hashes[j : n - k + 1 + j] * _STEP[j]
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[: n - k + 1]
    at = np.arange(n - k + 1)
    good = at + k <= ends[text]
    text = text[good]
    return mix(h[good]), text, at[good] - (ends - counts)[text]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles. A text of fewer words has one,
    of the whole sequence; a text without words has none."""
    hashes, counts = word_hashes(column, SPACED)
    h, text, _ = rolling(hashes, counts, k)
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    first = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            x = np.sort(h[bounds[i] : bounds[i + 1]])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            s = hashes[first[i] : first[i] + n]
            out.append(mix((s * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(n) << 3)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
