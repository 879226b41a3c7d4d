"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch.

A word is a run of bytes other than blank and tab to carriage return; all of these are single bytes in UTF-8, so
bytes and characters agree. The hash of a word is a polynomial over random per-byte values modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, made once per process and made longer only for a longer word."""
    if not _powers or len(_powers[0]) < size:
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64)
            for x in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    out = np.array(x, np.uint64)
    flat = out.reshape(-1)
    for at in range(0, len(flat), 1 << 15):  # pieces that stay in the cache
        part = flat[at:at + (1 << 15)]
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(27)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more than texts). A null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the bounds of each text in the list of words."""
    blank = space[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    last = ~blank
    last[:-1] &= blank[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] |= ~blank[edges]
    last[edges - 1] |= ~blank[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given pieces of bytes, which follow one another; works block by block."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        lo, hi = starts[at], ends[to - 1]
        power, inverse = _power_tables(max(2 * BLOCK, int(hi - lo)))
        sums = np.cumsum(_BYTE_VALUES[raw[lo:hi]] * power[:hi - lo], dtype=np.uint64)
        s, e = starts[at:to] - lo, ends[at:to] - lo
        before = np.where(s > 0, sums[s - 1], np.uint64(0))
        out[at:to] = mix((sums[e - 1] - before) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def hash_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in text order, and the bounds of each text in them."""
    raw, offsets = text_bytes(texts)
    if lower:
        raw = _LOWER[raw]
    starts, ends, bounds = word_spans(raw, offsets)
    return hash_spans(raw, starts, ends), bounds


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values from each bound to the next."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def batches_of(arrays: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded size."""
    for batch in arrays:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
