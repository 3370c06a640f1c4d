"""Words and their 64-bit hashes for whole Arrow batches of texts, by numpy over the UTF-8 bytes.

A word's hash is a polynomial over per-byte random values, taken from prefix sums, so a batch costs a few passes
over its bytes and no Python work per word. Texts are cut into blocks of at most `BLOCK_BYTES` (or one text).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Bytes that end a word of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


class Block:
    """Some texts of a batch: `rows` (their places in it), their bytes, and where each begins and ends."""

    def __init__(self, rows: range, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and for each text (one more at the end) the number of words before it."""
        inside = ~SPACE[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, stops: np.ndarray, lower: bool) -> np.ndarray:
        """The 64-bit hash of each stretch of bytes; with `lower`, A-Z count as a-z."""
        n = len(self.data)
        values = (_LOWER if lower else _BYTE)[self.data] * _power("up", _BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        raw = (sums[stops] - sums[starts]) * _power("down", _BASE_INVERSE, n + 1)[starts]
        return mix(raw + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def blocks(texts: pa.Array) -> Iterator[Block]:
    """A string column in blocks; a null counts as an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield Block(range(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def runs(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words, none across texts, and for each text (one more at the end) the number before it.

    counts: for each text the number of words before it, one more at the end. A text of fewer words, but not none,
    gives one hash, of all its words.
    """
    n = np.diff(counts)
    each = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    before = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(before[-1], np.uint64)
    if len(hashes) >= width:
        whole = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            whole = mix(whole * np.uint64(0x2545F4914F6CDD1D) + hashes[k : len(hashes) - width + 1 + k] + np.uint64(k + 1))
        starts = np.repeat(counts[:-1] - before[:-1], each) + np.arange(before[-1])
        full = np.repeat(n >= width, each)
        out[full] = whole[starts[full]]
    for i in np.flatnonzero((n > 0) & (n < width)):
        value = n[i : i + 1].astype(np.uint64)
        for k in range(counts[i], counts[i + 1]):
            value = mix(value * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + 1])
        out[before[i]] = value[0]
    return out, before


def give_back() -> None:
    """Let a worker that waits for its next task hold no memory of the last one: the JVM beside it may need it then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
