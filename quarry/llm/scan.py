"""Vectorised scanning of text columns.

A block holds the UTF-8 bytes of several texts. Words, lines and their 64-bit hashes are found with
whole-array operations, so no Python object is made for a word. A hash is the polynomial
sum(R[b_j] * P^(j - start)) mod 2^64 of the bytes, mixed; equal byte strings have equal hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are scanned together; one longer text makes a block of its own.
BLOCK = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n + 1:
        up, down = np.full(n + 1, _P), np.full(n + 1, _PINV)
        up[0] = down[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POW["p"], _POW["q"]


class Block:
    """Several texts: ``buf`` their bytes, ``off`` where each begins (and the end of the last)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.off = off.astype(np.int64)
        self.n = len(off) - 1
        self._hash = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every word, and the number of words of each text."""
        return self.runs(WORD[self.buf])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the runs of true bytes, which never cross two texts; runs of each text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.off] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin, end, np.diff(np.searchsorted(begin, self.off))

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        up, down = _powers(len(self.buf))
        if self._hash is None:
            self._hash = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_RANDOM[self.buf] * up[: len(self.buf)], dtype=np.uint64, out=self._hash[1:])
        return mix((self._hash[end] - self._hash[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """True bytes of each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """Blocks of about ``size`` bytes with the row at which each begins. A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, Block(data[off[row] : off[to]], off[row : to + 1] - off[row], lower)
        row = to


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``counts`` of them to each text; a text's sum depends on its values only."""
    out = np.zeros(len(counts), np.float64 if values.dtype.kind == "f" else np.int64)
    if len(values):
        begin = (np.cumsum(counts) - counts)[counts > 0]
        out[counts > 0] = np.add.reduceat(values.astype(out.dtype, copy=False), begin)
    return out


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after the session is told to send texts to Python in batches of bytes, not of rows, so that long texts don't add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def release() -> None:
    """Give memory that a task no longer needs back to the machine; the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
