"""Vectorised words, word hashes and window hashes over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D of the UTF-8 text. A word's hash is a
polynomial over randomised byte values modulo 2**64, a window's hash one over mixed word
hashes; both are read off prefix sums, so that the cost is a few nanoseconds a byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[0x41:0x5B] = BYTE[0x61:0x7B]
P = int(_random.integers(1, 2**62)) * 4 + 1
Q = int(_random.integers(1, 2**62)) * 4 + 1

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a table of up to 1 M entries is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, (1 << 19) + 1)
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: ``start``, ``end`` (byte positions in ``data``), ``first``
    (texts + 1 entries: the number of words before each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, table: np.ndarray = BYTE) -> np.ndarray:
        return self.spans(self.start, self.end, table)

    def spans(self, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
        """Hashes of the bytes of any spans."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * powers(P, n), out=total[1:])
        back = powers(pow(P, -1, 2**64), n + 1)
        return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def stretches(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of any runs of consecutive entries."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(Q, n), out=total[1:])
    return mix((total[stop] - total[start]) * powers(pow(Q, -1, 2**64), n + 1)[start] + (stop - start).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries; entry i covers i .. i + k - 1."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(Q, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(Q, -1, 2**64), n - k + 1))


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Cuts a batch into slices of about ``limit`` bytes of text (a longer text stands alone);
    yields (slice, Words, valid) with null texts as empty ones."""
    texts = batch.column(column)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    if not valid.all():
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), Words(data[at[i] : at[j]], at[i : j + 1] - at[i]), valid[i:j]
        i = j
