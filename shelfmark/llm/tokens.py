"""Words of whole texts as arrays: boundaries and 64-bit hashes, read from Arrow buffers without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ODD = 0x9E3779B97F4A7C15
SLICE = 1 << 21  # bytes of text worked on at once; a longer text is a slice by itself


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(kind: str) -> np.ndarray:
    """Which bytes make words: ``space`` has all but ASCII blanks, ``marks`` digits, a-z and non-ASCII."""
    ok = np.ones(256, bool)
    if kind == "space":
        ok[[0x20, *range(0x09, 0x0E)]] = False
    else:
        ok[:0x30] = ok[0x3A:0x61] = ok[0x7B:0x80] = False
    return ok


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Polynomial hashes of spans from prefix sums, modulo 2**64; tables grow as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(x):
            self.up, self.down = (powers(b, max(len(x) + 1, 2 * len(self.up))) for b in (self.base, self.inverse))
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[:len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


class Words:
    """Words of some rows. ``row``: row of each word; ``first``: index of each row's first word, and the total at the end."""

    def __init__(self, data, start, end, row, first, offsets):
        self.data, self.start, self.end, self.row, self.first, self.offsets = data, start, end, row, first, offsets

    def text(self, i: int, j: int) -> list[bytes]:
        """Words i to j, as bytes."""
        raw = self.data.tobytes() if not isinstance(self.data, bytes) else self.data
        return [raw[s:e] for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist())]


class Reader:
    def __init__(self, kind: str = "space", lower: bool = False, seed: int = 1):
        self.ok = byte_class(kind)
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[0x41:0x5B] += 0x20
        self.lower = lower
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD) + np.uint64(seed))
        self.bytes_ = Rolling(0x9DDFEA08EB382D69 + 2 * seed)
        self.words_ = Rolling(0xC2B2AE3D27D4EB4F + 2 * seed)

    def slices(self, column: pa.Array, rows: int = 1 << 30) -> Iterator[tuple[int, int, Words]]:
        """(first row, last row, words) for runs of up to ``rows`` rows that hold about ``SLICE`` bytes."""
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        if n == 0:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        held = column.buffers()[2]
        every = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            to = min(to, at + rows)
            yield at, to, self.words(every[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            at = to

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if self.lower:
            data = self.fold[data]
        n, rows = len(data), len(offsets) - 1
        ok = self.ok[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = ok.copy(), ok.copy()
        begins[1:] &= ~ok[:-1] | edge[1:n]
        ends[:-1] &= ~ok[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, offsets)
        return Words(data, start, end, np.repeat(np.arange(rows), np.diff(first)), first, offsets)

    def hashes(self, w: Words) -> np.ndarray:
        """A 64-bit hash of each word."""
        p = self.bytes_.prefix(self.table[w.data])
        return mixed(self.bytes_.spans(p, w.start, w.end) + (w.end - w.start).astype(np.uint64))

    def windows(self, h: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """A hash of every k words in a row, wherever they start; those across rows are for the caller to leave out."""
        if len(h) < k:
            return np.zeros(0, np.uint64)
        p = self.words_.prefix(h) if prefix is None else prefix
        i = np.arange(len(h) - k + 1)
        return mixed(self.words_.spans(p, i, i + k))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
