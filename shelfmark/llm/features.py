"""Hashed counts of byte n-grams and a few shape figures of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shelfmark.llm.tokens import Reader

BUCKETS = 4096
SHAPE = 8


def letters_only() -> np.ndarray:
    """a-z from either case, bytes of other scripts, and a blank for all else."""
    fold = np.full(256, 0x20, np.uint8)
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    fold[0x80:] = np.arange(0x80, 0x100)
    return fold


def gram_counts(data: np.ndarray, row: np.ndarray, rows: int, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of 2- and 3-byte grams by hash bucket, a row each; grams don't cross rows."""
    out = np.zeros(rows * buckets, np.float32)
    code = data.astype(np.uint32)
    for n in (2, 3):
        if len(code) < n:
            break
        h = code[:len(code) - n + 1] * np.uint32(n)
        for k in range(1, n):
            h = (h << np.uint32(8)) + code[k:len(code) - n + 1 + k]
        at = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)
        ok = row[:len(h)] == row[n - 1:]
        out += np.bincount(row[:len(h)][ok] * buckets + at[ok], minlength=rows * buckets).astype(np.float32)
    return out.reshape(rows, buckets)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def shape_figures(w, h: np.ndarray, data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Shares of capitals, marks and letters; share of different words, of words equal to the one before; mean word length; size."""
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    share = lambda ok: np.bincount(row[ok], minlength=rows) / n
    words = np.diff(w.first)
    order = np.lexsort((h, w.row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    k = np.maximum(words, 1)
    caps, low = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A) | (data >= 0x80)
    marks = (data > 0x20) & ~caps & ~low & ~((data >= 0x30) & (data <= 0x39))
    return np.stack([share(caps), share(marks), share(low), np.bincount(w.row[order][new], minlength=rows) / k, np.bincount(w.row[again], minlength=rows) / k,
                     np.log1p(np.bincount(w.row, w.end - w.start, rows) / k) / 3, np.log1p(words) / 10, (words == 0).astype(float)], 1).astype(np.float32)


def text_features(column: pa.Array, letters: bool, reader: Reader) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) of whole texts: unit square-rooted gram counts, and shape figures unless ``letters``."""
    fold = letters_only()
    for at, to, w in reader.slices(column, 512):
        rows = to - at
        bounds = w.offsets
        row = np.repeat(np.arange(rows), np.diff(bounds))
        data = fold[w.data] if letters else w.data
        # a very long text is counted in pieces that overlap by what a gram needs
        x = gram_counts(data, row, rows) if rows > 1 or len(data) <= 1 << 23 else sum(
            gram_counts(data[i:i + (1 << 23) + 2], row[i:i + (1 << 23) + 2], rows) for i in range(0, len(data), 1 << 23))
        x = unit_rows(np.sqrt(x))
        yield at, x if letters else np.hstack([x, shape_figures(w, reader.hashes(w), w.data, row, rows)])
