"""Hashes of character windows, whole Arrow batches at a time in numpy.

A text is taken as its UTF-8 bytes; a window of n characters is the bytes between two beginnings of characters.
Windows are told apart by 64-bit hashes. Batches are worked on in slices of rows of about 1 MB (one row at least).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 20
_BASE = 0xC4CEB9FE1A85EC53


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that mixes all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Characters:
    """The characters of a string column: where each begins, and its row."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        _, where, raw = texts.buffers()
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        self.begins = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self.ptr = np.searchsorted(self.begins, offsets)  # the first character of each row, and the number of all
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.ptr))
        p, self.unpower = _powers(1 << max(21, len(self.data).bit_length()))
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_byte_values()[self.data] * p[: len(self.data)], out=self.sums[1:])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The characters at which windows of ``n`` begin, and their hashes."""
        at = np.flatnonzero(np.repeat(self.ptr[1:], np.diff(self.ptr)) - np.arange(len(self.row)) >= n)
        first, last = self.begins[at], self.begins[at + n]
        return at, spread((self.sums[last] - self.sums[first]) * self.unpower[first] + (last - first).astype(np.uint64))


def over_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, Characters], pa.RecordBatch], schema: str, text: int) -> DataFrame:
    """Runs ``fn`` over slices of the batches of ``df`` and the characters of their ``text``-th column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < b.num_rows:
                done = int(size[row - 1]) if row else 0
                stop = max(row + 1, int(np.searchsorted(size, done + SLICE, "right")))
                part = b.slice(row, stop - row)
                yield fn(part, Characters(part.column(text)))
                row = stop

    return df.mapInArrow(run, schema)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the distinct pairs of ``a`` (small numbers, ascending) and ``b`` (64-bit hashes) stand."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order[new]
