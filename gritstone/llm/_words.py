"""Word scanning shared by the operators: whole Arrow batches at a time, in numpy, over UTF-8 bytes.

A batch is cut into chunks of rows of about ``CHUNK`` bytes (one row at least), so that memory stays
bounded whatever the batch holds. Every separator is an ASCII byte, so bytes and characters agree on
where words begin and end. Words, lines and windows are told apart by 64-bit hashes, which any two of them
share by chance alone; ``distinct_spans`` compares their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

#: Word bytes: all but space, tab, line feed, vertical tab, form feed and carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_STEP = np.random.default_rng(20240229).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.uint64(0x9E3779B97F4A7C15)
_SIZE = np.uint64(0xD1342543DE82EF95)
#: What is kept of the last eight bytes of a span, by how many of them belong to it.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Lanes:
    """Byte spans as lanes of eight bytes, the last one filled with zeros: span ``s`` has ``values[first[s]:first[s] + count[s]]``."""

    values: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash of each span: every lane is mixed with its number before it is added, so no power of a base repeats."""
        number = np.arange(len(self.values)) - np.repeat(self.first, self.count)
        mixed = mix(self.values ^ mix(number.astype(np.uint64) * _LANE + _SIZE))
        sums = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        return mix(sums[self.first + self.count] - sums[self.first] + self.size.astype(np.uint64) * _SIZE)

    def equal(self, a: np.ndarray, other: Lanes, b: np.ndarray) -> np.ndarray:
        """Whether span ``a[i]`` here has the bytes of ``other``'s span ``b[i]``: the bytes themselves, no hashes."""
        same = self.size[a] == other.size[b]
        at = np.flatnonzero(same & (self.count[a] > 0))
        x, y = a[at], b[at]
        one = self.values[self.first[x]] == other.values[other.first[y]]
        same[at[~one]] = False
        at = at[one & (self.count[x] > 1)]
        n = self.count[a[at]]
        done = np.cumsum(n)
        inside = np.arange(done[-1] if len(done) else 0) - np.repeat(done - n, n)
        wrong = self.values[np.repeat(self.first[a[at]], n) + inside] != other.values[np.repeat(other.first[b[at]], n) + inside]
        same[at] = per_row(wrong, np.concatenate([[0], done])) == 0
        return same


def lanes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Lanes:
    """The spans ``begin`` to ``end`` of ``data`` (bytes, or wider units that two spans are compared in)."""
    width = data.itemsize
    padded = np.zeros(len(data) * width + 8, np.uint8)
    padded[:-8] = np.ascontiguousarray(data).view(np.uint8)
    begin, end = np.asarray(begin, np.int64) * width, np.asarray(end, np.int64) * width
    size = end - begin
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    at = np.repeat(begin - first * 8, count) + np.arange(int(count.sum())) * 8
    values = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at]
    values &= _KEEP[np.minimum(np.repeat(end, count) - at, 8)]
    return Lanes(values, first, count, size)


@dataclass
class Chunk:
    """Rows ``row`` to ``row + n`` of a batch; word ``w`` is ``data[starts[w]:ends[w]]``, row ``r`` has words ``ptr[r]:ptr[r + 1]``."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each word, counted from the chunk's first."""
        return np.repeat(np.arange(self.n), self.n_words())

    def span_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans ``begin`` to ``end``."""
        return lanes(self.data, begin, end).hashes()

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def room(self) -> np.ndarray:
        """For each word, how many words its row has from it on."""
        return np.repeat(self.ptr[1:], self.n_words()) - np.arange(len(self.starts))

    def words(self, r: int) -> list[bytes]:
        raw = self.data.tobytes() if self.n == 1 else self.data[self.offsets[r] : self.offsets[r + 1]].tobytes()
        at = 0 if self.n == 1 else self.offsets[r]
        a, b = self.ptr[r], self.ptr[r + 1]
        return [raw[s:e] for s, e in zip((self.starts[a:b] - at).tolist(), (self.ends[a:b] - at).tolist(), strict=True)]


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ``n - 1`` entries are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _STEP[0]
    for k in range(1, n):
        out += words[k : k + m] * _STEP[k]
    return mix(out)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, raw = texts.buffers()
    if len(texts) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray = PLAIN, lower: bool = False) -> Iterator[Chunk]:
    """The column's words in order, in chunks of whole rows. kind: which bytes belong to words."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        yield scan(_LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row], kind, row)
        row = stop


def scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = PLAIN, row: int = 0) -> Chunk:
    inside = kind[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, end = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = inside[first]
    last[end] = inside[end]
    starts = np.flatnonzero(begin)
    return Chunk(row, data, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``bounds``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def cover(hits: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a span of ``length`` words from one of ``hits`` on."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + length, -1)
    return np.cumsum(edge[:-1]) > 0


def distinct_spans(spans: Lanes, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct span (within its group), in order, and each span's number among them.

    A hash table with open addressing into which all spans go at once: a free slot takes the first that asks,
    and who finds a slot taken compares group and bytes with its holder, then moves on. Equal spans ask for the same
    slots in step, so each finds the first of its kind. The table has twice as many slots as there are spans.
    """
    n = len(spans.size)
    h = spans.hashes()
    if group is not None:
        h = mix(h + group.astype(np.uint64) * _LANE)
    bits = max(4, (2 * n).bit_length())
    holder = np.full(1 << bits, -1, np.int64)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.arange(n)
    waiting = owner
    while len(waiting):
        at = slot[waiting]
        free = holder[at] < 0
        holder[at[free][::-1]] = waiting[free][::-1]
        found = holder[at]
        same = found == waiting
        like = np.flatnonzero(~same & (h[found] == h[waiting]))
        if group is not None:
            like = like[group[found[like]] == group[waiting[like]]]
        same[like] = spans.equal(waiting[like], spans, found[like])
        owner[waiting[same]] = found[same]
        waiting = waiting[~same]
        slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
    first = owner == np.arange(n)
    return np.flatnonzero(first), (np.cumsum(first) - 1)[owner]


def scan_rows(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The column's bytes in chunks of whole rows of about ``size``, and where rows begin in each."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
