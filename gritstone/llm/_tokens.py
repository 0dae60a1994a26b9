"""Token ids of whole batches with a public byte-level BPE tokenizer.

A byte-level BPE never merges across the pieces that its pattern cuts a text into, so each distinct piece
is encoded once and remembered. numpy cuts the texts: on code points, by the classes letter, number,
white space and other, as the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

does. The memory of pieces is bounded and only saves time: what is remembered is used for the same bytes alone.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from gritstone.llm._words import Lanes, buffers, lanes, per_row

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_classes: list[np.ndarray] = []
REMEMBERED = 1_000_000  # some 90 MB
CHUNK = 1 << 20  # bytes; a token takes more room than a byte of text


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a file, which a worker keeps from task to task."""
    return Encoder(path)


def char_classes() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def piece_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in rows of code points; a piece ends where the next or the row does."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    row_start = row_start[:n]
    start = row_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something else: its last character is a piece of its own or, a blank, joins what follows
    turn = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~row_start[1:]) + 1
    start[turn - 1] = True
    start[turn[cp[turn - 1] == 0x20]] = False
    # contractions: an apostrophe that begins a piece takes the letters listed with it
    at = np.flatnonzero((cp == 0x27) & start)
    if len(at):
        end = offsets[np.searchsorted(offsets, at, "right")]
        c1 = np.where(at + 1 < end, cp[np.minimum(at + 1, n - 1)], 0)
        c2 = np.where(at + 2 < end, cp[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for hit, size in ((one, 2), (two, 3)):
            a, e = at[hit], end[hit]
            start[a + 1] = False
            rest = a + size
            rest = rest[(rest < e)]
            start[rest] |= kind[rest] == LETTER
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts with the tokenizer file at ``path``; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: a byte-level vocabulary has one character for each.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the pieces
        self.slot = np.zeros(0, np.int64)  # their numbers
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)  # where each piece's ids begin
        none = np.zeros(0, np.int64)
        self.pieces = Lanes(np.zeros(0, np.uint64), none, none, none)  # the pieces' own bytes

    def _learn(self, pieces: list[str]) -> None:
        """Appends the ids of ``pieces``, encoded together; the bytes of tokens tell where each piece ends."""
        encoded = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(x.encode()) for x in pieces])
        size = np.searchsorted(np.cumsum(self.width[encoded]), ends) + 1
        used, more = int(self.first[-1]), len(encoded)
        while used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[used : used + more] = encoded
        self.first = np.concatenate([self.first, used + size])

    def _add(self, text: str, starts: np.ndarray, ends: np.ndarray, spans: Lanes, new: np.ndarray) -> np.ndarray:
        """Learns the pieces ``new`` and gives them numbers."""
        numbers = len(self.first) - 1 + np.arange(len(new))
        self._learn([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        count, old = spans.count[new], self.pieces
        first = np.cumsum(count) - count
        values = spans.values[np.repeat(spans.first[new] - first, count) + np.arange(int(count.sum()))]
        merge = lambda x, y: np.concatenate([x, y])
        self.pieces = Lanes(merge(old.values, values), merge(old.first, first + len(old.values)), merge(old.count, count), merge(old.size, spans.size[new]))
        return numbers

    def _numbers(self, text: str, spans: Lanes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the pieces ``text[starts:ends]``. A remembered one counts only where its bytes are those of the piece."""
        keys, where, inverse = np.unique(spans.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            numbers = self._add(text, starts, ends, spans, where[new])
            self.keys, self.slot = np.insert(self.keys, at[new], keys[new]), np.insert(self.slot, at[new], numbers)
            at = np.searchsorted(self.keys, keys)
        out = self.slot[at][inverse] if len(keys) else at
        other = np.flatnonzero(~spans.equal(np.arange(len(out)), self.pieces, out))
        if len(other):
            out[other] = self._add(text, starts, ends, spans, other)
        return out

    def rows(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For chunks of rows: the first row's number, the ids of all of them (each with ``end`` behind it), and where rows begin."""
        data, offsets = buffers(texts)
        row, n = 0, len(offsets) - 1
        while row < n:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            part = data[offsets[row] : offsets[stop]]
            chars = np.concatenate([[0], np.cumsum(per_row((part & 0xC0) != 0x80, offsets[row : stop + 1] - offsets[row]))])
            yield row, *self._encode(part.tobytes().decode(), chars, end)
            row = stop

    def _encode(self, text: str, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(cp, offsets)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        slots = self._numbers(text, lanes(cp, starts, ends), starts, ends)
        size = self.first[slots + 1] - self.first[slots]
        done = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.first[slots] - done[:-1], size) + np.arange(done[-1])]
        piece_ptr = np.searchsorted(starts, offsets)
        ptr = done[piece_ptr] + np.arange(len(offsets))
        out = np.empty(ptr[-1], np.uint32)
        closing = np.zeros(len(out), bool)
        closing[ptr[1:] - 1] = True
        out[closing] = end
        out[~closing] = flat
        return out, ptr


def cut(ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows longer than ``size`` cut so that all pieces but the first are full: row, piece number, start in the row, length."""
    total = np.diff(ptr)
    pieces = np.maximum(1, -(-total // size))
    row = np.repeat(np.arange(len(total)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = total - (pieces - 1) * size
    start = np.where(number == 0, 0, head[row] + (number - 1) * size)
    return row, number, start, np.where(number == 0, head[row], size)
