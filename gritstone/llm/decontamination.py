"""Benchmark decontamination: a generalised suffix automaton of the test items, run along the documents.

Items and documents are lower-cased (A-Z) and cut into words. The automaton holds every run of
consecutive item words; walking it along a document gives, at each word, the longest run ending there
that some item contains. A run of ``window`` words (or a whole item that is shorter) is a hit.

The automaton walk is Python, so numpy first leaves out what cannot matter: a match needs that many
words of the items' vocabulary in a row, each pair of neighbours a pair of the items. That test is
exact; only such stretches are walked.

The items reach every task, so their size is checked: they are cut into blocks of at most about
``block_words`` words. One block takes one narrow pass. Several take a pass each, one after the other: the
driver and the tasks hold a single block, a worker builds its automaton once and keeps it, and the spans
hit, which are few, are written and then joined to the documents on a hash of the row. So time grows with
the number of blocks, and memory doesn't: an automaton takes some 0.75 KB a word, 150 MB for a block of 200,000.

Null and empty texts have no words and no hits; an item without words has no window. Repeated items
count by their item_id, items of equal words all count, and an item with a null id is called None. An empty
benchmark hits nothing. Repeated rows, and rows of one id with different texts, are judged each for itself.
Texts are walked whole, in slices of rows of about 1 MB, so that a longer text is a slice of its own. Other
columns pass through ``remove_benchmark`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, discard, fresh, map_rows, map_texts, materialize, quoted, with_text
from gritstone.llm._words import ALNUM, Chunk, chunks, cover, mix, per_row

_PAIR = np.uint64(0x9FB21C651E98DF25)


class ItemAutomaton:
    """Generalised suffix automaton over the words of test items."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.items = items
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: Which state on the way to the root holds the last ``window`` words; -1 if the state is shorter.
        self.anchor = [-1] * n
        #: Items shorter than a window that end at the state itself, or at one on the way to the root.
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.above: dict[int, list[int]] = {}
        self.found: dict[int, set[int]] = {}
        for k, (_, words) in enumerate(items):
            state = 0
            for at, w in enumerate(words):
                state = self.next[state][w]
                if at + 1 >= window:
                    self.found.setdefault(state, set()).add(k)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), k))
        for v in order:
            up = self.link[v]
            self.anchor[v] = -1 if self.length[v] < window else self.anchor[up] if self.length[up] >= window else v
            own = [k for _, k in self.short.get(up, ())] + self.above.get(up, [])
            if own:
                self.above[v] = own
        for v in reversed(order):
            if v in self.found and self.length[self.link[v]] >= window:
                self.found.setdefault(self.link[v], set()).update(self.found[v])
        self.shortest = min((min(window, len(words)) for _, words in items if words), default=0)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans (first word, number of words) that are hit, the items found, and the longest match."""
        spans, found, longest = [], set(), 0
        state, matched = 0, 0
        for at, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w not in self.next[state]:
                matched = 0
                continue
            state, matched = self.next[state][w], matched + 1
            longest = max(longest, matched)
            if matched >= self.window:
                spans.append((at - self.window + 1, self.window))
                found |= self.found.get(self.anchor[state], set())
            for size, k in self.short.get(state, ()):
                if size <= matched:
                    spans.append((at - size + 1, size))
                    found.add(k)
            for k in self.above.get(state, ()):
                size = len(self.items[k][1])
                spans.append((at - size + 1, size))
                found.add(k)
        return spans, found, longest


class Matcher:
    """One block of items, ready to run over chunks of documents."""

    def __init__(self, ids: list, texts: list[str], window: int):
        words: list[np.ndarray] = []
        for c in chunks(pa.array(texts, pa.large_string()), ALNUM, lower=True):
            h = c.word_hash()
            words += [h[c.ptr[r] : c.ptr[r + 1]] for r in range(c.n)]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(flat)
        pairs = [self.pair(w[:-1], w[1:]) for w in words if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.ids = ids
        self.automaton = ItemAutomaton([(i, np.searchsorted(self.vocabulary, w).tolist()) for i, w in zip(ids, words, strict=True)], window)

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _PAIR + b)

    def hits(self, c: Chunk) -> tuple[np.ndarray, list[set[int]], np.ndarray]:
        """Which words of the chunk are hit; the items found and the longest match of each row (0 under a window)."""
        n, rows = len(c.starts), c.rows()
        found: list[set[int]] = [set() for _ in range(c.n)]
        longest = np.zeros(c.n, np.int64)
        least = self.automaton.shortest
        if not n or not least:
            return np.zeros(n, bool), found, longest
        h = c.word_hash()
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        bound = np.zeros(n, bool)  # to the word before
        both = np.flatnonzero(known[1:] & known[:-1] & (rows[1:] == rows[:-1])) + 1
        if len(both) and len(self.pairs):
            p = self.pair(h[both - 1], h[both])
            bound[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)] == p
        first = np.flatnonzero(known & ~bound)
        last = np.flatnonzero(known & ~np.append(bound[1:], False)) + 1
        long = last - first >= least
        start, size = [], []
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            spans, items, most = self.automaton.walk(at[a:b].tolist())
            r = rows[a]
            longest[r] = max(longest[r], most if most >= self.automaton.window else 0)
            if spans:
                found[r] |= items
                start += [a + s for s, _ in spans]
                size += [k for _, k in spans]
        return cover(np.array(start, np.int64), np.array(size, np.int64), n), found, longest


@dataclass(frozen=True)
class Block:
    name: str
    ids: list
    texts: list[str]
    window: int


_held: dict[str, Matcher] = {}


def matcher(block: Block) -> Matcher:
    """The matcher of a block, which a worker keeps until it meets another block."""
    if block.name not in _held:
        _held.clear()
        _held[block.name] = Matcher(block.ids, block.texts, block.window)
    return _held[block.name]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks of test items, and the blocks, each fetched when it is asked for."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0]
    n_blocks = 1 + int(size or 0) // (2 * block_words)  # a word and what parts it from the next are 2 characters at least

    def fetch() -> Iterator[Block]:
        for k in range(n_blocks):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy(F.col("item_id").cast("string"), "text").toArrow()
            yield Block(uuid.uuid4().hex, part["item_id"].to_pylist(), part["text"].to_pylist(), window)

    return n_blocks, fetch()


def spans_of(c: Chunk, hit: np.ndarray) -> pa.ListArray:
    """For each row of the chunk, its runs of hit words: the place of the first one in the row times 2^32, and how many they are."""
    rows = c.rows()
    same = rows[1:] == rows[:-1]
    begin, last = hit.copy(), hit.copy()
    begin[1:] &= ~(hit[:-1] & same)
    last[:-1] &= ~(hit[1:] & same)
    first, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    row = rows[first]
    offsets = np.searchsorted(row, np.arange(c.n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(((first - c.ptr[row]) << 32) + end - first))


def hit_words(c: Chunk, spans: pa.ListArray) -> np.ndarray:
    """Which words of the chunk lie in the spans of its rows."""
    own = spans.slice(c.row, c.n)
    row = np.repeat(np.arange(c.n), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
    flat = np.asarray(pc.list_flatten(own))
    return cover(c.ptr[row] + (flat >> 32), flat & 0xFFFFFFFF, len(c.starts))


def found_spans(texts: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """key, spans, items and longest of the rows of ``texts`` (doc_id, text, key) that any block hits; a pass for each block."""
    tables = []
    for block in blocks:

        def run(b: pa.RecordBatch, block: Block = block) -> pa.RecordBatch:
            m, out = matcher(block), []
            for c in chunks(b.column(1), ALNUM, lower=True):
                hit, found, longest = m.hits(c)
                some = pa.array(per_row(hit, c.ptr) > 0)
                items = pa.array([[str(m.ids[k]) for k in x] for x in found], pa.list_(pa.string()))
                out.append(batch(key=b.column(2).slice(c.row, c.n), spans=spans_of(c, hit), items=items, longest=longest).filter(some))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else None

        tables.append(materialize(map_texts(texts, run, "key long, spans array<long>, items array<string>, longest long", extra=("key",)).dropDuplicates(["key"])))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    joined = lambda x: F.array_distinct(F.flatten(F.collect_list(x))).alias(x)  # noqa: E731  # of one text
    merged = materialize(every.groupBy("key").agg(joined("spans"), joined("items"), F.max("longest").alias("longest")))
    discard(*tables)
    return merged


def row_key(docs: DataFrame, text_col: str, *others: str):
    return F.xxhash64(*(docs[quoted(c)].cast("string") for c in others), docs[quoted(text_col)])


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 200_000
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit (words inside a window of an item), n_items, items_sha256
    (of the item_ids found, sorted as strings and joined by commas), longest_match (the longest run of words that an item has too,
    0 under ``window``), contaminated (n_hit > 0)."""
    n_blocks, blocks = item_blocks(benchmark, item_col, item_text_col, window, block_words)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, longest_match long, contaminated boolean"

    def row(doc: pa.Array, c: Chunk, hit: np.ndarray, names: list[list[str]], longest: np.ndarray) -> pa.RecordBatch:
        names = [sorted(set(x)) for x in names]
        n_hit = per_row(hit, c.ptr)
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        return batch(doc_id=doc.slice(c.row, c.n), n_words=c.n_words(), n_hit=n_hit, n_items=pa.array([len(x) for x in names], pa.int64()), items_sha256=pa.array(sha, pa.string()), longest_match=longest, contaminated=n_hit > 0)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    if n_blocks == 1:
        block = next(blocks)

        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            m, out = matcher(block), []
            for c in chunks(b.column(1), ALNUM, lower=True):
                hit, found, longest = m.hits(c)
                out.append(row(b.column(0), c, hit, [[str(m.ids[i]) for i in x] for x in found], longest))
            return one(out)

        return map_texts(docs, run, schema, id_col, text_col)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), row_key(docs, text_col).alias("key"))
    joined = texts.join(found_spans(texts, blocks), "key", "left")

    def merge(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out, items, longest = [], b.column(3), pc.fill_null(b.column(4), 0).to_numpy(zero_copy_only=False)
        for c in chunks(b.column(1), ALNUM, lower=True):
            names = [x or [] for x in items.slice(c.row, c.n).to_pylist()]
            out.append(row(b.column(0), c, hit_words(c, b.column(2)), names, longest[c.row : c.row + c.n]))
        return one(out)

    return map_texts(joined, merge, schema, extra=("spans", "items", "longest"))


def cut_words(c: Chunk, keep: np.ndarray, original: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's texts without the words that ``keep`` leaves out, each with what stands between it and the next word: bytes and lengths."""
    gone = np.flatnonzero(~keep)
    if not len(gone):
        return original, np.diff(c.offsets)
    row_end = np.repeat(c.offsets[1:], c.n_words())
    following = np.minimum(np.append(c.starts[1:], len(c.data)), row_end)
    stay = ~cover(c.starts[gone], following[gone] - c.starts[gone], len(c.data))
    return original[stay], per_row(stay, c.offsets)


def cut_rows(b: pa.RecordBatch, text_col: str, parts: list[tuple[Chunk, np.ndarray, np.ndarray]], max_coverage: float = 1.0) -> pa.RecordBatch:
    """The batch with texts cut: parts are its chunks, their bytes as they were, and which words go.

    Rows go of which more than ``max_coverage`` goes, or that are left without a word; rows that lose
    nothing stay as they are, nulls too.
    """
    data, sizes, stay, touched = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
    for c, original, gone in parts:
        n, n_gone = c.n_words(), per_row(gone, c.ptr)
        left, lengths = cut_words(c, ~gone, original)
        data.append(left)
        sizes.append(lengths)
        touched.append(n_gone > 0)
        stay.append((n_gone == 0) | ((n_gone <= max_coverage * n) & (n_gone < n)))
    touched, stay = np.concatenate(touched), np.concatenate(stay)
    if touched.any():
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
        texts = b.column(b.schema.get_field_index(text_col))
        b = with_text(b, pc.if_else(pa.array(touched), cut, texts.cast(pa.large_string())), text_col)
    return b if stay.all() else b.filter(pa.array(stay))


def remove_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_coverage: float = 0.5, block_words: int = 200_000
) -> DataFrame:
    """``docs`` without the words that lie in a window of a test item.

    A document of which more than ``max_coverage`` is hit goes as a whole, as does one left without a
    word; one without hits stays as it is, empty and null texts too. n_chars, if there, follows the text.
    """
    n_blocks, blocks = item_blocks(benchmark, item_col, item_text_col, window, block_words)

    def both(texts: pa.Array) -> Iterator[tuple[Chunk, np.ndarray]]:
        plain = chunks(texts, ALNUM)
        for c in chunks(texts, ALNUM, lower=True):
            yield c, next(plain).data

    if n_blocks == 1:
        block = next(blocks)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            m = matcher(block)
            return cut_rows(b, text_col, [(c, raw, m.hits(c)[0]) for c, raw in both(b.column(b.schema.get_field_index(text_col)))], max_coverage)

        return map_rows(docs, run, text_col)

    key, spans = fresh(docs, "row_key"), fresh(docs, "row_spans")
    keyed = docs.withColumn(key, row_key(docs, text_col))
    found = found_spans(keyed.select(F.lit(None).cast("long").alias("doc_id"), keyed[text_col].alias("text"), keyed[key].alias("key")), blocks)
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left").select(*map(quoted, docs.columns), spans)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        own = b.column(b.schema.get_field_index(spans))
        b = b.drop_columns([spans])
        return cut_rows(b, text_col, [(c, raw, hit_words(c, own)) for c, raw in both(b.column(b.schema.get_field_index(text_col)))], max_coverage)

    return map_rows(joined, cut, text_col, drop=(spans,))
