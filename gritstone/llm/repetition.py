"""Quality rules: how much of a text repeats itself, from a suffix array over its words.

Suffixes of all texts of a chunk are sorted together by prefix doubling, each text for itself. Ranks of
every doubling step give the longest common prefix (LCP) of neighbours; an LCP interval of at least
``min_repeat`` words is a maximal repeated substring. The union of the spans of such repeats gives the
covered fraction, the longest of them the longest repeat; a text over either limit is rejected.

Null and empty texts have no words: all counts are 0 and the text is rejected (under ``min_words``).
Every row is judged for itself, so repeated rows and ties need no rule, and other columns are not read.
Texts of any length are judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gritstone.llm._spark import batch, map_rows, map_texts
from gritstone.llm._words import PLAIN, Chunk, chunks, cover, per_row

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


def suffixes(keys: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of sequences laid end to end, and the ranks by the first 1, 2, 4, ... words.

    keys: equal for equal words of one sequence and different otherwise. room: what is left of the
    sequence at each place. Only suffixes that still tie are sorted again.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    sorted_keys = keys[sa]
    head = np.ones(n, bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    rank[sa] = first[np.cumsum(head) - 1]
    levels = [rank]
    step = 1
    while True:
        size = np.diff(np.append(first, len(slots)))
        tied = np.repeat(size > 1, size)
        slots = slots[tied]
        if not len(slots):
            return sa, levels
        at = sa[slots]
        follow = np.where(room[at] > step, rank[np.minimum(at + step, n - 1)], -1)
        pair = rank[at] * (n + 1) + follow + 1
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = pair[1:] != pair[:-1]
        first = np.flatnonzero(head)
        rank = rank.copy()
        rank[at] = slots[first][np.cumsum(head) - 1]
        levels.append(rank)
        step *= 2


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array with at least ``least`` words in common: their places and that number."""
    level = min(len(levels) - 1, max(0, least.bit_length() - 1))
    rank = levels[level][sa]
    near = np.flatnonzero(rank[1:] == rank[:-1])
    a, b = sa[near], sa[near + 1]
    length = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (room[a] > length) & (room[b] > length)
        p, q = np.where(inside, a + length, 0), np.where(inside, b + length, 0)
        length += np.where(inside & (levels[k][p] == levels[k][q]), 1 << k, 0)
    long = length >= least
    return a[long], b[long], length[long]


def repeats(c: Chunk, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the chunk: words covered by maximal repeats of at least ``least`` words, and the longest repeat."""
    n, rows = len(c.starts), c.rows()
    longest = np.zeros(c.n, np.int64)
    if not n:
        return np.zeros(c.n, np.int64), longest
    room = c.room()
    own = c.word_hash() + rows.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    a, b, length = common_prefixes(*suffixes(own, room), room, least)
    covered = cover(np.concatenate([a, b]), np.concatenate([length, length]), n)
    np.maximum.at(longest, rows[a], length)
    return per_row(covered, c.ptr), longest


def repeated_lines(c: Chunk) -> np.ndarray:
    """For each row: lines that have a word and equal an earlier line of the row."""
    if not len(c.data):
        return np.zeros(c.n, np.int64)
    full = c.offsets[1:] > c.offsets[:-1]
    begin = np.union1d(c.offsets[:-1][full], np.flatnonzero(c.data == 10) + 1)
    begin = begin[begin < len(c.data)]
    row = np.searchsorted(c.offsets, begin, "right") - 1
    end = np.append(begin[1:], len(c.data))
    ends_line = c.data[end - 1] == 10
    end = end - ends_line
    worded = np.searchsorted(c.starts, end) > np.searchsorted(c.starts, begin)
    begin, end, row = begin[worded], end[worded], row[worded]
    key = c.span_hash(begin, end)
    order = np.lexsort((key, row))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][same], minlength=c.n).astype(np.int64)


def judge(texts: pa.Array, min_words: int, min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    parts = []
    for c in chunks(texts, PLAIN):
        lead = (c.data & 0xC0) != 0x80
        covered, longest = repeats(c, min_repeat)
        words = c.n_words()
        base = (words < min_words) | (100 * covered > 20 * words)
        over = (covered > max_covered * words) | (longest > max_longest)
        parts.append((words, per_row(lead & PLAIN[c.data], c.offsets), per_row(SYMBOLS[c.data], c.offsets), repeated_lines(c), covered, longest, base, ~base & ~over))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept")
    kinds = (np.int64,) * 6 + (bool,) * 2
    return {name: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k, name in enumerate(names)}


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, min_repeat: int = 5, max_covered: float = 0.2, max_longest: int = 100
) -> DataFrame:
    """One row for each document with its counts and verdict.

    n_words, word_chars (characters in words), n_symbols, n_dup_lines, n_repeat_words (words in repeats of
    ``min_repeat`` words or more), longest_repeat (words), base_failed (under ``min_words`` or more than a
    fifth repeated) and kept (not base_failed, covered fraction at most ``max_covered`` and longest repeat
    at most ``max_longest``). One narrow pass without a shuffle.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(doc_id=b.column(0), **judge(b.column(1), min_words, min_repeat, max_covered, max_longest))

    return map_texts(docs, run, SCHEMA, id_col, text_col)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", min_words: int = 10, min_repeat: int = 5, max_covered: float = 0.2, max_longest: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text ``repetition_rules`` keeps."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(b.schema.get_field_index(text_col))
        return b.filter(pa.array(judge(texts, min_words, min_repeat, max_covered, max_longest)["kept"]))

    return map_rows(docs, run)
