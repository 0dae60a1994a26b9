"""How filters of documents act on each other: what each removes alone, after others, and in every order.

A table-driven transducer goes over the UTF-8 bytes of a text once. Each byte has a class (``CLASS``), and a state
and a class give what is put out (``OUT``, flags: a word begins, a word has ended, capital, code point, symbol) and
the next state (``NEXT``). The next state of this machine depends on the class alone, so numpy runs all bytes
of a slice of texts at once; every row begins outside words. The word spans that it marks go into a hash table
that compares their bytes (``distinct_spans``), which counts the distinct words of each text.

Five filters judge a document: A has under ``min_words`` words; B, distinct words are under ``min_distinct`` per cent of its
words; C, capitals ``[A-Z]`` are over ``max_capitals`` per cent of its code points; D, it holds a symbol of
``[#$%&*|]``; E, its text is that of a smaller doc_id, anywhere in the table. What a document fails is a
mask of five bits, and an order of filters needs only the counts of masks: so each document is one
narrow row (digest of the text, mask, part), rows are counted by doc_id, then by text, then by mask, always
with partial sums before a shuffle, and all 120 orders are tried on the counts.

Defined results. Null texts are empty: no words, so they fail A, and all but the smallest doc_id of them E. A null part is the
empty string. Repeated rows count one by one; rows of one doc_id and text don't make each other fail E. A row without
doc_id never fails E, has no labels and no smaller id than others. A document with several labels is good or
toxic if one of them says so. An empty table has no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_texts, quoted
from gritstone.llm._words import distinct_spans, lanes, scan_rows

FILTERS = "ABCDE"
SPACE, CAPITAL, SYMBOL, LEAD, INNER = range(5)
OUTSIDE, INSIDE = 0, 1
BEGINS, ENDED, IS_CAPITAL, CODE_POINT, IS_SYMBOL = 1, 2, 4, 8, 16

CLASS = np.full(256, LEAD, np.uint8)
CLASS[0x80:0xC0] = INNER
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[0x41:0x5B] = CAPITAL
CLASS[[ord(x) for x in "#$%&*|"]] = SYMBOL

#: By class: the state after such a byte.
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
#: By state and class.
OUT = np.array(
    [
        [CODE_POINT, BEGINS | IS_CAPITAL | CODE_POINT, BEGINS | IS_SYMBOL | CODE_POINT, BEGINS | CODE_POINT, BEGINS],
        [CODE_POINT | ENDED, IS_CAPITAL | CODE_POINT, IS_SYMBOL | CODE_POINT, CODE_POINT, 0],
    ],
    np.uint8,
)


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs the transducer over rows of bytes: counts of each row (words, capitals, code points, symbols), and where words begin and end."""
    n = len(offsets) - 1
    kind = CLASS[data]
    state = np.empty(len(data), np.uint8)
    after = NEXT[kind]
    state[1:] = after[:-1]
    full = offsets[1:] > offsets[:-1]
    state[offsets[:-1][full]] = OUTSIDE
    out = OUT[state, kind]
    row = np.repeat(np.arange(n, dtype=np.int64) << 5, np.diff(offsets))
    seen = np.bincount(row + out, minlength=n << 5).reshape(n, 32)
    flag = np.arange(32)
    counts = np.stack([seen[:, flag & bit > 0].sum(axis=1) for bit in (BEGINS, IS_CAPITAL, CODE_POINT, IS_SYMBOL)], axis=1)
    begin, ended = np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDED)
    open_ends = offsets[1:][full]
    open_ends = open_ends[after[open_ends - 1] == INSIDE]
    return counts, begin, np.sort(np.concatenate([ended, open_ends]))


COUNTS = "n_words long, n_capitals long, n_chars long, n_symbols long, n_distinct long"


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_capitals, n_chars (code points), n_symbols, n_distinct (words), and the columns ``extra``."""
    kept = [docs.schema[c] for c in extra]
    schema = ", ".join(["doc_id long", COUNTS, *(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.zeros((0, 5), np.int64)]
        for data, offsets in scan_rows(b.column(1)):
            counts, begin, end = transduce(data, offsets)
            row = np.repeat(np.arange(len(counts)), counts[:, 0])
            first, _ = distinct_spans(lanes(data, begin, end), row)
            parts.append(np.column_stack([counts, np.bincount(row[first], minlength=len(counts))]))
        names = ("n_words", "n_capitals", "n_chars", "n_symbols", "n_distinct")
        found = dict(zip(names, np.ascontiguousarray(np.concatenate(parts).T), strict=True))
        return batch(doc_id=b.column(0), **found, **{c: b.column(2 + k) for k, c in enumerate(extra)})

    return map_texts(docs, run, schema, id_col, text_col, extra)


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10
) -> DataFrame:
    """doc_id, part, digest (of the text) and mask of each document: bits 1, 2, 4, 8 for the filters A to D. One narrow pass."""
    text = F.coalesce(docs[quoted(text_col)], F.lit(""))
    rows = docs.select(
        docs[quoted(id_col)].cast("long").alias("doc_id"), text.alias("text"), F.coalesce(docs[quoted(part_col)].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    counted = text_counts(rows, extra=("part", "digest"))
    failed = [
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
        100 * F.col("n_capitals") > max_capitals * F.col("n_chars"),
        F.col("n_symbols") > 0,
    ]
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))
    return counted.select("doc_id", "part", "digest", mask.alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, good, toxic, mask (16: filter E) and n, the number of documents. At most 128 rows for each part."""
    marks = labels.groupBy(labels[quoted(label_id)].cast("long").alias("doc_id")).agg(F.max((labels[quoted(good_col)] == 1).cast("int")).alias("good"), F.max((labels[quoted(toxic_col)] == 1).cast("int")).alias("toxic"))
    each = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    each = each.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # rows of the smallest doc_id of a text and rows without one don't fail E
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = each.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.min(named).alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("low.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label at most
    own = F.col("unnamed") + F.when(F.col("low.doc_id") == least, F.col("low.n")).otherwise(0)
    both = texts.withColumn("own", own).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    return both.select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0").groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits) -> DataFrame:
    """One row for each part, order of the five filters (filter_order) and step (1 to 5).

    kept, documents left after the step; removed, by it; redundant, that fail its filter and were removed
    before; unique_fails, that fail its filter only; good_lost and toxic_lost, of those removed, the ones labelled so;
    shapley, what the step's filter removes, summed over all orders.
    """
    counts = mask_counts(failures(docs, id_col, text_col, part_col, **limits), labels)
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    tried = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = {x: F.lit(1 << k) for k, x in enumerate(FILTERS)}
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), b).otherwise(0) for x, b in bit.items()), F.lit(0))
    own = sum((F.when(F.instr("filter_order", x) == F.col("step"), b).otherwise(0) for x, b in bit.items()), F.lit(0))
    tried = tried.withColumn("own", own).withColumn("gone", F.col("mask").bitwiseAND(before) != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("own")) != 0)
    removed = F.col("fails") & ~F.col("gone")
    n = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    steps = tried.groupBy("part", "filter_order", "step", "own").agg(
        n(~F.col("gone") & ~F.col("fails")).alias("kept"),
        n(removed).alias("removed"),
        n(F.col("fails") & F.col("gone")).alias("redundant"),
        n(F.col("mask") == F.col("own")).alias("unique_fails"),
        n(removed & (F.col("good") == 1)).alias("good_lost"),
        n(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
