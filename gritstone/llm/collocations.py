"""Phrases whose words stand together more often than chance has it, from one weighted de Bruijn graph for each language.

Nodes are sequences of ``max_words - 1`` words, edges the sequences of ``max_words`` words that join two of them,
weighted by how often they occur within the pieces of the texts. Only edges are counted. How often a node's sequence
occurs is the flow out of it, the sum of its edges, and one more for each piece that ends with it; the
counts of shorter sequences follow in the same way from the flow of those that begin with them. The flow is summed
over slices of texts first: a slice gives one row for each node, with the words that follow it (``.`` where a piece ends),
and each task one for each shorter sequence and language. A node that many words follow gives those in further rows, dealt by
number, so no node is more than a few rows a slice for any task. Rows meet by node once, nodes under ``min_count`` go,
and the edges of the others are counted.

Paths of the frequent graph without branches are compacted: an edge goes on in the next where the node between has the
weight of both, as then no other edge and no end of a piece touches it. Pointers along such edges are doubled by joins, so
rounds follow the logarithm of the longest path. All that lies inside a path has the path's weight.

Each candidate of 2 to ``max_words`` words is cut in two in all ways, with score ``floor(scale * a * a / (l * r))`` in exact
decimals; its lowest counts, the smallest cut among equal ones. One goes that lies in a longer candidate with at
least ``share`` per cent of its count: nodes inside a path go at once, others by their edges.

Defined results. A null text is empty and has no phrases; a null language is ``und``. Repeated rows count
once each. Words are told apart by their bytes, phrases by their words. Of equal scores the higher count, then the smaller
phrase in byte order comes first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, discard, give_back, materialize, quoted
from gritstone.llm._words import distinct_spans, lanes, scan, scan_rows

UNKNOWN = "und"
MANY = 64  # words behind a node in one row
FLOW_SLICE = 4 << 20  # bytes of text whose nodes are summed at once
HELD = 200_000  # shorter sequences that a task holds

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[[*(ord(x) for x in ".,;:!?"), *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data``, a space between those of one string: bytes and offsets. of: the string of each span, ascending, of ``n`` strings."""
    size = end - begin + 1
    done = np.cumsum(size)
    total = int(done[-1]) if len(done) else 0
    padded = np.append(data, np.uint8(0x20))
    out = padded[np.repeat(begin - (done - size), size) + np.arange(total)]
    out[done - 1] = 0x20
    offsets = np.concatenate([[0], np.bincount(of, size, minlength=n).cumsum()]).astype(np.int64)
    closing = np.zeros(total, bool)
    full = offsets[1:] > offsets[:-1]
    closing[offsets[1:][full] - 1] = True
    return out[~closing], offsets - np.concatenate([[0], np.cumsum(full)])


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def short_rows(names: pa.Array, lang: np.ndarray, text: pa.Array, flow: np.ndarray) -> pa.Table:
    return pa.table({"head": pc.binary_join_element_wise(names.take(pa.array(lang)), text, "\n"), "flow": pa.array(flow, pa.int64())})


def slice_flow(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, max_words: int) -> tuple[list[pa.RecordBatch], list[pa.Table]]:
    """Of a slice: rows (head, tails) of its nodes, and (head, flow) of shorter sequences. ``lang`` is the language of each row.

    tails: what follows the node each time, or ``:`` and its flow where ``MANY`` or more do; these are in rows
    of their own, whose head has a line tabulation and a number behind it.
    """
    data = _LOWER[data]
    c = scan(data, offsets, _WORD)
    n, top = len(c.starts), max_words - 1
    if not n:
        return [], []
    codes = pc.dictionary_encode(lang)
    names = codes.dictionary
    group = np.repeat(np.asarray(codes.indices).astype(np.int64), c.n_words())
    piece = np.cumsum(_BREAK[data])[c.starts] + c.rows()  # grows with each break and each row
    where, word = distinct_spans(lanes(data, c.starts, c.ends), group)
    # sequences of 1 to max_words - 1 words from each word on, by number; -1 where the piece ends before
    ids, first = [word], [where]
    for size in range(2, max_words):
        short = ids[-1][: max(0, n - size + 1)]
        ok = np.flatnonzero((short >= 0) & (piece[: len(short)] == piece[n - len(short) :]))
        _, where, number = np.unique((short[ok] << 32) | word[ok + size - 1], return_index=True, return_inverse=True)
        own = np.full(n, -1, np.int64)
        own[ok] = number
        ids.append(own)
        first.append(ok[where])

    def text(size: int, at: np.ndarray) -> pa.Array:
        each = np.add.outer(at, np.arange(size)).ravel()
        return strings(*gather(data, c.starts[each], c.ends[each], np.repeat(np.arange(len(at)), size), len(at)))

    # the words behind a node, the end of its piece where there is none: as many as its flow
    at = np.flatnonzero(ids[top - 1] >= 0)
    at = at[np.argsort(ids[top - 1][at], kind="stable")]
    node, behind = ids[top - 1][at], at + top
    goes_on = behind < n
    goes_on[goes_on] = piece[behind[goes_on]] == piece[at[goes_on]]
    behind = np.minimum(behind, n - 1)
    begin, end = np.where(goes_on, c.starts[behind], len(data)), np.where(goes_on, c.ends[behind], len(data) + 1)
    dotted = np.append(data, np.uint8(0x2E))
    flow = np.bincount(node, minlength=len(first[top - 1]))
    few = flow[node] < MANY
    tails = strings(*gather(dotted, begin[few], end[few], node[few], len(flow)))
    if not few.all():
        tails = pc.if_else(pa.array(flow < MANY), tails, pc.binary_join_element_wise("", pa.array(flow).cast(pa.string()), ":"))
    language = names.take(pa.array(group[first[top - 1]]))
    rows = [batch(head=pc.binary_join_element_wise(language, text(top, first[top - 1]), "\n"), tails=tails)]
    many = np.flatnonzero(~few & goes_on)
    if len(many):
        own = node[many]
        new = np.ones(len(many), bool)
        new[1:] = own[1:] != own[:-1]
        place = np.arange(len(many)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= place % MANY == 0
        of = np.cumsum(new) - 1
        where = first[top - 1][own[new]]
        head = pc.binary_join_element_wise(names.take(pa.array(group[where])), text(top, where), "\n")
        head = pc.binary_join_element_wise(head, pa.array(place[new] // MANY % 1000).cast(pa.string()), "\v")
        rows.append(batch(head=head, tails=strings(*gather(data, begin[many], end[many], of, int(of[-1]) + 1))))
    # shorter sequences: the flow of the longer ones that begin with them, and the pieces that end with them
    shorter = []
    for size in range(top - 1, 0, -1):
        ends = (ids[size - 1] >= 0) & (ids[size] < 0)
        flow = np.bincount(ids[size - 1][first[size]], flow, minlength=len(first[size - 1])).astype(np.int64)
        flow += np.bincount(ids[size - 1][ends], minlength=len(flow))
        shorter.append(short_rows(names, group[first[size - 1]], text(size, first[size - 1]), flow))
    total = np.bincount(group, minlength=len(names))
    seen = np.flatnonzero(total)
    shorter.append(short_rows(names, seen, pa.array([""] * len(seen)), total[seen]))
    return rows, shorter


def flows(docs: DataFrame, max_words: int, text_col: str, lang_col: str) -> DataFrame:
    """head (language, line feed, words) and tails of all slices' nodes and tasks' shorter sequences."""
    lang = F.coalesce(docs[quoted(lang_col)].cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(docs[quoted(text_col)].alias("text"), lang)

    def emit(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in held:
            flow = pc.binary_join_element_wise("", table["flow"].cast(pa.string()), ":")
            yield from pa.table({"head": table["head"], "tails": flow}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            row = 0
            for data, offsets in scan_rows(b.column(0), FLOW_SLICE):
                rows, shorter = slice_flow(data, offsets, b.column(1).slice(row, len(offsets) - 1), max_words)
                yield from rows
                row += len(offsets) - 1
                held += shorter
                if sum(len(x) for x in held) > 2 * HELD:
                    sums = pa.concat_tables(held).group_by("head").aggregate([("flow", "sum")]).rename_columns(["head", "flow"])
                    if len(sums) > HELD:
                        yield from emit([sums])
                    held = [sums] if len(sums) <= HELD else []
            give_back()
        if held:
            yield from emit([pa.concat_tables(held).group_by("head").aggregate([("flow", "sum")]).rename_columns(["head", "flow"])])

    return texts.mapInArrow(run, "head string, tails string")


def sequence_counts(docs: DataFrame, max_words: int, min_count: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, size and f of all word sequences of up to ``max_words`` words that occur ``min_count`` times or more in a language; of size 0, how many words it has."""
    rows = flows(docs, max_words, text_col, lang_col).repartition("head")
    number = F.col("tails").startswith(":")
    flow = F.when(number, F.substring("tails", 2, 20).cast("long")).otherwise((n_words(F.col("tails"))).cast("long"))
    salted = F.contains(F.substring_index("head", "\n", -1), F.lit("\v"))
    # both uses read all columns of the same shuffle, so that Spark does it once
    nodes = rows.groupBy("head").agg(F.sum(flow).alias("total"), F.bool_or(number | salted).alias("hot")).filter((F.col("total") >= min_count) | F.col("hot")).select("head", "hot")
    met = rows.join(nodes.hint("shuffle_hash"), "head")
    own = F.when(~salted, F.array(F.struct(F.lit("").alias("tail"), flow.alias("n"))))
    behind = F.when(~number, F.transform(F.filter(F.split("tails", " "), lambda x: x != "."), lambda x: F.struct(x.alias("tail"), F.lit(1).cast("long").alias("n"))))
    none = F.array().cast("array<struct<tail:string,n:bigint>>")
    each = met.select("head", "hot", F.explode(F.concat(F.coalesce(own, none), F.coalesce(behind, none))).alias("x")).select("head", "hot", "x.tail", "x.n")
    # all rows of a node are in one partition; only where it has rows dealt by number do its edges meet once more
    there = each.groupBy("head", "tail", "hot").agg(F.sum("n").alias("n")).filter(F.col("hot") | (F.col("n") >= min_count))
    words = F.substring_index(F.substring_index("head", "\n", -1), "\v", 1)
    lang = F.left("head", F.length("head") - F.length(F.substring_index("head", "\n", -1)) - 1)
    named = there.select(lang.alias("lang"), words.alias("words"), "tail", "n")
    counted = named.groupBy("lang", "words", "tail").agg(F.sum("n").alias("f")).filter(f"f >= {min_count}")
    phrase = F.concat_ws(" ", "words", F.when(F.col("tail") != "", F.col("tail")))
    return counted.select("lang", phrase.alias("phrase"), "f").select("lang", "phrase", n_words(F.col("phrase")).alias("size"), "f")


def n_words(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)


def words_of(phrase: Column, first: int | Column, n: int | Column) -> Column:
    """Words ``first`` (from 1) to ``first + n - 1`` of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def compact(counts: DataFrame, max_words: int) -> DataFrame:
    """The frequent graph's paths without branches: lang, words, n_edges and f; every edge is in one of them."""
    edges = counts.filter(F.col("size") == max_words).select("lang", F.col("phrase").alias("edge"), "f")
    nodes = counts.filter(F.col("size") == max_words - 1).select("lang", F.col("phrase").alias("node"), "f")
    into = edges.withColumn("node", words_of(F.col("edge"), 2, max_words - 1)).join(nodes, ["lang", "node", "f"]).select("lang", "node", F.col("edge").alias("before"))
    onward = edges.withColumn("node", words_of(F.col("edge"), 1, max_words - 1)).join(nodes, ["lang", "node", "f"]).select("lang", "node", "edge")
    links = onward.join(into, ["lang", "node"]).select("lang", "edge", "before")
    # pointer: an edge so many steps before; where none is, the path's first edge
    chain = materialize(edges.join(links, ["lang", "edge"], "left").select("lang", "edge", "f", F.coalesce("before", "edge").alias("to"), F.col("before").isNotNull().cast("int").alias("steps")))
    while True:
        hop = chain.filter("steps > 0").select("lang", F.col("edge").alias("to"), F.col("to").alias("on"), F.col("steps").alias("more"))
        if hop.isEmpty() or chain.filter("steps > 0").join(hop, ["lang", "to"], "left_semi").isEmpty():
            break
        step = chain.join(hop, ["lang", "to"], "left").select("lang", "edge", "f", F.coalesce("on", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        step = materialize(step)
        discard(chain)
        chain = step
    tail = F.element_at(F.split("edge", " "), -1)
    paths = chain.groupBy("lang", "to", "f").agg(F.array_sort(F.collect_list(F.struct("steps", tail.alias("word")))).alias("rest"))
    rest = F.transform(F.slice("rest", 2, F.size("rest")), lambda x: x["word"])
    return paths.select("lang", F.concat_ws(" ", F.col("to"), F.array_join(rest, " ")).alias("joined"), F.size("rest").alias("n_edges"), "f").select("lang", F.rtrim("joined").alias("words"), "n_edges", "f")


def candidates(counts: DataFrame, paths: DataFrame, max_words: int, share: int) -> DataFrame:
    """lang, phrase, size and f of the sequences of 2 words or more that no longer one swallows."""
    window = lambda n: F.transform(F.sequence(F.lit(1), F.col("n_edges") + max_words - n), lambda k: words_of(F.col("words"), k, F.lit(n)))
    edges = paths.select("lang", F.explode(window(max_words)).alias("phrase"), F.lit(max_words).alias("size"), "f")
    if max_words == 2:
        return edges
    # nodes inside a path have its weight: they lie in their edges and are swallowed whatever the share
    inner = paths.filter("n_edges > 1").select("lang", F.explode(F.slice(window(max_words - 1), F.lit(2), F.col("n_edges") - 1)).alias("phrase"))
    shorter = counts.filter((F.col("size") >= 2) & (F.col("size") < max_words)).join(inner, ["lang", "phrase"], "left_anti")
    longer = edges.unionByName(counts.filter((F.col("size") > 2) & (F.col("size") < max_words)).select("lang", "phrase", "size", "f")) if max_words > 3 else edges
    parts = [words_of(F.col("phrase"), first, n) for n in range(2, max_words) for first in range(1, max_words - n + 2)]
    held = longer.select("lang", F.col("f").alias("most"), F.explode(F.array_distinct(F.array(*parts))).alias("phrase"), F.col("phrase").alias("whole")).filter("phrase <> whole")
    held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    left = shorter.join(held, ["lang", "phrase"], "left").filter(f"most is null or 100 * most < {share} * f")
    return edges.unionByName(left.select("lang", "phrase", "size", "f"))


def score_of(scale: int) -> Column:
    """floor(scale * a * a / (l * r)) of the columns a, l and r, exact for counts of up to 15 digits."""
    return F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * {scale}BD) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, scale: int = 1_000_000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank (from 1), phrase, a (its count), l and r (of the parts of its lowest cut), n (words of the language), score."""
    counts = materialize(sequence_counts(docs, max_words, min_count, text_col, lang_col))
    paths = materialize(compact(counts, max_words))
    cand = candidates(counts, paths, max_words, share).withColumnRenamed("f", "a")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = cand.select("lang", "phrase", "size", "a", k.alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), words_of(F.col("phrase"), F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), words_of(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    sides = cuts.select("lang", "phrase", "a", "k", sides.alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part")
    parts = sides.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cut = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    scored = cut.withColumn("score", score_of(scale))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, then among what these leave
    some = best.withColumn("part", F.pmod(F.hash("phrase"), F.lit(16)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
