"""Substring dedup: a De Bruijn graph of the word k-mers that several documents share, compacted to paths.

Edges are runs of ``k`` words (k-mers); two edges are neighbours where one follows the other in a text.
Only repeated edges are of interest, so few are ever shuffled:

1. Anchors. Each k-mer holds ``k - 4`` five-word grams; the one of smallest hash is its anchor. Equal
   k-mers have equal anchors, so a k-mer whose anchor occurs in one text only cannot be repeated. About
   a fifth of the grams are anchors; one aggregation finds those that different texts share: the smallest
   and the largest hash of a text that has the anchor differ.
2. Edges. Texts with shared anchors give up the k-mers on them, each with the edges before and after it.
   One aggregation keeps those of two documents or more, with the smallest document as their source.
3. Compaction. An edge is inner if all texts have the same edge before it and the same after it. A join of
   the edges with themselves, on coordinates in their sources, links inner edges that follow each other;
   runs of them are the nonbranching paths. Every document with a path's first edge has the whole path.
4. Coordinates. A join of the first edges with their occurrences gives the spans in each document. Each is
   verified on the text itself before a word is removed: its ends, and all of its edges by what the source
   gave for them.

Words, k-mers and texts are told apart by hashes of 64 bits. A document whose words, ``k`` at least, all equal
those of one with a smaller id is a copy as a whole and joins no graph.

Null and empty texts have no words and nothing to remove. doc_id names a document: rows of one id, equal or
not, do not repeat each other, and each is judged for itself. A null doc_id is nobody's source and loses
nothing. Of an empty table nothing is returned. Texts are read whole, a slice of rows of about 1 MB at a time;
a longer text is a slice of its own. Other columns pass through ``remove_repeated`` unchanged, whatever their
names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, discard, fresh, map_rows, map_texts, materialize
from gritstone.llm._words import Chunk, chunks, cover, mix, per_row, window_hash
from gritstone.llm.decontamination import cut_rows

GRAM = 5
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_ROW = np.uint64(0xD1342543DE82EF95)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(words: np.ndarray, k: int) -> np.ndarray:
    """The anchor of the k-mer at each word (for ``len(words) - k + 1`` of them)."""
    g = window_hash(words, GRAM)
    width = k - GRAM + 1
    out, done = g, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def kmers(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and anchor of each k-mer that lies in one row, and the words where they start."""
    words = c.word_hash()
    if len(words) < k:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64)
    at = np.flatnonzero(c.room()[: len(words) - k + 1] >= k)
    return window_hash(words, k)[at], anchors(words, k)[at], at


def joined(c: Chunk, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row, one space between them: bytes and lengths."""
    w = np.flatnonzero(keep)
    rows = c.rows()[w]
    data = c.data.copy()
    mask = cover(c.starts[w], c.ends[w] - c.starts[w], len(data))
    more = np.flatnonzero(rows[1:] == rows[:-1])
    data[c.ends[w[more]]] = 0x20
    mask[c.ends[w[more]]] = True
    return data[mask], per_row(mask, c.offsets)


def digests(data: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    raw, at = memoryview(data.tobytes()), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def print_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def row_of(c: Chunk, r: int) -> tuple[Chunk, np.ndarray]:
    """One row of a chunk, with all its words."""
    a, b, at = c.ptr[r], c.ptr[r + 1], c.offsets[r]
    own = Chunk(0, c.data[at : c.offsets[r + 1]], c.offsets[r : r + 2] - at, c.starts[a:b] - at, c.ends[a:b] - at, np.array([0, b - a]))
    return own, np.ones(b - a, bool)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, print (of the word sequence), whole_sha256 and the anchors of each document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n_words, prints, sha, flat, sizes = [], [], [], [], []
        for c in chunks(b.column(1)):
            d = digests(*joined(c, np.ones(len(c.starts), bool)))
            sha += [x.hex() for x in d]
            prints += [print_of(x) for x in d]
            n_words.append(c.n_words())
            _, m, at = kmers(c, k)
            row = c.rows()[at]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
            flat.append(signed(m[new]))
            sizes.append(np.bincount(row[new], minlength=c.n))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))
        return batch(doc_id=b.column(0), n_words=np.concatenate([np.zeros(0, np.int64), *n_words]), print=pa.array(prints, pa.int64()), whole_sha256=pa.array(sha, pa.string()), anchors=lists)

    return map_texts(docs, run, "doc_id long, n_words long, print long, whole_sha256 string, anchors array<long>", id_col, text_col)


def candidate_edges(texts: DataFrame, k: int) -> DataFrame:
    """edge, between, doc_id, place: the k-mers of ``texts`` (doc_id, text, anchors) on a shared anchor.

    between: a hash of the k-mers before and after it; 0 where one of them is none of these k-mers, or
    where the text holds the k-mer twice. place: a hash of the text times 2^32, and the k-mer's first word.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        values = np.asarray(lists.values).view(np.uint64)
        ids = np.asarray(b.column(0))
        out = []
        for c in chunks(b.column(1)):
            h, m, at = kmers(c, k)
            row = c.rows()[at]
            own = offsets[c.row : c.row + c.n + 1]
            wanted = np.unique(mix(values[own[0] : own[-1]] + np.repeat(np.arange(c.n), np.diff(own)).astype(np.uint64) * _ROW))
            if not len(wanted) or not len(h):
                continue
            key = mix(m + row.astype(np.uint64) * _ROW)
            hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            h, at, row = h[hit], at[hit], row[hit]
            near = (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])
            between = np.zeros(len(h), np.int64)
            inner = np.flatnonzero(near[1:] & near[:-1]) + 1
            between[inner] = signed(mix(h[inner - 1] + h[inner + 1] * _ROW) | np.uint64(1))
            key = mix(h + row.astype(np.uint64) * _ROW)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            between[order[1:][same]] = between[order[:-1][same]] = 0
            name = (c.span_hash(c.offsets[:-1], c.offsets[1:]) >> np.uint64(33)).astype(np.int64) << 32
            out.append((signed(h), between, ids[c.row + row], name[row] + at - c.ptr[row]))
        cols = [np.concatenate([np.zeros(0, np.int64), *(x[j] for x in out)]) for j in range(4)]
        return batch(edge=cols[0], between=cols[1], doc_id=cols[2], place=cols[3])

    return map_texts(texts, run, "edge long, between long, doc_id long, place long", extra=("anchors",))


def compact(edges: DataFrame) -> DataFrame:
    """Nonbranching paths of ``edges`` (edge, inner, source, place): head, tail, n_edges, whole (the exclusive or of all its edges), source.

    inner: all texts have the same edge before it and the same after it. An inner edge continues the inner
    edge that stands before it in the source; other edges are paths of their own.
    """
    inner = edges.filter("inner").select("source", (F.col("place") + 1).alias("place"))
    linked = edges.filter("inner").join(inner, ["source", "place"], "left_semi").select("edge", "source", "place", F.lit(0).alias("first"))
    others = edges.join(linked.select("edge"), "edge", "left_anti").select("edge", "source", "place", F.lit(1).alias("first"))
    marked = linked.unionByName(others)
    order = Window.partitionBy("source").orderBy("place", "edge")  # the edges of one document
    numbered = marked.withColumn("path", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min_by("edge", "place").alias("head"), F.max_by("edge", "place").alias("tail")
    return numbered.groupBy("source", "path").agg(*ends, F.count("*").cast("int").alias("n_edges"), F.bit_xor("edge").alias("whole")).drop("path")


def repeated_spans(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What each document repeats of documents with smaller ids.

    First: a row (doc_id, n_words, print, whole_sha256, copy) for each row; copy tells that all of its words,
    ``k`` at least, are those of a document with a smaller id. Second: for the others, (doc_id, spans) with
    spans an array of (at, n_edges, head, tail, whole): ``n_edges + k - 1`` words from word ``at`` on. Rows of
    one doc_id share their spans; the text tells which are its own.
    """
    sigs = materialize(signatures(docs, k, id_col, text_col))
    pairs = sigs.select("doc_id", "print", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.min("print").alias("least"), F.max("print").alias("most")).filter("least < most").select("anchor")
    lists = pairs.filter("doc_id is not null").select("anchor", "doc_id").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # texts of several documents only, and written: a join with a table can split what many copies have in common
    first = sigs.filter(f"n_words >= {k}").groupBy("print").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    first = materialize(first.filter("source < last").drop("last"))
    slim = sigs.select("doc_id", "n_words", "print", "whole_sha256")
    copy = F.coalesce(F.col("doc_id") > F.col("source"), F.lit(False)).alias("copy")
    marked = slim.filter(f"n_words >= {k}").join(first, "print", "left").select("doc_id", "n_words", "print", "whole_sha256", copy)
    plain = materialize(marked.unionByName(slim.filter(f"n_words < {k}").withColumn("copy", F.lit(False))))
    whole = plain.filter("doc_id is not null").groupBy("doc_id").agg(F.min("copy").alias("copies")).filter("copies").select("doc_id")
    lists = materialize(lists.join(whole, "doc_id", "left_anti"))
    discard(sigs, first)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(lists, "doc_id")
    found = materialize(candidate_edges(texts, k))
    inner = (F.min("between") == F.max("between")) & (F.min("between") != 0)
    edges = found.groupBy("edge").agg(inner.alias("inner"), F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place"))
    edges = materialize(edges.filter("source < last").drop("last"))
    paths = materialize(compact(edges))
    spans = found.select(F.col("edge").alias("head"), "doc_id", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")).join(paths, "head").filter("doc_id > source")
    spans = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n_edges", "head", "tail", "whole")).alias("spans")))
    discard(found, edges, paths, lists)
    return plain, spans


def removed_words(c: Chunk, k: int, spans: pa.ListArray) -> np.ndarray:
    """Which words of the chunk lie in one of its rows' spans that the text itself confirms."""
    n = len(c.starts)
    own = spans.slice(c.row, c.n)
    size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(own)
    if not len(flat) or n < k:
        return np.zeros(n, bool)
    at, edges, head, tail, whole = (np.asarray(flat.field(j)).astype(np.int64) for j in range(5))
    row = np.repeat(np.arange(c.n), size)
    h = signed(window_hash(c.word_hash(), k))
    so_far = np.concatenate([[0], np.bitwise_xor.accumulate(h)])
    begin = c.ptr[row] + at
    end = begin + edges
    good = np.flatnonzero(end + k - 1 <= c.ptr[row + 1])
    begin, end = begin[good], end[good]
    good = (h[begin] == head[good]) & (h[end - 1] == tail[good]) & (so_far[begin] ^ so_far[end] == whole[good])
    return cover(begin[good], (end - begin)[good] + k - 1, n)


def substring_dedup(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space between them)."""
    plain, spans = repeated_spans(docs, k, id_col, text_col)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).join(spans, "doc_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints, removed, sha = [], [], []
        for c in chunks(b.column(1)):
            gone = removed_words(c, k, b.column(2))
            removed.append(per_row(gone, c.ptr))
            sha += [x.hex() for x in digests(*joined(c, ~gone))]
            prints += [print_of(x) for x in digests(*joined(c, np.ones(len(c.starts), bool)))]
        return batch(doc_id=b.column(0), print=pa.array(prints, pa.int64()), n_removed=np.concatenate([np.zeros(0, np.int64), *removed]), kept_sha256=pa.array(sha, pa.string()))

    cut = map_texts(texts, run, "doc_id long, print long, n_removed long, kept_sha256 string", extra=("spans",)).filter("n_removed > 0").dropDuplicates(["doc_id", "print"])
    return plain.join(cut, ["doc_id", "print"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def remove_repeated(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that ``substring_dedup`` removes; documents left without a word by it go.

    What stood between a removed word and the next goes with it; other columns stay, n_chars follows the text.
    """
    plain, spans = repeated_spans(docs, k, id_col, text_col)
    own, marks = fresh(docs, "row_doc"), fresh(docs, "row_marks")
    copies = plain.filter("copy").groupBy("doc_id").agg(F.collect_set("print").alias("prints"))  # the texts of one document
    both = spans.join(copies, "doc_id", "full").select(F.col("doc_id").alias(own), F.struct("spans", "prints").alias(marks))
    marked = docs.join(both, docs[id_col].cast("long") == both[own], "left").drop(own)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        mark = b.column(b.schema.get_field_index(marks))
        spans, prints = pc.struct_field(mark, [0]), pc.struct_field(mark, [1]).to_pylist()
        b = b.drop_columns([marks])
        parts = []
        for c in chunks(b.column(b.schema.get_field_index(text_col))):
            gone = removed_words(c, k, spans)
            for r in range(c.n):
                if prints[c.row + r] and print_of(digests(*joined(*row_of(c, r)))[0]) in prints[c.row + r]:
                    gone[c.ptr[r] : c.ptr[r + 1]] = True
            parts.append((c, c.data, gone))
        return cut_rows(b, text_col, parts)

    return map_rows(marked, run, text_col, drop=(marks,))
