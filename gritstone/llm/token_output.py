"""Token ids packed best-fit-decreasing into fixed-size rows: id matrices, segment lengths, position resets.

Documents are encoded and cut losslessly where they lie. Their pieces, ids included, are dealt once to
shards by position, never by a key; the number of shards follows the bytes of text, so that a shard's
ids stay near ``shard_bytes``. In a shard, pieces go longest first into the open row with the least
room that is enough; a segment tree over the amounts of room finds it.

A null text is an empty one: the closing id alone. Repeated rows are packed like others, pieces of equal length in
order of document and piece; an empty table gives no rows. Texts of any length are cut losslessly; they are encoded a
slice of rows of about 1 MB at a time, a longer text as a slice of its own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_texts
from gritstone.llm._tokens import cut, default_tokenizer, encoder

SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class RoomTree:
    """Segment tree over amounts of room from 1 to ``size``: rows with that much room are counted at the leaves."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, need: int) -> int:
        """The smallest amount of room of at least ``need`` that some row has; 0 if none has."""
        node = self.base + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return 0
        while node < self.base:
            node *= 2
            if not self.count[node]:
                node += 1
        return node - self.base


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of each length, taken longest first and in order among equals."""
    tree, rows = RoomTree(size), {}
    row, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tree.least(need) if need < size else 0
        if room:
            own = rows[room].pop()
            tree.add(room, -1)
        else:
            own, room, used = used, size, used + 1
        row[k], offset[k] = own, size - room
        if room > need:
            rows.setdefault(room - need, []).append(own)
            tree.add(room - need, 1)
    return row, offset


def encoded(docs: DataFrame, size: int, tokenizer: str, end: int, kind: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, ids (little-endian) of every piece."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        doc, number, start, data, width = [], [], [], [], []
        for at, ids, ptr in encoder(tokenizer).rows(b.column(1), end):
            row, n, s, length = cut(ptr, size)
            for x, y in zip((doc, number, start, width), (at + row, n, s, length), strict=True):
                x.append(y)
            data.append(ids.astype(kind))  # pieces lie in order, without gaps
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        raw = np.concatenate([np.zeros(0, kind), *data])
        offsets = np.concatenate([[0], np.cumsum(join(width))]).astype(np.int32) * np.dtype(kind).itemsize
        ids = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        return batch(doc_id=b.column(0).take(pa.array(join(doc))), piece=join(number).astype(np.int32), start=join(start), ids=ids)

    return map_texts(docs, run, "doc_id long, piece int, start long, ids binary", id_col, text_col)


def packed_rows(
    docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end: int = 50256, pad: int = 50256, kind: str = "<u2", shard_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of the packed id matrix.

    sequence_id; n_tokens without padding; for each segment its doc_id, piece number and start in its
    document; cu_seqlens, the cumulative segment lengths from 0 to n_tokens; position_resets, where
    positions begin again at 0; input_ids, ``size`` ids of type ``kind``, filled up with ``pad``.
    """
    text_bytes = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    shards = 1 + int(text_bytes) // shard_bytes  # a token is seldom less than two bytes of text, and takes two
    rows = encoded(docs, size, tokenizer or default_tokenizer(), end, kind, id_col, text_col)
    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    item = np.dtype(kind).itemsize

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        ids = table["ids"].chunk(0) if table["ids"].num_chunks else pa.array([], pa.binary())
        where = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // item
        flat = np.frombuffer(ids.buffers()[2], kind)
        lengths = np.diff(where).astype(np.int64)
        row, offset = best_fit_decreasing(lengths, size)
        n = int(row.max()) + 1
        order = np.lexsort((offset, row))
        matrix = np.full(n * size, pad, kind)
        sizes = lengths[order]
        done = np.concatenate([[0], np.cumsum(sizes)])
        step = np.arange(done[-1])
        begin = row[order] * size + offset[order]
        matrix[np.repeat(begin - done[:-1], sizes) + step] = flat[np.repeat(where[:-1][order] - done[:-1], sizes) + step]
        segments = np.bincount(row, minlength=n)
        ptr = np.concatenate([[0], np.cumsum(segments)]).astype(np.int32)
        fill = np.bincount(row, lengths, minlength=n).astype(np.int32)
        resets = offset[order].astype(np.int32)
        take = table.take(pa.array(order))
        lists = lambda p, x: pa.ListArray.from_arrays(pa.array(p.astype(np.int32)), x)
        bounds = np.insert(resets, ptr[1:], fill)
        return pa.table(
            {
                "sequence_id": (table["shard"][0].as_py() << 32) + np.arange(n),
                "n_tokens": fill,
                "doc_ids": lists(ptr, take["doc_id"].combine_chunks()),
                "pieces": lists(ptr, take["piece"].combine_chunks()),
                "starts": lists(ptr, take["start"].combine_chunks()),
                "cu_seqlens": lists(ptr + np.arange(n + 1), pa.array(bounds)),
                "position_resets": lists(ptr, pa.array(resets)),
                "input_ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size * item).astype(np.int32).tobytes()), pa.py_buffer(matrix.tobytes())]),
            }
        )

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes ``packed_rows`` as Parquet files in ``path``; ``read_matrix`` gives a file's id matrix back."""
    packed_rows(docs, **options).write.parquet(path)


def read_matrix(table: pa.Table, kind: str = "<u2") -> np.ndarray:
    """The id matrix of a table of packed rows."""
    rows = table["input_ids"].to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 0), kind)


def position_ids(table: pa.Table, size: int) -> np.ndarray:
    """For each row, positions that begin again at every segment; padding goes on from the last."""
    out = np.tile(np.arange(size), (table.num_rows, 1))
    for k, resets in enumerate(table["position_resets"].to_pylist()):
        for at in resets[1:]:
            out[k, at:] = np.arange(size - at)
    return out
