"""Scratch tables and batch plumbing shared by the operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


SLICE = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("gritstone.scratch", None)
        if not folder:
            master = spark.conf.get("spark.master", "")
            if not re.fullmatch(r"local(\[[^\]]*\])?", master):
                raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-gritstone-")
            spark.conf.set("gritstone.scratch", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps start from files that survive a lost executor.

    Afterwards the driver's JVM is asked to collect garbage, as Spark removes the files of finished
    shuffles only once the driver has dropped the plans that used them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gritstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialize`` wrote and nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path.rpartition("/")[2].startswith("gritstone-"):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Freed memory goes back to the system, as workers stay for other operators and share a machine with a JVM."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(b: pa.RecordBatch, text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows of about ``size`` bytes in its ``text``-th column (one row at least), without a copy."""
    column, n = b.column(text), b.num_rows
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    where = column.buffers()[1]
    if not n or where is None:
        yield b
        return
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, int(offsets[row]) + size, "right")) - 1)
        yield b.slice(row, stop - row)
        row = stop


def map_texts(
    docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()
) -> DataFrame:
    """Runs ``fn`` over slices of Arrow batches of the id and text columns alone (renamed ``doc_id`` and ``text``).

    Each slice has an output batch of its own, so that a task holds one incoming batch and the work on a slice.
    """
    narrow = docs.select(docs[quoted(id_col)].cast("long").alias("doc_id"), docs[quoted(text_col)].alias("text"), *(docs[quoted(c)].alias(c) for c in extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = fn(part)
                if out is not None:
                    yield out
            give_back()

    return narrow.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column name as Spark reads it whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Runs ``fn`` over slices of whole rows and keeps the schema but for columns named in ``drop``; rows may be left out or have a new text.

    Columns go to Python by number, so that names with dots and the like are no matter.
    """
    names = docs.columns
    at = names.index(text_col)
    left = [f for f in docs.schema.fields if f.name not in drop]
    schema = StructType([StructField(f"_{k}", f.dataType, f.nullable) for k, f in enumerate(left)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(names)
            for part in slices(batch, at):
                out = fn(part)
                yield out.rename_columns([f"_{k}" for k in range(out.num_columns)])
            give_back()

    return docs.toDF(*(f"_{k}" for k in range(len(names)))).mapInArrow(run, schema).toDF(*(f.name for f in left))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def with_text(b: pa.RecordBatch, texts: pa.Array, text_col: str = "text", count_col: str = "n_chars") -> pa.RecordBatch:
    """``b`` with another text column, and the length in characters beside it if ``b`` has one."""
    names = b.schema.names
    columns = list(b.columns)
    at = names.index(text_col)
    columns[at] = texts.cast(b.schema.field(at).type)
    if count_col in names:
        at = names.index(count_col)
        columns[at] = pc.utf8_length(texts).cast(b.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (id, comp) for each node, comp the smallest id reachable.

    Each round takes the smallest label among the neighbours and then follows labels of labels, so the
    number of rounds follows the logarithm of the longest path. Labels are written to the shared folder
    each round; what a round has read is removed after it.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("comp", "other").alias("next"), F.col("comp").alias("old"))
        hop = labels.select(F.col("id").alias("next"), F.col("comp").alias("via"))
        step = materialize(new.join(hop, "next").select("id", "old", F.least("next", "via").alias("comp")))
        done = step.filter("old <> comp").isEmpty()
        discard(labels)
        labels = step.select("id", "comp")
        if done:
            discard(both)
            return labels
