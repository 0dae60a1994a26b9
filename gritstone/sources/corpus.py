"""Readers and writers: code corpora, run logs, failure reports, study reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.scalars import normalize_hex

FAILURE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("input", T.StructType([T.StructField(n, T.StringType()) for n in ("contract", "seed", "passes")])),
        T.StructField("error_kind", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("obfuscated_bytecode", T.StringType()),
        T.StructField("trace_file", T.StringType()),
        T.StructField("logs", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

TRACE_SCHEMA = "struct<metadata:struct<transforms_applied:array<string>,size_limit_exceeded:boolean,unknown_opcodes_preserved:boolean>,trace:array<struct<kind:string,diff:string,remapped_pcs:map<string,bigint>>>>"


def write_packed(files: DataFrame, path: str) -> None:
    """Many small files (name, content) as rows of few Parquet files: a file system takes some milliseconds for each file of its own, and the driver lists and moves them."""
    files.select("name", F.col("content").cast("binary").alias("content")).write.parquet(path)


def read_code_corpus(spark: SparkSession, path: str, fmt: str = "auto", packed: bool = False) -> DataFrame:
    """Name, code from hex text (``hex``), raw bytes (``binary``) or either by what each file looks like (``auto``).

    auto: a file is hex text if its content begins with ``0x`` or its name ends with ``.hex``. ``packed``: the files are rows of
    ``path``, as ``write_packed`` writes them.
    """
    stored = spark.read.schema("name string, content binary").parquet(path) if packed else spark.read.format("binaryFile").load(path).withColumnRenamed("path", "name")
    files = stored.select("name", F.col("content").alias("raw"))
    text = F.decode("raw", "UTF-8")
    decoded = F.unhex(normalize_hex(text))
    if fmt == "hex":
        return files.select("name", decoded.alias("code"))
    if fmt == "binary":
        return files.select("name", F.col("raw").alias("code"))
    # bytes that are no text must not be decoded: 3078 are the bytes of 0x
    is_hex = F.hex(F.substring("raw", 1, 2)).eqNullSafe("3078") | F.col("name").endswith(".hex")
    return files.select("name", F.when(is_hex, F.unhex(normalize_hex(F.try_validate_utf8("raw")))).otherwise(F.col("raw")).alias("code"))


def read_trace_log(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """S3: run_id (the file), seq, kind, attrs, diff, remap from ``{metadata, trace[]}`` files; ``packed`` as for S1.

    A kind is a bare string or an object with one key, whose fields become ``attrs``.
    """
    if packed:
        texts = spark.read.schema("name string, content binary").parquet(path).select(F.col("name").alias("run_id"), F.decode("content", "UTF-8").alias("value"))
    else:
        texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), "value")
    raw = texts.select("run_id", F.from_json("value", TRACE_SCHEMA).alias("doc"))
    rows = raw.select("run_id", F.posexplode("doc.trace").alias("seq", "event"))
    tagged = F.from_json("event.kind", "map<string,string>")
    tag = F.map_keys(tagged)[0]
    attrs = F.from_json(F.map_values(tagged)[0], "map<string,string>")
    is_object = F.col("event.kind").startswith("{")
    return rows.select(
        "run_id",
        F.col("seq").cast("long").alias("seq"),
        F.when(is_object, tag).otherwise(F.col("event.kind")).alias("kind"),
        F.when(is_object, attrs).alias("attrs"),
        F.col("event.diff").alias("diff"),
        F.col("event.remapped_pcs").alias("remap"),
    )


def read_failure_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The readable ``crash_*.json`` reports, and a row (path, record) for each that could not be read."""
    every = spark.read.schema(FAILURE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "crash_*.json").json(path)
    every = every.withColumn("path", F.input_file_name())
    good = every.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull())
    bad = every.filter(F.col("_corrupt_record").isNotNull() | F.col("id").isNull())
    return good.drop("_corrupt_record", "path").withColumn("logs", F.coalesce("logs", F.array().cast("array<string>"))), bad.select("path", F.col("_corrupt_record").alias("record"))


def write_report(experiment_id: str, sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a study as Parquet under ``path/section``, partitioned by experiment_id; a repeated run replaces its own rows alone."""
    for name, df in sections.items():
        df.withColumn("experiment_id", F.lit(experiment_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(f"{path}/{name}")
