"""Driver tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(text: Column) -> Column:
    """SHA-256 of each piece of 32 characters of a text, the last one shorter: hex digits, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,32}"), F.lit(0)), lambda x: F.sha2(x, 256))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_id, code: the digests of each document's ``pieces``, one after the other: a code as long as the text; null for a null text, empty for an empty one."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"), F.unhex(F.array_join(pieces(F.col("text")), "")).alias("code"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, line_no (from 0), line."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def snapshot_b(orders: DataFrame) -> DataFrame:
    """A later version of ``orders``: every 7th key gone, every 11th price raised by a tenth, every 13th key moved by 10,000,000."""
    key = F.col("o_orderkey")
    return orders.filter(key % 7 != 0).select(
        F.when(key % 13 == 0, key + 10_000_000).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        "o_orderstatus",
        F.when(key % 11 == 0, F.round(F.col("o_totalprice") * 1.1, 2)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )


def snapshot_map(orders: DataFrame) -> DataFrame:
    """key, token: the moved keys of ``snapshot_b``."""
    key = F.col("o_orderkey")
    return orders.filter((key % 13 == 0) & (key % 7 != 0)).select(key.alias("key"), (key + 10_000_000).alias("token"))


def run_log(events: DataFrame) -> DataFrame:
    """``events`` as a log: run_id, seq (total order), kind, value, ts, props."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("run_id"), F.row_number().over(order).alias("seq"), F.col("event_type").alias("kind"), "value", "ts", "props", "event_id")
