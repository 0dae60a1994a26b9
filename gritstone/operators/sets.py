"""Sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.operators.joins import paired_diff


def ordered_extract(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """O1: all rows in order, by a range-partitioned sort."""
    return df.orderBy(*order)


def head(df: DataFrame, order: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """O2: the first n rows, and a row with how many more there are."""
    return df.orderBy(*order).limit(n), df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def signed_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that do not stand as often in both tables, and ``_over``: how often more in ``a`` (negative: in ``b``). One aggregation of both."""
    both = a.withColumn("_over", F.lit(1)).unionByName(b.withColumn("_over", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_over").alias("_over")).filter("_over <> 0")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """O3: rows, counted as often as they stand there, that one side has more of: side (a, b)."""
    over = signed_counts(a, b)
    times = F.sequence(F.lit(1), F.abs("_over"))
    return over.withColumn("side", F.when(F.col("_over") > 0, "a").otherwise("b")).withColumn("_time", F.explode(times)).drop("_over", "_time")


def dedup_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def only_in(a: DataFrame, b: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """The unmatched sides of a paired diff: key, kind (removed, added)."""
    return paired_diff(a, b, mapping, key).filter("kind <> 'paired'").select(F.coalesce("key_a", "key_b").alias("key"), "kind")
