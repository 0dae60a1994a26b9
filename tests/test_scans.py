"""Scans over ranges give what window functions give, whatever share of the rows one group has."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gritstone.operators import aggregates as A
from gritstone.operators import scans as S
from gritstone.operators import sequences as W

SCHEMA = "run_id long, seq long, kind string, value double, size long"


def log(spark, hot: int):
    rng = random.Random(hot)
    rows = [(1, k, rng.choice("SEabc"), rng.choice([None, float(rng.randint(-50, 50))]), rng.choice([None, 0, 3, 8])) for k in range(hot)]
    rows += [(rng.choice([2, 3, None]), 10_000 + k, rng.choice(["S", "E", "a", None]), float(k), k % 5) for k in range(60)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    rows = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.fixture(scope="module", params=[0, 3000])
def rows(spark, request):
    return log(spark, request.param).cache()


def test_segments(rows):
    args = (rows, ["run_id"], ["seq"], F.col("kind") == "S", F.col("kind") == "E")
    same(S.segments(*args), W.segment(*args))


def test_depths(rows):
    delta = F.when(F.col("kind") == "a", 1).when(F.col("kind").isin("b", "c"), -1).otherwise(0)
    same(S.depths(rows, ["run_id"], ["seq"], delta), W.running_depth(rows, ["run_id"], ["seq"], delta))
    same(S.depths(rows, ["run_id"], ["seq"], delta, 2), W.running_depth(rows, ["run_id"], ["seq"], delta, 2))


def test_runs(rows):
    same(S.runs(rows, ["run_id"], ["seq"], "kind"), W.collapse_runs(rows, ["run_id"], ["seq"], "kind"))


def test_layout(rows):
    sized = rows.withColumn("size", F.coalesce("size", F.lit(0)))
    same(S.layout(sized, ["run_id"], ["seq"], "size"), W.relayout(sized, ["run_id"], ["seq"], "size"))


def test_moved_offsets(spark, rows):
    from gritstone.operators import joins as J

    offsets = rows.select("run_id", "seq", (F.col("seq") * 3).alias("at"))
    intervals = rows.filter("kind = 'a'").select("run_id", (F.col("seq") * 3 - 4).alias("old"), F.coalesce("size", F.lit(2)).alias("size"), (F.col("seq") * 100).alias("new"))
    same(S.moved_offsets(offsets, intervals, ["run_id"]), J.remap_offsets(offsets, intervals, ["run_id"]))


def test_last_and_extremes(rows):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    want = rows.select("*", F.last(v, True).over(run).alias("l"), F.min(v).over(run).alias("lo"), F.max(v).over(run).alias("hi"), F.lag(v).over(w).alias("prior"), F.sum(v).over(run).alias("total"))
    got = S.scan(S.dealt(rows, ["run_id"], ["seq"]), ["run_id"], l=("last", v), lo=("min", v), hi=("max", v), prior=("lag", v), total=("sum", v))
    same(S.gathered(got), want)


def test_one_group_is_spread(spark):
    """One run with all rows: no range, and so no task of the scan, has more than half of it."""
    one = spark.range(4000).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"))
    shares = S.dealt(one, ["run_id"], ["seq"]).groupBy("_range").count().collect()
    assert len(shares) >= 3 and max(r["count"] for r in shares) < 2000


@pytest.mark.parametrize("by", [[], ["kind"]])
def test_quantiles_are_exact(spark, rows, by):
    got = {tuple(r[b] for b in by): r for r in A.distribution_summary(rows, "value", 10.0, by).collect()}
    want = {tuple(r[b] for b in by): r for r in rows.groupBy(*by).agg(F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95)))).alias("p"), F.count("value").alias("n")).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["n"] == r["n"]
        assert [got[k][c] for c in ("p25", "median", "p75", "p95")] == (pytest.approx(r["p"]) if r["p"] else [0.0] * 4)


def test_quantiles_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(7.0,)] * 500 + [(1.0,), (9.0,), (None,)], "v double")
    r = A.distribution_summary(rows, "v", 0).first()
    values = [1.0] + [7.0] * 500 + [9.0]
    assert (r["n"], r["p25"], r["median"], r["p95"], r["ratio"]) == (502, 7.0, statistics.median(values), 7.0, 0.0)
    nothing = A.distribution_summary(rows.filter("v > 100"), "v", 5).collect()
    assert len(nothing) == 1 and nothing[0]["n"] == 0 and nothing[0]["median"] == 0.0
    assert A.distribution_summary(rows.filter("v > 100").withColumn("g", F.lit(1)), "v", 5, ["g"]).count() == 0
