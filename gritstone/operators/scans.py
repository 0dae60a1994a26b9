"""Running values of ordered groups of any size: rows are dealt by ranges, scanned within them, and corrected by what came before.

A window function puts a whole group in one task. Here a group's rows lie in as many ranges as they fill; each range
is scanned alone, a table of one row for each group and range carries what all earlier ranges give, and a join on (group, range)
adds it. Both forms give the same rows; the window form shuffles once and suits groups that fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.sources.scratch import cut_lineage


def dealt(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` by ranges of (part, order), written, with ``_id`` (ascending in that order, without gaps in a range) and ``_range``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *part, *order).sortWithinPartitions(*part, *order)
    return cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))


def scan(rows: DataFrame, part: Sequence[str], **columns: tuple[str, Column]) -> DataFrame:
    """Dealt rows with running columns, each (how, value): ``sum``, ``min``, ``max`` and ``last`` (that isn't null) up to and with the row, or ``lag``, the row before's."""
    own = Window.partitionBy(*part, "_range").orderBy("_id")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local = {"sum": lambda c: F.sum(c).over(run), "min": lambda c: F.min(c).over(run), "max": lambda c: F.max(c).over(run), "last": lambda c: F.last(c, True).over(run), "lag": lambda c: F.lag(F.struct(c.alias("v"))).over(own)}
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_id"))), "lag": lambda c: F.max_by(F.struct(c.alias("v")), "_id")}
    carried = {"sum": lambda c: F.sum(c).over(before), "min": lambda c: F.min(c).over(before), "max": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, True).over(before), "lag": lambda c: F.last(c).over(before)}
    joined = {
        "sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest, "last": F.coalesce, "lag": lambda a, b: F.coalesce(a, b)["v"],
    }
    names = list(rows.columns)
    ranges = rows.groupBy(*part, "_range").agg(*(whole[how](c).alias(f"_{k}") for k, (how, c) in columns.items()))
    carry = ranges.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(part)), F.col("_range").alias("_r"), *(carried[how](F.col(f"_{k}")).alias(f"_before_{k}") for k, (how, _) in columns.items()))
    scanned = rows.select(*names, *(local[how](c).alias(f"_own_{k}") for k, (how, c) in columns.items()))
    same = F.col("_range") == F.col("_r")
    for i, p in enumerate(part):
        same &= F.col(p).eqNullSafe(F.col(f"_p{i}"))
    return scanned.join(carry, same).select(*names, *(joined[how](F.col(f"_own_{k}"), F.col(f"_before_{k}")).alias(k) for k, (how, _) in columns.items()))


def gathered(rows: DataFrame) -> DataFrame:
    return rows.drop("_id", "_range")


def segments(df: DataFrame, part: Sequence[str], order: Sequence[str], starts_at: Column, ends_after: Column, name: str = "segment") -> DataFrame:
    """W1 for groups of any size."""
    false = F.lit(False)
    rows = dealt(df.withColumn("_start", F.coalesce(starts_at, false)).withColumn("_end", F.coalesce(ends_after, false)), part, order)
    rows = scan(rows, part, _ended=("lag", F.col("_end")))
    new = F.col("_ended").isNull() | F.col("_start") | F.col("_ended")  # no row before: the first
    rows = scan(rows.withColumn("_new", new.cast("int")), part, **{name: ("sum", F.col("_new"))})
    return gathered(rows).withColumn(name, F.col(name) - 1).drop("_start", "_end", "_ended", "_new")


def depths(df: DataFrame, part: Sequence[str], order: Sequence[str], delta: Column, floor: int = 0) -> DataFrame:
    """W2 for groups of any size."""
    rows = scan(dealt(df.withColumn("_delta", delta), part, order), part, _sum=("sum", F.col("_delta")))
    rows = gathered(scan(rows, part, _low=("min", F.col("_sum"))))
    return rows.withColumn("depth", F.col("_sum") - F.least(F.lit(floor), F.col("_low"))).withColumn("at_rise", F.col("_delta") > 0).drop("_sum", "_delta", "_low")


def runs(df: DataFrame, part: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """W5 for groups of any size."""
    rows = scan(dealt(df.select(*part, *order, kind), part, order), part, _kind=("lag", F.struct(F.col(kind).alias("k"))), _no=("sum", F.lit(1).cast("long")))
    new = F.col("_kind").isNull() | ~F.col("_kind.k").eqNullSafe(F.col(kind))
    rows = scan(rows.withColumn("_new", new.cast("int")), part, _run=("sum", F.col("_new")))
    one = rows.groupBy(*part, kind, "_run").agg(F.min("_no").alias("first"), F.max("_no").alias("last"), F.count("*").alias("length"))
    return one.drop("_run").withColumn("single", F.col("length") == 1)


def layout(df: DataFrame, part: Sequence[str], order: Sequence[str], size: str, offset: str = "new_offset") -> DataFrame:
    """W7 for groups of any size."""
    rows = scan(dealt(df, part, order), part, _end=("sum", F.coalesce(F.col(size), F.lit(0))))
    return gathered(rows).withColumn(offset, F.col("_end") - F.coalesce(F.col(size), F.lit(0))).drop("_end")


def moved_offsets(offsets: DataFrame, intervals: DataFrame, part: Sequence[str], at: str = "at") -> DataFrame:
    """J7 for groups of any size."""
    names = [c for c in offsets.columns if c not in part]
    one = intervals.select(*part, F.col("old").alias("_at"), F.lit(0).alias("_side"), F.struct("old", "size", "new").alias("_interval"))
    two = offsets.select(*part, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    rows = scan(dealt(one.unionByName(two, allowMissingColumns=True), part, ["_at", "_side"]), part, _last=("last", F.col("_interval"))).filter("_side = 1")
    moved = F.when(F.col("_at") < F.col("_last.old") + F.col("_last.size"), F.col("_last.new") + F.col("_at") - F.col("_last.old"))
    return rows.select(*part, "_row.*", moved.alias("moved"))


def quantiles(df: DataFrame, value: str, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """by and ``p``, an array: the exact quantiles of each group's values that aren't null, in between two of them where a point falls there.

    Values are dealt by ranges; counts of the ranges tell in which one, and where in it, the two ranks beside each point
    stand, and those rows alone are looked up. So no task holds a group.
    """
    values = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    rows = dealt(values, by, ["_x"])
    names = [f"_g{i}" for i in range(len(by))]
    ranges = rows.groupBy(*(F.col(b).alias(g) for b, g in zip(by, names, strict=True)), "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*names)
    before = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(w))
    place = [F.lit(p) * (F.col("_all") - 1) for p in points]
    wanted = F.array(*(F.struct(F.lit(k).alias("point"), f(at).cast("long").alias("rank"), (at - F.floor(at)).alias("part"), F.lit(side).alias("side")) for k, at in enumerate(place) for side, f in enumerate((F.floor, F.ceil))))
    asked = ranges.select(*names, "_first", "_before", "_n", F.explode(wanted).alias("q")).filter("q.rank >= _before and q.rank < _before + _n")
    found = asked.select(*names, (F.col("_first") + F.col("q.rank") - F.col("_before")).alias("_id"), "q.point", "q.part", "q.side").join(rows.select("_id", "_x"), "_id")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("_x")))
    each = found.groupBy(*names, "point").agg((side(0) + (side(1) - side(0)) * F.max("part")).alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))), lambda x: x["value"])  # as many as points
    return each.groupBy(*names).agg(ordered.alias("p")).select(*(F.col(g).alias(b) for b, g in zip(by, names, strict=True)), "p")
