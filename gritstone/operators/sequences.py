"""Operators over ordered rows of partitions: segments, depths, runs, markers, layouts. All are window functions; ``scans`` has W1, W2, W5, W7 and J7 for partitions that no task should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(part: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*part).orderBy(*order)


def so_far(part: Sequence[str], order: Sequence[str]):
    return over(part, order).rowsBetween(Window.unboundedPreceding, 0)


def segment(df: DataFrame, part: Sequence[str], order: Sequence[str], starts_at: Column, ends_after: Column, name: str = "segment") -> DataFrame:
    """Numbers segments from 0: one begins at each start marker and after each end marker; none is empty."""
    w = over(part, order)
    first = F.row_number().over(w) == 1
    new = first | F.coalesce(starts_at, F.lit(False)) | F.coalesce(F.lag(ends_after).over(w), F.lit(False))
    return df.withColumn(name, F.sum(new.cast("int")).over(so_far(part, order)) - 1)


def running_depth(df: DataFrame, part: Sequence[str], order: Sequence[str], delta: Column, floor: int = 0) -> DataFrame:
    """``depth`` never goes below ``floor``; by reflection, the running sum less its lowest value below the floor."""
    total = F.sum(delta).over(so_far(part, order))
    summed = df.withColumn("_sum", total).withColumn("_delta", delta)
    low = F.min("_sum").over(so_far(part, order))
    return summed.withColumn("depth", F.col("_sum") - F.least(F.lit(floor), low)).withColumn("at_rise", F.col("_delta") > 0).drop("_sum", "_delta")


def max_stack(df: DataFrame, part: Sequence[str], order: Sequence[str], delta: Column) -> DataFrame:
    """The largest depth seen at a rising row, 0 without one."""
    return running_depth(df, part, order, delta).groupBy(*part).agg(F.coalesce(F.max(F.when(F.col("at_rise"), F.col("depth"))), F.lit(0)).alias("max_stack"))


def cooccur_within(df: DataFrame, part: Sequence[str], order: Sequence[str], flags: Sequence[Column], n: int) -> DataFrame:
    """Whether some full window of n rows in a row has every flag."""
    w = over(part, order).rowsBetween(-(n - 1), 0)
    met = F.count(F.lit(1)).over(w) == n
    for f in flags:
        met &= F.max(F.coalesce(f, F.lit(False))).over(w)
    return df.withColumn("_met", met).groupBy(*part).agg(F.bool_or("_met").alias("cooccurs"))


def match_sequence(df: DataFrame, part: Sequence[str], order: Sequence[str], pattern: Sequence[Column], name: str = "matches") -> DataFrame:
    """Marks rows at which the conditions hold for the row and those that follow it, in order."""
    w = over(part, order)
    met = F.lit(True)
    for k, p in enumerate(pattern):
        met &= F.coalesce(F.lead(p, k).over(w) if k else p, F.lit(False))
    return df.withColumn(name, met)


def collapse_runs(df: DataFrame, part: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """One row for each run of one kind: its first and last place and length; ``single`` for a run of one."""
    w, each = over(part, order), over([*part, kind], order)
    island = F.row_number().over(w) - F.row_number().over(each)
    runs = df.withColumn("_no", F.row_number().over(w)).withColumn("_island", island).groupBy(*part, kind, "_island").agg(F.min("_no").alias("first"), F.max("_no").alias("last"), F.count("*").alias("length"))
    return runs.drop("_island").withColumn("single", F.col("length") == 1)


def group_by_markers(trace: DataFrame, part: Sequence[str], order: Sequence[str], start: Column, end: Column, name: Column, finalize: Column | None = None, compat: bool = True) -> DataFrame:
    """``group_no`` and ``group_name`` of each row: a group runs from a start marker to the next end marker.

    Rows outside form ``Setup``; with compat, later outside groups have an empty name. A finalize marker
    opens ``Finalize``, which does not close. With compat, the rows of a group that a start cuts off are
    dropped. A run without any marker is one group ``All Operations``.
    """
    w, run = over(part, order), so_far(part, order)
    fin = F.coalesce(finalize, F.lit(False)) if finalize is not None else F.lit(False)
    df = trace.withColumn("_s", F.coalesce(start, F.lit(False))).withColumn("_e", F.coalesce(end, F.lit(False))).withColumn("_f", fin)
    df = df.withColumn("_fin", F.max("_f").over(run))
    df = df.withColumn("_s", F.col("_s") & ~F.col("_fin")).withColumn("_e", F.col("_e") & ~F.col("_fin"))
    seq = F.row_number().over(w)
    df = df.withColumn("_no", seq)
    df = df.withColumn("_last_s", F.max(F.when(F.col("_s"), F.col("_no"))).over(run)).withColumn("_last_e", F.max(F.when(F.col("_e"), F.col("_no"))).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.col("_last_s").isNotNull() & (F.col("_last_e").isNull() | (F.col("_last_s") > F.col("_last_e"))) & ~F.col("_fin")
    df = df.withColumn("_in", inside)
    changed = (F.lag("_in").over(w) != F.col("_in")) | F.col("_s") | (F.lag("_fin").over(w) != F.col("_fin")) | (F.col("_no") == 1)
    df = df.withColumn("group_no", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(run) - 1)
    whole = Window.partitionBy(*part)
    marked = F.max(F.col("_s") | F.col("_e") | F.col("_f")).over(whole)
    outside_no = F.min(F.when(~F.col("_in") & ~F.col("_fin"), F.col("group_no"))).over(whole)
    title = F.last(F.when(F.col("_s"), name), ignorenulls=True).over(run)
    later = F.lit("") if compat else F.lit("Setup")
    label = F.when(~marked, F.lit("All Operations")).when(F.col("_fin"), F.lit("Finalize")).when(F.col("_in"), title).when(F.col("group_no") == outside_no, F.lit("Setup")).otherwise(later)
    out = df.withColumn("group_name", label)
    if compat:
        group = Window.partitionBy(*part, "group_no")
        out = out.withColumn("_open", F.col("_in") & ~F.max("_e").over(group)).withColumn("_more", F.max(F.when(F.col("_s"), F.col("_no"))).over(whole) > F.col("_no"))
        cut = F.col("_open") & F.coalesce(F.max(F.when(F.col("_s"), F.col("_no"))).over(whole) > F.max("_no").over(group), F.lit(False))
        out = out.withColumn("_cut", cut).filter(~F.col("_cut"))
    return out.drop("_s", "_e", "_f", "_fin", "_no", "_last_s", "_last_e", "_in", "_open", "_more", "_cut")


def relayout(df: DataFrame, part: Sequence[str], order: Sequence[str], size: str, offset: str = "new_offset") -> DataFrame:
    """Each row's offset if rows are laid end to end."""
    return df.withColumn(offset, F.coalesce(F.sum(size).over(over(part, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def validate_intervals(df: DataFrame, part: Sequence[str], start: str, size: str, total: str) -> DataFrame:
    """The first fault of each partition's intervals in order: overlap, gap, out of bounds, final gap, or ok; and its offset."""
    w = over(part, [start, size])
    end = F.col(start) + F.col(size)
    df = df.withColumn("_end", end)
    cursor = F.coalesce(F.lag("_end").over(w), F.lit(0))
    fault = F.when(F.col(start) < cursor, "overlap").when(F.col(start) > cursor, "gap").when(F.col("_end") > F.col(total), "out of bounds")
    rows = df.withColumn("_fault", fault).withColumn("_no", F.row_number().over(w)).withColumn("_cursor", cursor)
    at = F.when(F.col("_fault") == "gap", F.col("_cursor")).otherwise(F.col(start))
    one = rows.withColumn("_at", at).groupBy(*part).agg(
        F.min_by(F.when(F.col("_fault").isNotNull(), F.struct(F.col("_fault").alias("fault"), F.col("_at").alias("at"))), F.when(F.col("_fault").isNotNull(), F.col("_no"))).alias("_first"), F.max_by("_end", "_no").alias("_last"), F.max(total).alias("_total")
    )
    status = F.when(F.col("_first").isNotNull(), F.col("_first.fault")).when(F.col("_last") != F.col("_total"), "final gap").otherwise("ok")
    where = F.when(F.col("_first").isNotNull(), F.col("_first.at")).when(F.col("_last") != F.col("_total"), F.col("_last"))
    return one.select(*part, status.alias("status"), where.alias("at"))


def next_in_order(df: DataFrame, part: Sequence[str], order: str, name: str = "next") -> DataFrame:
    """W9."""
    return df.withColumn(name, F.lead(order).over(over(part, [order])))


def step_deltas(df: DataFrame, part: Sequence[str], order: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Change of each metric since the step before (0 at the first), whether any changed, and whether any has so far."""
    w = over(part, order)
    out = df
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.coalesce(F.col(m) - F.lag(m).over(w), F.lit(0)))
    changed = F.lit(False)
    for m in metrics:
        changed |= F.col(f"{m}_delta") != 0
    return out.withColumn("changed", changed).withColumn("any_changed", F.max("changed").over(so_far(part, order)))


def first_success(df: DataFrame, key: Sequence[str], order: Sequence[str], success: Column, max_attempts: int = 5) -> DataFrame:
    """The attempt that succeeds first within the budget; null and failed where none does."""
    tried = df.withColumn("_no", F.row_number().over(over(key, order))).withColumn("_ok", success).filter(F.col("_no") <= max_attempts)
    return tried.groupBy(*key).agg(F.min(F.when(F.col("_ok"), F.col("_no"))).alias("attempt"), F.count("*").alias("attempts")).withColumn("failed", F.col("attempt").isNull())


def first_match_in_prefix(df: DataFrame, part: Sequence[str], order: Sequence[str], patterns: Sequence[Sequence[Column]], limit: int = 200) -> DataFrame:
    """The earliest row (from 0) under ``limit`` at which one of the patterns begins; of several there, the first listed."""
    w = over(part, order)
    rows = df.withColumn("_no", F.row_number().over(w) - 1)
    which = F.lit(None).cast("int")
    for k in range(len(patterns) - 1, -1, -1):
        met = F.lit(True)
        for j, p in enumerate(patterns[k]):
            met &= F.coalesce(F.lead(p, j).over(w) if j else p, F.lit(False))
        which = F.when(met, F.lit(k)).otherwise(which)
    hits = rows.withColumn("_which", which).filter((F.col("_no") < limit) & F.col("_which").isNotNull())
    return hits.groupBy(*part).agg(F.min("_no").alias("at"), F.min_by("_which", "_no").alias("pattern"))


def section_text(lines: DataFrame, part: Sequence[str], order: str, line: str, ends_header: Column, function_marker: Column, key: Column | None = None, name: Column | None = None) -> DataFrame:
    """Sections of a text: header up to a marker line, storage up to the first function, functions, footer.

    A function runs from its marker line to where its braces close; one without a key is dropped and one
    without a name is ``Unresolved_<key>``. Columns: part, kind, section_no, key, name, first_line, n_lines, text.
    """
    run = so_far(part, [order])
    c = F.col(line)
    net = F.length(F.regexp_replace(c, r"[^{]", "")) - F.length(F.regexp_replace(c, r"[^}]", ""))
    df = lines.withColumn("_net", net).withColumn("_header_end", F.coalesce(ends_header, F.lit(False))).withColumn("_marker", F.coalesce(function_marker, F.lit(False)))
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_past_header", F.coalesce(F.max("_header_end").over(before), F.lit(False))).withColumn("_marker", F.col("_marker") & F.col("_past_header"))
    df = df.withColumn("_fn", F.sum(F.col("_marker").cast("int")).over(run))
    own = over([*part, "_fn"], [order]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_depth", F.sum("_net").over(own)).withColumn("_opened", F.max(F.col("_net") > 0).over(own))
    closed = F.col("_opened") & (F.col("_depth") <= 0)
    df = df.withColumn("_closed", F.coalesce(F.max(closed).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    kind = F.when(~F.col("_past_header"), "header").when(F.col("_fn") == 0, "storage").when(F.col("_closed"), "footer").otherwise("function")
    df = df.withColumn("kind", kind).withColumn("_key", key if key is not None else F.col("_fn").cast("string")).withColumn("_name", name if name is not None else F.lit(None).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), c.alias("v")))), lambda x: x["v"]), "\n")
    one = df.groupBy(*part, "kind", F.col("_fn").alias("section_no")).agg(
        F.max(F.when(F.col("_marker"), F.col("_key"))).alias("key"), F.max(F.when(F.col("_marker"), F.col("_name"))).alias("name"), F.min(order).alias("first_line"), F.count("*").alias("n_lines"), body.alias("text")
    )
    one = one.filter((F.col("kind") != "function") | F.col("key").isNotNull())
    is_function = F.col("kind") == "function"
    return one.withColumn("name", F.when(is_function, F.coalesce("name", F.concat(F.lit("Unresolved_"), "key")))).withColumn("key", F.when(is_function, F.col("key")))


def sequence_positions(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Place from 0 in the partition."""
    return df.withColumn(name, F.row_number().over(over(part, order)) - 1)


def first_last_state(trace: DataFrame, run: str, order: str, build: Column, finalize: Column, payload: str, mapping: str) -> DataFrame:
    """The last build and finalize payload of each run, and the mapping of the latter or else the former; runs without both have no row."""
    b, f = F.coalesce(build, F.lit(False)), F.coalesce(finalize, F.lit(False))
    one = trace.groupBy(run).agg(
        F.max_by(F.when(b, F.col(payload)), F.when(b, F.col(order))).alias("original"),
        F.max_by(F.when(f, F.col(payload)), F.when(f, F.col(order))).alias("final"),
        F.max_by(F.when(b, F.col(mapping)), F.when(b, F.col(order))).alias("_bm"),
        F.max_by(F.when(f, F.col(mapping)), F.when(f, F.col(order))).alias("_fm"),
        F.bool_or(b).alias("_has_b"),
        F.bool_or(f).alias("_has_f"),
    )
    return one.filter("_has_b and _has_f").select(run, "original", "final", F.coalesce("_fm", "_bm").alias("mapping"))


def tail_before_failure(df: DataFrame, part: Sequence[str], order: Sequence[str], is_failure: Column, n: int = 400) -> DataFrame:
    """The last n rows up to and with each failure; ``failure_no`` counts the partition's failures from 1, ``back`` the steps to it."""
    w = over(part, order)
    df = df.withColumn("_no", F.row_number().over(w)).withColumn("_fail", F.coalesce(is_failure, F.lit(False)))
    df = df.withColumn("_at", F.min(F.when(F.col("_fail"), F.col("_no"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    df = df.filter("_at is not null").withColumn("back", F.col("_at") - F.col("_no")).filter(F.col("back") < n)
    rank = Window.partitionBy(*part).orderBy("_at")
    return df.withColumn("failure_no", F.dense_rank().over(rank)).drop("_no", "_fail", "_at")
