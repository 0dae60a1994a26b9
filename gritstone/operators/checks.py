"""Table checks: equivalence, divergence, rule suites, bounds, determinism, interval properties."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import deploy_cost, payload_cost, pct_increase
from gritstone.operators.sequences import running_depth
from gritstone.operators.sets import signed_counts
from gritstone.sources.scratch import cut_lineage

ROWS_A_TASK = 250_000


def row_hash(columns: Sequence[str], salt: int) -> Column:
    """A 64-bit hash of a row; nulls count by their place."""
    return F.xxhash64(F.lit(salt), *columns, *(F.col(c).isNull() for c in columns))


def differing(a: DataFrame, b: DataFrame, key: Sequence[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in buckets of ``key`` whose digests differ.

    A bucket's digest is its number of rows and the sums of two hashes of each, so tasks send one row a bucket and equal
    tables shuffle nothing else; two buckets that differ have one digest by a chance of 2^-128. Only the numbers of buckets that
    differ, ``buckets`` at most, go to all tasks.
    """
    columns = a.columns
    bucket = F.pmod(row_hash(key, 0), F.lit(buckets))
    sums = lambda salt: F.sum(row_hash(columns, salt).cast("decimal(20,0)")).cast("string")
    digest = lambda df: df.select(columns).groupBy(bucket.alias("_bucket")).agg(F.struct(F.count("*"), sums(1), sums(2)).alias("_digest"))
    both = digest(a).join(digest(b).withColumnRenamed("_digest", "_other"), "_bucket", "full_outer")
    found = F.broadcast(cut_lineage(both.filter(~F.col("_digest").eqNullSafe(F.col("_other"))).select("_bucket")))
    part = lambda df: df.select(columns).withColumn("_bucket", bucket).join(found, "_bucket", "left_semi").drop("_bucket")
    return part(a), part(b)


def tables_equivalent(a: DataFrame, b: DataFrame, buckets: int = 65_536) -> DataFrame:
    """V1: only_a, only_b (rows by multiplicity) and equivalent. Rows meet in one shuffle, those alone whose bucket differs."""
    over = signed_counts(*differing(a, b, a.columns, buckets))
    more = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0))), F.lit(0))
    return over.agg(more(F.col("_over")).alias("only_a"), more(-F.col("_over")).alias("only_b")).withColumn("equivalent", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def first_divergence(a: DataFrame, b: DataFrame, key: str, step: str, payload: Sequence[str], buckets: int = 65_536) -> DataFrame:
    """V2: for each key that differs, the first step at which a row differs or is missing on one side; only keys of buckets that differ are joined."""
    names = [key, step, *payload]
    a, b = differing(a.select(names), b.select(names), [key], buckets)
    x = a.select(key, step, F.struct(*payload).alias("_x"))
    y = b.select(key, step, F.struct(*payload).alias("_y"))
    return x.join(y, [key, step], "full_outer").filter(~F.col("_x").eqNullSafe(F.col("_y"))).groupBy(key).agg(F.min(step).alias("step"))


def rule_suite(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """V3: check_type, description, violations, passed for rules (type, description, row condition): one pass over the table; a null condition is a violation."""
    one = df.agg(*(F.count_if(~F.coalesce(cond, F.lit(False))).alias(f"v{k}") for k, (_, _, cond) in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(kind).alias("check_type"), F.lit(text).alias("description"), F.col(f"v{k}").alias("violations")) for k, (kind, text, _) in enumerate(rules)))
    return one.select(F.inline(rows)).withColumn("passed", F.col("violations") == 0)


def no_reentry(df: DataFrame, part: Sequence[str], order: Sequence[str], enters: Column, leaves: Column, description: str = "no re-entry") -> DataFrame:
    """V3, forbidden re-entry: one result row; a row that enters while its partition is inside already is a violation."""
    delta = F.when(F.coalesce(enters, F.lit(False)), 1).when(F.coalesce(leaves, F.lit(False)), -1).otherwise(0)
    one = running_depth(df, part, order, delta).agg(F.count_if(F.col("at_rise") & (F.col("depth") > 1)).alias("violations"))
    return one.select(F.lit("re-entry").alias("check_type"), F.lit(description).alias("description"), "violations", (F.col("violations") == 0).alias("passed"))


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """V3 on two tables' results: a property is preserved iff both pass."""
    keys = ["check_type", "description"]
    return before.select(*keys, F.col("passed").alias("passed_before")).join(after.select(*keys, F.col("passed").alias("passed_after")), keys).withColumn("preserved", F.col("passed_before") & F.col("passed_after"))


def ratio_bound(a: DataFrame, b: DataFrame, key: str, value: str, limit: float = 1.15) -> DataFrame:
    """V4: compared keys, violators of ``b <= limit * a``, the worst ratio, and holds."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("y") > F.lit(limit) * F.col("x")).alias("violators"), F.max(F.try_divide("y", "x")).alias("worst")).withColumn("holds", F.col("violators") == 0)


def table_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash of a table."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def determinism_check(job: Callable[[str], DataFrame], seed: str, other_seed: str, original: DataFrame | None = None) -> DataFrame:
    """V5: same_seed_equal, other_seed_differs, changed (the result is not the original)."""
    one, two, three = (table_hash(job(s)).select(F.struct("*").alias(n)) for s, n in ((seed, "a"), (seed, "b"), (other_seed, "c")))
    rows = one.crossJoin(two).crossJoin(three)  # one row each
    out = [(F.col("a") == F.col("b")).alias("same_seed_equal"), (F.col("a") != F.col("c")).alias("other_seed_differs")]
    if original is not None:
        rows = rows.crossJoin(table_hash(original).select(F.struct("*").alias("o")))
        out.append((F.col("a") != F.col("o")).alias("changed"))
    return rows.select(*out)


def before_after_report(pairs: DataFrame, key: str, before_bytes: str, after_bytes: str, zero_before: str, zero_after: str, equivalent: Column, deterministic: Column, max_increase: float = 100.0) -> DataFrame:
    """V6: costs before and after, their increase in percent, and the flags with their conjunction."""
    x = payload_cost(F.col(zero_before), F.col(before_bytes) - F.col(zero_before))
    y = payload_cost(F.col(zero_after), F.col(after_bytes) - F.col(zero_after))
    rows = pairs.withColumn("cost_before", x).withColumn("cost_after", y).withColumn("increase", pct_increase(F.col("cost_before"), F.col("cost_after")))
    rows = rows.withColumn("bounded", F.col("increase") <= max_increase).withColumn("equivalent", equivalent).withColumn("deterministic", deterministic)
    return rows.select(key, "cost_before", "cost_after", "increase", "bounded", "equivalent", "deterministic", (F.col("bounded") & F.col("equivalent") & F.col("deterministic")).alias("ok"))


def size_cost_report(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Bytes before and after, delta, deploy costs, their delta, percent, and a note."""
    b, a = F.col(before), F.col(after)
    note = F.when(a > b, "larger").when(a < b, "smaller").otherwise("unchanged")
    return pairs.select(key, b.alias("bytes_before"), a.alias("bytes_after"), (a - b).alias("delta"), deploy_cost(b).alias("cost_before"), deploy_cost(a).alias("cost_after"), (deploy_cost(a) - deploy_cost(b)).alias("cost_delta"), pct_increase(b, a).alias("percent"), note.alias("note"))


def size_cost_counts(report: DataFrame) -> DataFrame:
    """How many pairs there are, grew, shrank and stayed, over a ``size_cost_report``, with summed deltas."""
    note = lambda n: F.count_if(F.col("note") == n).alias(n)
    return report.agg(F.count("*").alias("pairs"), note("larger"), note("smaller"), note("unchanged"), F.coalesce(F.sum("delta"), F.lit(0)).alias("delta"), F.coalesce(F.sum("cost_delta"), F.lit(0)).alias("cost_delta"))


def as_documents(df: DataFrame, key: str, name: str = "document") -> DataFrame:
    """Key, and each row as a JSON document."""
    return df.select(key, F.to_json(F.struct("*")).alias(name))


def interval_properties(sections: DataFrame, totals: DataFrame, by: str = "code_id") -> DataFrame:
    """V7: ten properties of each code's sections; totals: by, size.

    Sections are dealt by code to as many tasks as their number asks for, so a task's memory does not grow with the table.
    """
    tasks = sections.count() // ROWS_A_TASK + 1
    sections = sections.repartition(tasks, by)
    totals = totals.select(by, "size").repartition(tasks, by).distinct()
    w = Window.partitionBy(by).orderBy("offset", "len")
    end = F.col("offset") + F.col("len")
    rows = sections.withColumn("_end", end).withColumn("_prior", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_kind_before", F.lag("kind").over(w)).withColumn("_no", F.row_number().over(w))
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    one = rows.groupBy(by).agg(
        F.bool_and(F.col("_prior").isNull() | (F.col("offset") >= F.col("_prior"))).alias("no_overlap"),
        F.sum("len").alias("_sum"),
        F.bool_and(F.coalesce("_prior", F.lit(0)) == F.col("offset")).alias("in_order"),
        F.bool_and(F.col("len") > 0).alias("non_empty"),
        (F.count_if(F.col("kind") == "Runtime") == 1).alias("one_runtime"),
        F.coalesce(at("Init", F.col("offset")) == 0, F.lit(True)).alias("init_first"),
        F.coalesce(at("Auxdata", F.col("_end")), F.lit(-1)).alias("_aux_end"),
        F.max("_end").alias("_end"),
        F.bool_and((F.col("kind") != "ConstructorArgs") | F.col("_kind_before").eqNullSafe(F.lit("Runtime"))).alias("args_after_runtime"),
        F.bool_and((F.col("kind") != "Padding") | F.col("_kind_before").eqNullSafe(F.lit("Runtime"))).alias("padding_after_runtime"),
        (F.count_distinct("kind") == F.count("*")).alias("unique_kinds"),
    )
    both = one.join(totals, by)
    return both.select(by, "no_overlap", (F.col("no_overlap") & (F.col("_sum") == F.col("size"))).alias("full_cover"), "in_order", "non_empty", "one_runtime", "init_first", ((F.col("_aux_end") == -1) | (F.col("_aux_end") == F.col("_end"))).alias("trailer_last"), "args_after_runtime", "padding_after_runtime", "unique_kinds")
