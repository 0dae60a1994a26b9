"""Aggregations over corpora and run logs. Every one combines partially before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gritstone.functions.windows import Characters, over_texts, unique_pairs
from gritstone.operators.scans import quantiles
from gritstone.sources.scratch import cut_lineage

BUCKET = 1 << 23  # bytes of texts whose windows share a bucket


def unknown_stats(instr: DataFrame, unknown: Column, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, unknown rows and distinct unknown kinds."""
    return instr.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(unknown).alias("unknown"), F.count_distinct(F.when(unknown, F.col(kind))).alias("unknown_kinds"))


def distribution_summary(df: DataFrame, value: str, base: float, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """A1: count, mean, median, sample deviation, extremes, interpolated percentiles, mean as percent of ``base``; zeros for no rows.

    Percentiles are exact, by ranks over ranges (``scans.quantiles``), so a group of any size is spread over tasks; with
    ``accuracy`` they are values of the data whose rank is wrong by at most 1 / accuracy of the group, from a sketch of bounded size.
    """
    x = F.col(value).cast("double")
    points = (0.25, 0.5, 0.75, 0.95)
    zero = F.lit(0.0)
    sketch = [] if accuracy is None else [F.percentile_approx(x, F.array(*map(F.lit, points)), accuracy).alias("p")]
    one = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *sketch)
    if accuracy is None:
        p = quantiles(df, value, by, points)
        p = p.select(*(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)), "p")
        same = F.lit(True)
        for i, b in enumerate(by):
            same &= F.col(b).eqNullSafe(F.col(f"_g{i}"))
        one = one.join(p, same, "left")  # without ``by`` one row each
    picked = [F.coalesce(F.get("p", k), zero).alias(name) for k, name in enumerate(("p25", "median", "p75", "p95"))]
    rest = [F.coalesce(c, zero).alias(c) for c in ("mean", "std", "min", "max")]
    ratio = F.when(F.lit(base) == 0, zero).otherwise(F.coalesce(F.col("mean"), zero) / F.lit(float(base) or 1.0) * 100)
    return one.select(*by, "n", *rest, *picked, ratio.alias("ratio"))


def weighted_summary(df: DataFrame, value: str, times: str, base: float) -> DataFrame:
    """A1 of whole numbers that stand as often as ``times`` says, exact; one row. Distinct values are few enough for one task, as lengths are."""
    kinds = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("x")).agg(F.sum(times).alias("t"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = kinds.withColumn("upto", F.sum("t").over(upto)).withColumn("all", F.sum("t").over(Window.partitionBy()))

    def point(p: float, name: str) -> list[Column]:
        place = F.lit(p) * (F.col("all") - 1)
        return [*(F.min(F.when(F.col("upto") > f(place), F.col("x"))).alias(f"{name}_{side}") for side, f in enumerate((F.floor, F.ceil))), F.max(place - F.floor(place)).alias(f"{name}_part")]

    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    exact = lambda c: c.cast("decimal(38,0)")
    x, t = exact(F.col("x")), F.col("t")
    one = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), exact(F.sum(x * t)).alias("s1"), exact(F.sum(x * x * t)).alias("s2"), F.min("x").alias("min"), F.max("x").alias("max"), *(c for name, p in points.items() for c in point(p, name)))
    n, s1 = F.col("n").cast("double"), F.col("s1").cast("double")
    spread = exact(F.col("n")) * F.col("s2") - F.col("s1") * F.col("s1")
    std = F.when(F.col("n") > 1, F.sqrt(spread.cast("double") / n / (n - 1)))
    zero = F.lit(0.0)
    mean = F.coalesce(F.when(F.col("n") > 0, s1 / n), zero)
    picked = [F.coalesce(F.col(f"{k}_0") + (F.col(f"{k}_1") - F.col(f"{k}_0")) * F.col(f"{k}_part"), zero).alias(k) for k in points]
    ratio = zero if base == 0 else mean / F.lit(float(base)) * 100
    return one.select("n", mean.alias("mean"), F.coalesce(std, zero).alias("std"), *(F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("min", "max")), *picked, ratio.alias("ratio"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """A2: start, end, n of the buckets that are not empty; width max(1, floor((max - min) / 10)), aligned at the minimum."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / 10))
    rows = df.select(value).crossJoin(F.broadcast(bounds.select("lo", width.alias("width")).filter("lo is not null")))  # one row
    start = F.col("lo") + F.floor((F.col(value) - F.col("lo")) / F.col("width")) * F.col("width")
    return rows.filter(F.col(value).isNotNull()).groupBy(start.alias("start"), "width").agg(F.count("*").alias("n")).select("start", (F.col("start") + F.col("width") - 1).alias("end"), "n")


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """A3: the k most frequent keys; ties go to the longer key, then to the smaller."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(F.length(key)), key).limit(k)


def ngram_diversity(df: DataFrame, col: str, ns: Sequence[int] = (2, 4, 8), by: Sequence[str] = (), approx: bool = False, times: str | None = None) -> DataFrame:
    """A4: for each n, windows of n characters in all texts, distinct ones, and these in percent (0 without windows). A text counts as often as ``times`` says, once if that is not given.

    One pass over the texts gives, for each slice of them, how many windows there are and the distinct ones as
    64-bit hashes. These are sorted and cut by their first bits into buckets, so a row holds many of them as bytes; the rows of a
    bucket meet in one shuffle. There are as many buckets as the texts' bytes ask for. ``approx`` has a row for each hash.
    """
    names, sizes = list(by), [n for n in ns if n > 0]
    groups = df.select(F.col(col).alias("_text"), F.struct(F.lit(0).alias("_all"), *by).alias("_group"), F.lit(1).cast("long").alias("_times") if times is None else F.col(times).cast("long").alias("_times"))
    coded = groups.select("_text", F.to_json("_group").alias("_group"), "_times")  # one string for a group, nulls left out

    def run(b: pa.RecordBatch, c: Characters) -> pa.RecordBatch:
        group = b.column(1).dictionary_encode()
        code, often = group.indices.to_numpy(), b.column(2).to_numpy()
        out = []
        for n in sizes:
            at, gram = c.windows(n)
            own = code[c.row[at]]
            total = np.bincount(own, often[c.row[at]], len(group.dictionary)).astype(np.int64)
            first = unique_pairs(own, gram)
            kinds = np.arange(len(total))
            out.append((np.concatenate([kinds, own[first]]), np.full(len(total) + len(first), n), np.concatenate([total, np.zeros(len(first), np.int64)]), gram[first].view(np.int64), len(total)))
        code, size, windows = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(3))
        grams = pa.array([], pa.int64()) if not out else pa.concat_arrays([y for x in out for y in (pa.nulls(x[4], pa.int64()), pa.array(x[3]))])
        return pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(code)), pa.array(size, pa.int32()), pa.array(windows, pa.int64()), grams], ["_group", "n", "windows", "gram"])

    def pack(b: pa.RecordBatch, c: Characters) -> pa.RecordBatch:
        group = b.column(1).dictionary_encode()
        code, often = group.indices.to_numpy(), b.column(2).to_numpy()
        out = []
        for n in sizes:
            at, gram = c.windows(n)
            own = code[c.row[at]]
            total = np.bincount(own, often[c.row[at]], len(group.dictionary))
            order = np.argsort(own, kind="stable") if len(total) > 1 else slice(None)
            ends = np.cumsum(np.bincount(own, minlength=len(total)))
            for k, part in enumerate(np.split(gram[order], ends[:-1])):
                kinds = np.unique(part)
                where = kinds >> np.uint64(64 - bits) if bits else np.zeros(len(kinds), np.uint64)
                first = np.flatnonzero(np.diff(where, prepend=where[:1] + np.uint64(1)))
                out.append((k, n, 0, int(total[k]), b""))
                out += [(k, n, int(where[i]), 0, x.tobytes()) for i, x in zip(first, np.split(kinds, first[1:]), strict=True) if len(x)] if len(kinds) else []
        kind, size, bucket, windows, grams = zip(*out, strict=True) if out else ((),) * 5
        return pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(kind, pa.int64())), *(pa.array(x, t) for x, t in ((size, pa.int32()), (bucket, pa.int32()), (windows, pa.int64()), (grams, pa.binary())))], ["_group", "n", "bucket", "windows", "grams"])

    def merge(t: pa.Table) -> pa.Table:
        kinds = np.unique(np.frombuffer(b"".join(t["grams"].to_pylist()), np.uint64))
        return pa.table({"_group": t["_group"][:1], "n": t["n"][:1], "windows": pa.array([pc.sum(t["windows"]).as_py()], pa.int64()), "kinds": pa.array([len(kinds)], pa.int64())})

    every = coded.select("_group").distinct() if by else df.sparkSession.range(1).select(F.to_json(F.struct(F.lit(0).alias("_all"))).alias("_group"))
    every = every.select("_group", F.explode(F.array(*map(F.lit, ns))).alias("n"))
    if not approx:
        octets = coded.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        bits = (octets // BUCKET).bit_length()
        packed = over_texts(coded, pack, "_group string, n int, bucket int, windows long, grams binary", 0)
        merged = packed.groupBy("_group", "n", "bucket").applyInArrow(merge, "_group string, n int, windows long, kinds long")
        counts = merged.groupBy("_group", "n").agg(F.sum("windows").alias("windows"), F.sum("kinds").alias("distinct_windows"))
        return diversity_of(every.join(counts, ["_group", "n"], "left"), df, names)
    found = cut_lineage(over_texts(coded, run, "_group string, n int, windows long, gram long", 0))
    totals = found.filter("gram is null").groupBy("_group", "n").agg(F.sum("windows").alias("windows"))
    kinds = found.filter("gram is not null").groupBy("_group", "n").agg(F.approx_count_distinct("gram").alias("distinct_windows"))
    return diversity_of(every.join(totals, ["_group", "n"], "left").join(kinds, ["_group", "n"], "left"), df, names)


def diversity_of(both: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    values = F.from_json("_group", StructType([StructField("_all", IntegerType()), *(df.schema[c] for c in names)]))
    one = both.withColumn("_g", values).select(*(F.col("_g")[c].alias(c) for c in names), "n", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("distinct_windows", F.lit(0)).alias("distinct_windows"))
    return one.withColumn("diversity", F.when(F.col("windows") == 0, F.lit(0.0)).otherwise(F.col("distinct_windows") * 100.0 / F.col("windows")))


def min_avg_max(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A5."""
    return df.groupBy(*by).agg(F.count("*").alias("samples"), *(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))))


def rollup_items(items: DataFrame, pair: str = "pair_id", function_kind: str = "function") -> DataFrame:
    """Sums over a pair's items, changed items, and the same for its functions alone."""
    names = ("hunks", "removed", "added", "unchanged", "total")
    changed = (F.col("removed") + F.col("added")) > 0
    is_function = F.col("kind") == function_kind
    return items.groupBy(pair).agg(
        *(F.sum(c).alias(c) for c in names), F.count_if(changed).alias("changed_items"), *(F.sum(F.when(is_function, F.col(c)).otherwise(0)).alias(f"function_{c}") for c in names), F.count_if(changed & is_function).alias("changed_functions")
    )


def coverage(df: DataFrame, run: str, label: str) -> DataFrame:
    """Runs that have each label, and percent of all runs; most frequent first, then by name."""
    runs = df.agg(F.count_distinct(run).alias("runs"))
    each = df.select(run, label).distinct().groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs))  # one row
    return each.select(label, "n", F.when(F.col("runs") == 0, F.lit(0.0)).otherwise(F.col("n") * 100.0 / F.col("runs")).alias("percent")).orderBy(F.desc("n"), label)


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """A8."""
    return df.agg(F.count_distinct(col).alias("n"))


def evidence_score(df: DataFrame, by: str, rules: Sequence[tuple[str, str, float, Column]], threshold: float = 0.3) -> DataFrame:
    """Rules are (pattern, evidence, weight, row condition); a pattern is told where the weights of its met rules reach ``threshold``."""
    flags = df.groupBy(by).agg(*(F.max(F.coalesce(cond, F.lit(False))).alias(f"rule_{k}") for k, (_, _, _, cond) in enumerate(rules)))
    patterns = list(dict.fromkeys(r[0] for r in rules))
    found = []
    for p in patterns:
        own = [(k, r) for k, r in enumerate(rules) if r[0] == p]
        score = sum((F.when(F.col(f"rule_{k}"), F.lit(r[2])).otherwise(0.0) for k, r in own), F.lit(0.0))
        evidence = F.array_compact(F.array(*(F.when(F.col(f"rule_{k}"), F.lit(r[1])) for k, r in own)))
        found.append(F.struct(F.lit(p).alias("pattern"), score.alias("score"), evidence.alias("evidence")))
    return flags.select(by, F.inline(F.array(*found))).filter(F.col("score") >= threshold)


def property_flags(instr: DataFrame, by: str, op: str = "mnemonic", guarded: Column | None = None) -> DataFrame:
    """A10: proxy and upgradeable by DELEGATECALL, owner control by CALLER, guard from a row condition."""
    delegates = F.bool_or(F.col(op) == "DELEGATECALL")
    return instr.groupBy(by).agg(delegates.alias("is_proxy"), delegates.alias("is_upgradeable"), F.bool_or(F.col(op) == "CALLER").alias("owner_control"), F.bool_or(guarded if guarded is not None else F.lit(False)).alias("guarded"))


def function_rollup(reach: DataFrame, instr: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """code_id, entry, read_only, payable over the blocks that each entry reaches; ``fallback`` over all blocks where a code has no entry.

    reach: code_id, entry, node. instr: code_id, node, mnemonic. blocks: code_id, node; without instr also writes and value.
    """
    without = blocks.join(reach.select("code_id").distinct(), "code_id", "left_anti").select("code_id", F.lit("fallback").alias("entry"), "node")
    every = reach.select("code_id", F.col("entry").cast("string").alias("entry"), "node").unionByName(without)
    flags = blocks.select("code_id", "node", "writes", "value") if instr is None else instr.groupBy("code_id", "node").agg(F.bool_or(F.col("mnemonic") == "SSTORE").alias("writes"), F.bool_or(F.col("mnemonic") == "CALLVALUE").alias("value"))
    both = every.join(flags, ["code_id", "node"], "left")
    return both.groupBy("code_id", "entry").agg((~F.coalesce(F.bool_or("writes"), F.lit(False))).alias("read_only"), F.coalesce(F.bool_or("value"), F.lit(False)).alias("payable"))


def slot_catalog(access: DataFrame) -> DataFrame:
    """Known slots of each code with a label, and how often they are loaded and stored."""
    known = access.filter("slot is not null")
    return known.groupBy("code_id", "slot").agg(F.count_if(F.col("mnemonic") == "SLOAD").alias("loads"), F.count_if(F.col("mnemonic") == "SSTORE").alias("stores")).withColumn("label", F.concat(F.lit("slot_"), "slot"))


def op_breakdown(trace: DataFrame, group: str, kind: str, listed: Sequence[str]) -> DataFrame:
    """Operations of each kind in a group, unlisted kinds as Other."""
    named = F.when(F.col(kind).isin(*listed), F.col(kind)).otherwise(F.lit("Other"))
    return trace.groupBy(group, named.alias("operation")).agg(F.count("*").alias("n")).orderBy(group, F.desc("n"), "operation")


def run_stats(results: DataFrame, success: Column, error: Column, mismatch: Column, failure: Column, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Iterations, successes, errors, mismatches, distinct failures, iterations a second (0 without elapsed time)."""
    elapsed = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    return results.groupBy(*by).agg(
        F.count("*").alias("iterations"), F.count_if(success).alias("successes"), F.count_if(error).alias("errors"), F.count_if(mismatch).alias("mismatches"), F.count_distinct(failure).alias("unique_failures"),
        F.when(elapsed > 0, F.count("*") * 1000000.0 / elapsed).otherwise(0.0).alias("rate"),
    )


def check_rollup(checks: DataFrame, suite: str = "suite_id", order: str = "check_no") -> DataFrame:
    """Valid (all passed), proven, total, success rate, summed time, and a hash of statements and results in order. The statements of one suite are put together in one row."""
    line = F.concat(F.col("statement"), F.lit("="), F.col("passed").cast("string"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n")
    one = checks.groupBy(suite).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("valid"), F.count_if("passed").alias("proven"), F.count("*").alias("total"), F.sum("elapsed_ms").alias("elapsed_ms"), ordered.alias("lines"))
    return one.select(suite, "valid", "proven", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.col("proven") / F.col("total")).alias("success_rate"), "elapsed_ms", F.sha2("lines", 256).alias("digest"))


def graph_size(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Body blocks, edges and largest stack of each graph; ok is false under two nodes or without a body."""
    one = blocks.groupBy("code_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "Body").alias("blocks"), F.coalesce(F.max("max_stack"), F.lit(0)).alias("max_stack"))
    two = edges.groupBy("code_id").agg(F.count("*").alias("edges"))
    both = one.join(two, "code_id", "left")
    return both.select("code_id", "blocks", F.coalesce("edges", F.lit(0)).alias("edges"), "max_stack", ((F.col("nodes") >= 2) & (F.col("blocks") > 0)).alias("ok"))


def execution_cost(costed: DataFrame, by: str, op: str, cost: str, store: Sequence[str] = ("SSTORE",), calls: Sequence[str] = ("CALL", "CALLCODE", "DELEGATECALL", "STATICCALL")) -> DataFrame:
    """21000 and the costs of all rows; beside it what varies, 20000 a store and 2300 a call."""
    return costed.groupBy(by).agg((F.lit(21000) + F.sum(cost)).alias("cost"), (20000 * F.count_if(F.col(op).isin(*store)) + 2300 * F.count_if(F.col(op).isin(*calls))).alias("variable_cost"))


def strip_report(codes: DataFrame, sections: DataFrame) -> DataFrame:
    """The Runtime spans of each code laid end to end, what was removed, and how much; codes without one are left out."""
    parts = sections.join(codes, "code_id").withColumn("data", F.expr("substring(code, offset + 1, len)"))
    keep = F.col("kind") == "Runtime"
    spans = F.array_sort(F.collect_list(F.when(keep, F.struct("offset", "len", F.hex("data").alias("data")))))
    removed = F.array_sort(F.collect_list(F.when(~keep, F.struct("offset", "kind", F.hex("data").alias("data")))))
    one = parts.groupBy("code_id").agg(spans.alias("spans"), removed.alias("removed"), F.sum(F.when(keep, 0).otherwise(F.col("len"))).alias("bytes_saved"), F.sum(F.when(keep, F.col("len")).otherwise(0)).alias("clean_len"))
    clean = F.array_join(F.transform("spans", lambda s: s["data"]), "")
    return one.filter(F.size("spans") > 0).select("code_id", F.size("spans").alias("kept_spans"), F.size("removed").alias("removed_spans"), "bytes_saved", "clean_len", F.lower(clean).alias("clean"), F.sha2(F.unhex(clean), 256).alias("clean_hash"))


def literals_by_width(instr: DataFrame, width: str, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct literals of each width with where they are seen first."""
    return instr.filter(F.col(value).isNotNull()).groupBy(*by, width, value).agg(F.min(order).alias("first_seen"))


def block_summary(blocks: DataFrame, edges: DataFrame, instr: DataFrame | None = None) -> DataFrame:
    """For each block its instruction count, operations in order, largest stack, and kinds of edges in and out. Without instr the blocks have their operations."""
    kinds = F.sort_array(F.collect_list("kind"))
    into = edges.groupBy("code_id", F.col("dst").alias("node")).agg(kinds.alias("incoming"))
    out = edges.groupBy("code_id", F.col("src").alias("node")).agg(kinds.alias("outgoing"))
    key = ["code_id", "node"]
    none = F.array().cast("array<string>")
    if instr is None:
        both = blocks.select(*key, "max_stack", F.col("n_instr").cast("long").alias("n_instr"), "operations")
    else:
        ops = F.transform(F.array_sort(F.collect_list(F.struct("idx", "mnemonic"))), lambda x: x["mnemonic"])
        body = instr.groupBy("code_id", "node").agg(F.count("*").alias("n_instr"), ops.alias("operations"))
        both = blocks.select(*key, "max_stack").join(body, key, "left")
    joined = both.join(into, key, "left").join(out, key, "left")
    return joined.select("code_id", "node", F.coalesce("n_instr", F.lit(0)).alias("n_instr"), F.coalesce("operations", none).alias("operations"), "max_stack", F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing"))


def entry_points(instr: DataFrame) -> DataFrame:
    """code_id, key, node, start_pc: the first PUSH4 of a block is its key; of blocks with one key the last counts. From instructions, or from blocks that have their key."""
    if "key" in instr.columns:  # blocks
        first = instr.filter("key is not null")
    else:
        first = instr.filter("mnemonic = 'PUSH4'").groupBy("code_id", "node", "start_pc").agg(F.min_by("imm", "idx").alias("key"))
    return first.groupBy("code_id", "key").agg(F.max_by("node", "start_pc").alias("node"), F.max("start_pc").alias("start_pc"))


def group_change_summary(changes: DataFrame, group: str, node: str, delta: str, remapped: Column) -> DataFrame:
    """Rows with a change, distinct nodes, what was added and removed (by the sign of each change), remapped rows, and whether nothing is recorded."""
    up, down = F.sum(F.greatest(F.col(delta), F.lit(0))), F.sum(F.greatest(-F.col(delta), F.lit(0)))
    changed = F.coalesce(F.col(delta) != 0, F.lit(False))
    one = changes.groupBy(group).agg(F.count_if(changed).alias("modified"), F.count_distinct(F.when(changed, F.col(node))).alias("nodes"), F.coalesce(up, F.lit(0)).alias("added"), F.coalesce(down, F.lit(0)).alias("removed"), F.count_if(remapped).alias("remapped"))
    return one.withColumn("nothing_recorded", (F.col("modified") == 0) & (F.col("remapped") == 0))
