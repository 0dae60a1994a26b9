"""Lookups as joins. Non-equi ones go through an equi-join or one window, never through a cross join of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import windows_of


def invalid_references(refs: DataFrame, targets: DataFrame, on: Sequence[str], resolvable: Column | None = None) -> DataFrame:
    """References that resolve but hit no target; those that don't resolve are no fault."""
    known = refs if resolvable is None else refs.filter(resolvable)
    return known.join(targets.select(*on).distinct(), list(on), "left_anti")


def resolve_targets(instr: DataFrame, blocks: DataFrame) -> DataFrame:
    """code_id, idx, op, form, value, target for every JUMP and JUMPI.

    Forms before the jump: ``direct`` (PUSH), ``sum`` (PUSH PUSH ADD), ``relative`` (PUSH PC ADD). A value
    that starts no block keeps target null (raw); other shapes have no value.
    """
    w = Window.partitionBy("code_id").orderBy("idx")
    op = lambda k: F.lag("mnemonic", k).over(w)
    imm = lambda k: F.when(F.length(F.lag("imm", k).over(w)) <= 14, F.conv(F.lag("imm", k).over(w), 16, 10).cast("long"))
    push = lambda k: F.coalesce(op(k).startswith("PUSH"), F.lit(False)) & imm(k).isNotNull()
    add = F.coalesce(op(1) == "ADD", F.lit(False))
    relative = add & F.coalesce(op(2) == "PC", F.lit(False)) & push(3)
    both = add & push(2) & push(3)
    form = F.when(push(1), "direct").when(both, "sum").when(relative, "relative")
    value = F.when(push(1), imm(1)).when(both, imm(2) + imm(3)).when(relative, F.lag("pc", 2).over(w) + imm(3))
    jumps = instr.withColumn("form", form).withColumn("value", value).filter(F.col("mnemonic").isin("JUMP", "JUMPI"))
    starts = blocks.filter("start_pc is not null").select("code_id", F.col("start_pc").cast("long").alias("value"), F.col("node").alias("target"))
    return jumps.join(starts, ["code_id", "value"], "left").select("code_id", "idx", F.col("mnemonic").alias("op"), "form", "value", "target")


def paired_diff(a: DataFrame, b: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """key_a, key_b, kind (paired, removed, added). A mapped key is looked for under its token alone, another under itself."""
    left = a.select(F.col(key).alias("key_a")).join(mapping.select(F.col("key").alias("key_a"), "token"), "key_a", "left")
    left = left.withColumn("want", F.coalesce("token", "key_a"))
    right = b.select(F.col(key).alias("key_b"))
    both = left.join(right, left["want"] == right["key_b"], "full_outer")
    kind = F.when(F.col("key_a").isNull(), "added").when(F.col("key_b").isNull(), "removed").otherwise("paired")
    return both.select("key_a", "key_b", kind.alias("kind"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Keys on both sides whose payload differs, nulls being equal."""
    after = after.select(key, *(F.col(c).alias(f"{c}_after") for c in payload))
    same = F.lit(True)
    for c in payload:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_after"))
    return before.select(key, *payload).join(after, key).filter(~same)


def edge_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct rows of ``key`` that only one side has: change (removed, added)."""
    both = before.select(*key, F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(after.select(*key, F.lit(0).alias("_x"), F.lit(1).alias("_y")))
    one = both.groupBy(*key).agg(F.max("_x").alias("_x"), F.max("_y").alias("_y")).filter("_x <> _y")
    return one.select(*key, F.when(F.col("_x") == 1, "removed").otherwise("added").alias("change"))


def remap_keys(df: DataFrame, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns with mapped values replaced; ``missed`` counts those of a row without a mapping."""
    missed = F.lit(0)
    out = df
    for c in cols:
        out = out.join(mapping.select(F.col("key").alias(c), F.col("token").alias(f"_{c}")), c, "left")
        missed = missed + F.when(F.col(f"_{c}").isNull() & F.col(c).isNotNull(), 1).otherwise(0)
    out = out.withColumn("missed", missed)
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else c for c in df.columns), "missed")


def remap_offsets(offsets: DataFrame, intervals: DataFrame, part: Sequence[str], at: str = "at") -> DataFrame:
    """The new place of each offset that lies in an interval (old, size, new), else null.

    An as-of join: intervals and offsets are laid on one line, and each offset takes the last interval
    that starts at or before it.
    """
    one = intervals.select(*part, F.col("old").alias("_at"), F.struct("old", "size", "new").alias("_interval"), F.lit(0).alias("_side"))
    names = [c for c in offsets.columns if c not in part]
    two = offsets.select(*part, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    line = Window.partitionBy(*part).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_last", F.last("_interval", ignorenulls=True).over(line)).filter("_side = 1")
    moved = F.when(F.col("_at") < F.col("_last.old") + F.col("_last.size"), F.col("_last.new") + F.col("_at") - F.col("_last.old"))
    return both.select(*part, "_row.*", moved.alias("moved"))


def within_section(instr: DataFrame, sections: DataFrame, kind: str, on: str = "code_id", at: str = "pc") -> DataFrame:
    """Rows whose place lies in a section of the kind; an equi-join on the code, with the range as its condition."""
    spans = sections.filter(F.col("kind") == kind).select(F.col(on), "offset", "len")
    names = instr.columns
    inside = (F.col(at) >= F.col("offset")) & (F.col(at) < F.col("offset") + F.col("len"))
    return instr.join(spans, on).filter(inside).select(*names)


def lookup_cost(instr: DataFrame, costs: dict[str, int], op: str = "mnemonic", default: int = 1, name: str = "cost") -> DataFrame:
    """The cost of each operation from a fixed table; unknown ones cost ``default``."""
    spark = instr.sparkSession
    table = spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for kv in costs.items() for x in kv))).alias(op, name))
    return instr.join(F.broadcast(table), op, "left").withColumn(name, F.coalesce(name, F.lit(default)))  # as long as the table given


def locate_passage(haystack: DataFrame, needles: DataFrame, id_col: str, needle_col: str, text_col: str = "text", prefix_len: int = 20, all_hits: bool = False) -> DataFrame:
    """Where needles stand in texts: id, needle, start (from 0), len.

    The longest word inside a needle, with a blank on both sides, meets the texts' words in an equi-join;
    needles without one meet windows of ``prefix_len`` characters with their prefix. What meets is then
    looked up in the text. By default only the first place of the prefix counts, and the whole needle must
    stand there.
    """
    wanted = needles.filter(F.length(text_col) >= prefix_len).select(F.col(needle_col).alias("needle"), F.col(text_col).alias("_needle"))
    words = F.split("_needle", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    wanted = wanted.withColumn("_word", F.reduce(inner, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)))
    texts = haystack.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    worded = texts.select("id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).filter("_word <> ''")
    meet = worded.join(wanted.filter("_word <> ''"), "_word").select("id", "needle", "_needle")
    plain = wanted.filter("_word = ''")
    if not plain.isEmpty():
        hashed = plain.select("needle", "_needle", F.xxhash64(F.substring("_needle", 1, prefix_len)).alias("_h"))
        windows = texts.filter(F.length("_text") >= prefix_len).select("id", F.explode(F.array_distinct(F.transform(windows_of(F.col("_text"), prefix_len), lambda x: F.xxhash64(x)))).alias("_h"))
        meet = meet.unionByName(windows.join(hashed, "_h").select("id", "needle", "_needle"))
    there = meet.join(texts, "id")
    n = F.length("_needle")
    if all_hits:
        where = F.filter(F.sequence(F.lit(1), F.length("_text")), lambda i: F.substring(F.col("_text"), i, n) == F.col("_needle"))
        return there.filter(F.contains("_text", "_needle")).select("id", "needle", (F.explode(where) - 1).alias("start"), n.alias("len"))
    at = F.expr(f"locate(left(_needle, {prefix_len}), _text)")
    hit = there.withColumn("start", at - 1).filter("start >= 0")
    return hit.filter(F.substring(F.col("_text"), F.col("start") + 1, n) == F.col("_needle")).select("id", "needle", "start", n.alias("len"))


def exclude_protected(df: DataFrame, key: str, *protected: DataFrame) -> DataFrame:
    """Rows whose key is in none of the protected sets."""
    return df.join(union_protected(key, *protected), key, "left_anti")


def union_protected(key: str, *protected: DataFrame) -> DataFrame:
    """The distinct keys of all sets."""
    out = protected[0].select(key)
    for p in protected[1:]:
        out = out.unionByName(p.select(key))
    return out.distinct()


def keys_present(codes: DataFrame, literals: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key stands among the literals."""
    return codes.join(literals.select(*on).distinct(), list(on), "left_semi")


def reverse_targets(jumps: DataFrame, source: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """For each target its distinct sources in order, in one row: of a program at most as many as it has jumps."""
    return jumps.filter(F.col(target).isNotNull()).groupBy(*by, target).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def experiment_grid(items: DataFrame, steps: Sequence[str], n_seeds: int) -> DataFrame:
    """Every item with every subset of the steps (by bit mask; 0 is none) and every seed number."""
    names = F.array(*map(F.lit, steps)) if steps else F.array().cast("array<string>")
    masks = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(steps) - 1))).alias("mask")
    grid = items.select("*", masks).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("seed_no"))
    chosen = F.array_join(F.filter(names, lambda x, i: F.getbit(F.col("mask"), i) == 1), ",")
    return grid.withColumn("steps", F.when(F.col("mask") == 0, "none").otherwise(chosen))
