"""Seed-driven operators: tokens, permutations, samples and splits that depend on hashes of rows, not on their partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalars import seeded, seeded_int
from gritstone.operators.graphs import cut_lineage
from gritstone.operators.joins import exclude_protected
from gritstone.operators.sequences import over, relayout


def token_candidate(key: Column, counter: Column, seed: str, width: int = 4, preserve: int | None = None) -> Column:
    """The last ``width`` bytes of a hash of seed, key and counter, as hex; byte ``preserve`` (0 to 3) is the key's own."""
    if preserve is not None and not 0 <= preserve < width:
        raise ValueError(f"preserve is a byte from 0 to {width - 1}")
    digits = F.right(seeded("token", seed, F.concat_ws(":", key.cast("string"), counter.cast("string"))), F.lit(2 * width))
    if preserve is None:
        return digits
    own = F.right(F.lpad(F.lower(F.hex(key.cast("long"))), 2 * width, "0"), F.lit(2 * width))
    return F.concat(F.substring(digits, 1, 2 * preserve), F.substring(own, 2 * preserve + 1, 2), F.substring(digits, 2 * preserve + 3, 2 * width))


def token_allowed(key: Column, token: Column, width: int = 4) -> Column:
    """Not the key itself, not all zero, not all ones, not one byte repeated."""
    own = F.right(F.lpad(F.lower(F.hex(key.cast("long"))), 2 * width, "0"), F.lit(2 * width))
    return (token != own) & (token != F.repeat(F.substring(token, 1, 2), width))


def token_map(keys: DataFrame, key: str, seed: str, width: int = 4, preserve: int | None = None, tries: int = 8, max_rounds: int = 64) -> DataFrame:
    """K2: key, token: a distinct token for each distinct key; null is not a key.

    In each round every open key proposes its first allowed token, the smallest key that proposes a token
    gets it, and the others go on with further counters in the next round; a round tries ``tries`` of them.
    """
    open_ = keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
    taken = None
    for step in range(max_rounds):
        counters = F.explode(F.sequence(F.lit(step * tries), F.lit((step + 1) * tries - 1)))
        proposed = open_.select("key", counters.alias("counter")).withColumn("token", token_candidate(F.col("key"), F.col("counter"), seed, width, preserve))
        proposed = proposed.filter(token_allowed(F.col("key"), F.col("token"), width))
        if taken is not None:
            proposed = proposed.join(taken.select("token"), "token", "left_anti")
        first = proposed.groupBy("key").agg(F.min_by("token", "counter").alias("token"))
        won = first.groupBy("token").agg(F.min("key").alias("key")).select("key", "token")
        taken = cut_lineage(won if taken is None else taken.unionByName(won))
        open_ = cut_lineage(open_.join(taken.select("key"), "key", "left_anti"))
        if open_.isEmpty():
            return taken
    raise ValueError(f"keys without a token after {max_rounds * tries} tries each")


def apply_tokens(df: DataFrame, mapping: DataFrame, col: str, part: Sequence[str], order: Sequence[str], where_next: Column) -> DataFrame:
    """K3: ``col`` replaced by its token at rows whose next row meets ``where_next``; ``replaced`` tells which."""
    w = over(part, order)
    marked = df.withColumn("_site", F.coalesce(F.lead(where_next).over(w), F.lit(False)))
    both = marked.join(mapping.select(F.col("key").alias(col), "token"), col, "left")
    hit = F.col("_site") & F.col("token").isNotNull()
    return both.withColumn("replaced", hit).withColumn("new_value", F.when(hit, F.col("token").cast("string")).otherwise(F.col(col).cast("string"))).select(*df.columns, "new_value", "replaced")


def ranked(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with each row's number in its group from 1 on, written to the shared folder; a group of any size is spread over tasks.

    Rows are dealt by ranges of (group, order) and numbered in their partition; what a group has in the partitions before
    is added, from a table of one row for each group and partition.
    """
    sorted_ = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(sorted_).withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    both = placed.join(offsets.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")) & (placed["_part"] == offsets["_part"]))
    return both.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def permute_within(values: DataFrame, group: str, value: str, seed: str, excluded: DataFrame | None = None, unresolved: Column | None = None) -> DataFrame:
    """K4: group, value, new_value: a bijection of each group's distinct values; excluded ones stay fixed.

    Values are ranked in natural and in hashed order, by ranges and not by group; if both orders agree in a group of
    several values, it is rotated left by one. If any row is unresolved, nothing is permuted.
    """
    distinct = values.filter(F.col(value).isNotNull()).select(group, value).distinct()
    free = distinct if excluded is None else exclude_protected(distinct, value, excluded.select(value))
    hashed = free.withColumn("_h", seeded("permute", seed, F.concat_ws(":", F.col(group).cast("string"), F.col(value).cast("string"))))
    both = cut_lineage(ranked(ranked(hashed, group, [value], "_n"), group, ["_h", value], "_m").drop("_h"))
    state = cut_lineage(both.groupBy(group).agg(F.count("*").alias("_size"), F.bool_and(F.col("_n") == F.col("_m")).alias("_same")))
    sized = both.join(state, group)
    rotated = F.when(F.col("_same") & (F.col("_size") > 1), F.col("_n") % F.col("_size") + 1).otherwise(F.col("_n"))
    source = sized.withColumn("_slot", rotated).select(group, value, "_slot")
    moved = source.join(both.select(group, F.col("_m").alias("_slot"), F.col(value).alias("new_value")), [group, "_slot"]).select(group, value, "new_value")
    out = distinct.join(moved, [group, value], "left").withColumn("new_value", F.coalesce("new_value", value))
    if unresolved is not None:
        stop = values.agg(F.coalesce(F.bool_or(unresolved), F.lit(False)).alias("_stop"))
        out = out.crossJoin(F.broadcast(stop)).withColumn("new_value", F.when(F.col("_stop"), F.col(value)).otherwise(F.col("new_value"))).drop("_stop")  # one row
    return out


def deterministic_shuffle(df: DataFrame, part: Sequence[str], order: Sequence[str], seed: str, size: str) -> DataFrame:
    """K5: ``new_no`` (from 0) and ``new_offset`` of each row in hashed order; rotated by one if that is the old order, single rows stay."""
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in (*part, *order)))
    rows = df.withColumn("_h", seeded("shuffle", seed, key)).withColumn("old_no", F.row_number().over(over(part, order)) - 1).withColumn("_m", F.row_number().over(over(part, ["_h", *order])) - 1)
    whole = Window.partitionBy(*part)
    rows = rows.withColumn("_same", F.min((F.col("old_no") == F.col("_m")).cast("int")).over(whole) == 1).withColumn("_size", F.count("*").over(whole))
    rows = rows.withColumn("new_no", F.when(F.col("_same") & (F.col("_size") > 1), (F.col("_m") + F.col("_size") - 1) % F.col("_size")).otherwise(F.col("_m")))
    return relayout(rows, part, ["new_no"], size).drop("_h", "_m", "_same", "_size")


def sample_bounded(df: DataFrame, part: Sequence[str], key: str, seed: str, max_ratio: float = 0.2) -> DataFrame:
    """K6: for each partition a hashed number of rows from 1 to ceil(ratio * n): those of the smallest hashes."""
    whole = Window.partitionBy(*part)
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in part))
    rows = df.withColumn("_n", F.count("*").over(whole)).withColumn("_k", F.lit(1) + seeded_int("sample-size", seed, name) % F.ceil(F.lit(max_ratio) * F.col("_n")))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(seeded("sample", seed, F.col(key)), F.col(key)))
    return rows.withColumn("_r", rank).filter("_r <= _k").drop("_n", "_k", "_r")


def sample_bernoulli(df: DataFrame, key: str, p: float, seed: str, eligible: Column | None = None, max_n: int | None = None) -> DataFrame:
    """K7: eligible rows whose hash fraction is under p; at most ``max_n``, in key order."""
    rows = df if eligible is None else df.filter(eligible)
    out = rows.filter(seeded_int("bernoulli", seed, F.col(key)) / F.lit(float(1 << 52)) < F.lit(p))
    return out if max_n is None else out.orderBy(key).limit(max_n)


def split_additive(df: DataFrame, col: str, key: str, seed: str) -> DataFrame:
    """K8: share_a in [1, v) and share_b = v - share_a; (0, v) for v up to 1."""
    v = F.col(col)
    r = F.lit(1) + seeded_int("split", seed, F.col(key)) % F.when(v > 1, v - 1).otherwise(F.lit(1))
    out = df.withColumn("share_a", F.when(v <= 1, F.lit(0)).otherwise(r).cast("long"))
    return out.withColumn("share_b", (v - F.col("share_a")).cast("long"))


def split_chain(df: DataFrame, col: str, key: str, seed: str, bits: int = 62) -> DataFrame:
    """K9: key, share_no, op (XOR, ADD, SUB), share: 2 to 4 shares that recombine to the value, from identity 0.

    Four in ten values become XOR chains. The others are sums whose partial results stay within
    [0, 2^bits - 1]: each turn moves to a hashed level, and the last one to the value itself.
    """
    top = 1 << min(bits, 51)
    k = F.col(key)
    parts = F.lit(2) + seeded_int("chain-parts", seed, k) % 3
    xor = seeded_int("chain-kind", seed, k) % 10 < 4
    rows = df.select(k.alias(key), F.col(col).cast("long").alias("_v"), parts.cast("int").alias("_parts"), xor.alias("_xor")).withColumn("share_no", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    level = seeded_int("chain-level", seed, F.concat_ws(":", F.col(key).cast("string"), F.col("share_no").cast("string"))) % F.lit(top)
    last = F.col("share_no") == F.col("_parts") - 1
    w = over([key], ["share_no"])
    rows = rows.withColumn("_level", F.when(last, F.col("_v")).otherwise(level)).withColumn("_prior", F.coalesce(F.lag("_level").over(w), F.lit(0)))
    move = F.col("_level") - F.col("_prior")
    op = F.when(F.col("_xor"), "XOR").when(move >= 0, "ADD").otherwise("SUB")
    share = F.when(F.col("_xor"), F.col("_level").bitwiseXOR(F.col("_prior"))).otherwise(F.abs(move))
    return rows.select(key, "share_no", op.alias("op"), share.alias("share"))


def recombine(shares: DataFrame, key: str) -> DataFrame:
    """Key, value: shares folded from left to right, from 0."""
    ordered = F.array_sort(F.collect_list(F.struct("share_no", "op", "share")))
    step = lambda a, s: F.when(s["op"] == "XOR", a.bitwiseXOR(s["share"])).when(s["op"] == "ADD", a + s["share"]).otherwise(a - s["share"])
    return shares.groupBy(key).agg(ordered.alias("_s")).select(key, F.reduce("_s", F.lit(0).cast("long"), step).alias("value"))


def split_cost(shares: DataFrame, key: str, location: str) -> DataFrame:
    """Key, n_shares, n_ops, gas, size of a split kept at ``location`` (code, stack or data): n_ops is one less than n_shares."""
    place = F.when(F.col(location) == "code", F.struct(F.lit(40).alias("gas"), F.lit(12).alias("size"))).when(F.col(location) == "data", F.struct(F.lit(3).alias("gas"), F.lit(33).alias("size"))).otherwise(F.struct(F.lit(3).alias("gas"), F.lit(0).alias("size")))
    op_gas = F.when(F.col("share_no") == 0, 0).when(F.col("op").isin("MUL", "DIV"), 5).otherwise(3)
    return shares.groupBy(key).agg(
        F.count("*").alias("n_shares"), (F.count("*") - 1).alias("n_ops"), F.sum(place["gas"] + op_gas).alias("gas"), (F.sum(place["size"]) + F.count("*") - 1).alias("size")
    )
