"""Queries: sequences, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import joins as J
from gritstone.operators import sequences as W
from gritstone.operators import sets as O
from gritstone.plans.registry import query
from gritstone.sources.tables import lines, load, run_log, snapshot_b, snapshot_map
from gritstone.streaming.run_log import drop_noop_events

KEY, ORDER = ["run_id"], ["seq"]
LOG = "log as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as kind, value, ts, props, event_id from events)"
SNAP = "b as (select case when o_orderkey % 13 = 0 then o_orderkey + 10000000 else o_orderkey end as o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 11 = 0 then round(o_totalprice * 1.1, 2) else o_totalprice end as o_totalprice from orders where o_orderkey % 7 <> 0), m as (select o_orderkey as key, o_orderkey + 10000000 as token from orders where o_orderkey % 13 = 0 and o_orderkey % 7 <> 0)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(load(spark, sf_dir, "events"))


@query(f"with {LOG} select event_id from log where kind in ('signup', 'purchase') or value > 50")
def p12_drop_noop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_noop_events(log(spark, sf_dir), F.col("value") > 50, F.col("kind").isin("signup", "purchase")).select("event_id")


@query(f"with {LOG}, n as (select *, (seq = 1 or kind = 'signup' or coalesce(lag(kind) over (partition by run_id order by seq) = 'purchase', false))::int as s from log) select run_id, seq::int as seq, sum(s) over (partition by run_id order by seq) - 1 as segment from n".replace("sum(s) over (partition by run_id order by seq) - 1", "(sum(s) over (partition by run_id order by seq) - 1)::bigint"))
def w1_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.segment(log(spark, sf_dir), KEY, ORDER, F.col("kind") == "signup", F.col("kind") == "purchase").select(*KEY, "seq", "segment")


@query(f"with {LOG}, d as (select *, case kind when 'view' then 1 when 'click' then -1 else 0 end as d from log), s as (select *, sum(d) over (partition by run_id order by seq)::bigint as t from d), x as (select *, t - least(0, min(t) over (partition by run_id order by seq)) as depth from s) select run_id, seq::int as seq, depth from x")
def w2_running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("kind") == "view", 1).when(F.col("kind") == "click", -1).otherwise(0)
    return W.running_depth(log(spark, sf_dir), KEY, ORDER, delta).select(*KEY, "seq", "depth")


@query(f"with {LOG}, f as (select run_id, max((kind = 'error')::int) over w as a, max((kind = 'purchase')::int) over w as b, max((value > 80)::int) over w as c, count(*) over w as n from log window w as (partition by run_id order by seq rows between 4 preceding and current row)) select run_id, bool_or(a = 1 and b = 1 and c = 1 and n = 5) as cooccurs from f group by run_id")
def w3_cooccur_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.cooccur_within(log(spark, sf_dir), KEY, ORDER, [F.col("kind") == "error", F.col("kind") == "purchase", F.col("value") > 80], 5)


@query(f"with {LOG}, l as (select *, lead(kind) over (partition by run_id order by seq) as k1, lead(kind, 2) over (partition by run_id order by seq) as k2 from log) select event_id from l where kind = 'view' and k1 = 'click' and k2 = 'purchase'")
def w4_match_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    return W.match_sequence(log(spark, sf_dir), KEY, ORDER, [k == "view", k == "click", k == "purchase"]).filter("matches").select("event_id")


@query(f"with {LOG}, i as (select *, seq - row_number() over (partition by run_id, kind order by seq) as island from log) select run_id, kind, min(seq)::int as first, max(seq)::int as last, count(*) as length, count(*) = 1 as single from i group by run_id, kind, island")
def w5_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.collapse_runs(log(spark, sf_dir), KEY, ORDER, "kind")


@query(
    f"""with {LOG}, m as (select *, max(case when kind = 'signup' then seq end) over (partition by run_id order by seq) as s, max(case when kind = 'purchase' then seq end) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding) as e from log),
i as (select *, s is not null and (e is null or s > e) as inside from m), c as (select *, (seq = 1 or kind = 'signup' or inside <> lag(inside) over (partition by run_id order by seq))::int as new from i),
g as (select *, sum(new) over (partition by run_id order by seq) - 1 as group_no from c), o as (select *, bool_or(kind = 'purchase') over (partition by run_id, group_no) as closed, max(seq) over (partition by run_id, group_no) as last_seq, max(case when kind = 'signup' then seq end) over (partition by run_id) as last_start,
min(case when not inside then group_no end) over (partition by run_id) as outside, bool_or(kind in ('signup', 'purchase')) over (partition by run_id) as marked, first_value(props) over (partition by run_id, group_no order by seq) as title from g)
select run_id, seq::int as seq, group_no::bigint as group_no, case when not marked then 'All Operations' when inside then title when group_no = outside then 'Setup' else '' end as group_name from o where not (inside and not closed and coalesce(last_start > last_seq, false))"""
)
def w6_group_by_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.group_by_markers(log(spark, sf_dir), KEY, ORDER, F.col("kind") == "signup", F.col("kind") == "purchase", F.col("props"))
    return out.select(*KEY, "seq", "group_no", "group_name")


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice rows between unbounded preceding and 1 preceding), 0)::bigint as new_offset from lineitem")
def w7_relayout(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    return W.relayout(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "size").select("l_orderkey", "l_linenumber", "l_partkey", "new_offset")


@query(
    """with s as (select l_orderkey, l_linenumber * 10 - 10 as start, least(l_quantity::int, 10) as size, 50 as total from lineitem), w as (select *, start + size as e, coalesce(lag(start + size) over (partition by l_orderkey order by start, size), 0) as cursor, row_number() over (partition by l_orderkey order by start, size) as no from s),
f as (select *, case when start < cursor then 'overlap' when start > cursor then 'gap' when e > total then 'out of bounds' end as fault from w), o as (select l_orderkey, arg_min(fault, no) filter (fault is not null) as fault, arg_min(case when fault = 'gap' then cursor else start end, no) filter (fault is not null) as "at", arg_max(e, no) as last from f group by l_orderkey)
select l_orderkey, case when fault is not null then fault when last <> 50 then 'final gap' else 'ok' end as status, case when fault is not null then "at" when last <> 50 then last end as "at" from o"""
)
def w8_validate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10 - 10).alias("start"), F.least(F.col("l_quantity").cast("int"), F.lit(10)).alias("size"), F.lit(50).alias("total"))
    return W.validate_intervals(spans, ["l_orderkey"], "start", "size", "total")


@query("select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next from orders")
def w9_next_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.next_in_order(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "next")


@query(f"with {LOG}, d as (select *, round(coalesce(value - lag(value) over (partition by run_id order by seq), 0), 6) as value_delta, value <> lag(value) over (partition by run_id order by seq) as c from log) select event_id, value_delta, coalesce(c, false) as changed, bool_or(coalesce(c, false)) over (partition by run_id order by seq) as any_changed from d")
def w10_step_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.step_deltas(log(spark, sf_dir), KEY, ORDER, ["value"]).select("event_id", F.round("value_delta", 6).alias("value_delta"), "changed", "any_changed")


@query(f"with {LOG} select run_id, min(case when kind = 'purchase' then seq end)::int as attempt, count(*) as attempts, min(case when kind = 'purchase' then seq end) is null as failed from log where seq <= 5 group by run_id")
def w11_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_success(log(spark, sf_dir), KEY, ORDER, F.col("kind") == "purchase")


@query(
    f"""with {LOG}, l as (select *, lead(kind) over w as k1, lead(kind, 2) over w as k2, lead(kind, 3) over w as k3 from log window w as (partition by run_id order by seq)),
h as (select run_id, seq - 1 as "at", case when kind = 'view' and k1 = 'click' and k2 = 'error' then 0 when kind = 'signup' and k1 = 'view' and k2 = 'click' and k3 = 'error' then 1 end as p from l where seq <= 200)
select run_id, min("at")::int as "at", arg_min(p, "at") as pattern from h where p is not null group by run_id"""
)
def w12_first_match_in_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    short = [k == "view", k == "click", k == "error"]
    return W.first_match_in_prefix(log(spark, sf_dir), KEY, ORDER, [short, [k == "signup", *short]])


@query(
    """with l as (select doc_id, i - 1 as line_no, parts[i] as line from (select doc_id, string_split(text, chr(10)) as parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
a as (select *, coalesce(bool_or(ends_with(line, '.')) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), false) as past, contains(line, ' the ') as f, length(line) - length(replace(line, ',', '')) - (length(line) - length(replace(line, '.', ''))) as net from l),
b as (select *, sum((f and past)::int) over (partition by doc_id order by line_no) as fn from a), k as (select *, case when not past then 'header' when fn = 0 then 'storage' else 'function' end as kind from b)
select doc_id, kind, fn::bigint as section_no, min(line_no)::int as first_line, count(*) as n_lines, string_agg(line, chr(10) order by line_no) as text, case when kind = 'function' then fn::varchar end as key, case when kind = 'function' then 'Unresolved_' || fn end as name from k group by doc_id, kind, fn"""
)
def w13_section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no braces, so a function ends where the next begins."""
    rows = lines(load(spark, sf_dir, "documents"))
    plain = rows.withColumn("line", F.col("line"))
    return W.section_text(plain, ["doc_id"], "line_no", "line", F.col("line").endswith("."), F.col("line").contains(" the "))


@query("select l_orderkey, l_linenumber, l_partkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::int as position from lineitem")
def w14_sequence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sequence_positions(load(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "position")


@query(f"with {LOG}, o as (select run_id, arg_max(value, seq) filter (kind = 'signup') as original, arg_max(value, seq) filter (kind = 'purchase') as final, arg_max(case when value > 20 then props end, seq) filter (kind = 'purchase' and value > 20) as fm from log group by run_id) select run_id, original, final from o where original is not null and final is not null")
def w15_first_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_last_state(log(spark, sf_dir), "run_id", "seq", F.col("kind") == "signup", F.col("kind") == "purchase", "value", "props").select("run_id", "original", "final")


@query(f"with {LOG}, f as (select *, min(case when kind = 'error' then seq end) over (partition by run_id order by seq rows between current row and unbounded following) as a from log) select event_id, (a - seq)::int as back, dense_rank() over (partition by run_id order by a)::int as failure_no from f where a is not null and a - seq < 3")
def r5_tail_before_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tail_before_failure(log(spark, sf_dir), KEY, ORDER, F.col("kind") == "error", 3).select("event_id", "back", "failure_no")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity > 5 and l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def j1_invalid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.invalid_references(load(spark, sf_dir, "lineitem"), targets, ["l_orderkey"], F.col("l_quantity") > 5).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"with {SNAP}, a as (select o_orderkey as key_a, coalesce(token, o_orderkey) as want from orders left join m on m.key = o_orderkey) select key_a, b.o_orderkey as key_b, case when key_a is null then 'added' when b.o_orderkey is null then 'removed' else 'paired' end as kind from a full join b on want = b.o_orderkey")
def j3_paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return J.paired_diff(orders, snapshot_b(orders), snapshot_map(orders), "o_orderkey")


@query("select c_custkey, c_acctbal, round(case when c_custkey % 5 = 0 then -c_acctbal else c_acctbal end, 2) as c_acctbal_after from customer where c_custkey % 5 = 0 and c_acctbal <> 0")
def j4_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    after = before.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, -F.col("c_acctbal")).otherwise(F.col("c_acctbal")))
    return J.changed_rows(before, after, "c_custkey", ["c_acctbal"]).withColumn("c_acctbal_after", F.round("c_acctbal_after", 2))


@query(f"with {SNAP}, x as (select distinct o_custkey, o_orderstatus from orders), y as (select distinct o_custkey + (o_orderkey % 50 = 0)::int as o_custkey, o_orderstatus from b) select o_custkey, o_orderstatus, 'removed' as change from (select * from x except select * from y) union all select o_custkey, o_orderstatus, 'added' from (select * from y except select * from x)")
def j5_edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    after = snapshot_b(orders).withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 50 == 0).cast("int"))
    return J.edge_changes(orders, after, ["o_custkey", "o_orderstatus"])


@query(f"with {SNAP} select coalesce(token, l_orderkey) as l_orderkey, l_linenumber, l_partkey, case when token is null then 1 else 0 end as missed from lineitem left join m on key = l_orderkey")
def j6_remap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.remap_keys(items, snapshot_map(load(spark, sf_dir, "orders")), ["l_orderkey"])


@query(
    f"""with {LOG}, i as (select run_id, seq * 10 as old, 7 as size, seq * 100 as new from log where kind = 'view'), o as (select run_id, event_id, seq * 10 + (event_id % 10) as at from log)
select o.run_id, o.event_id, o.at, case when o.at < i.old + i.size then i.new + o.at - i.old end as moved from o asof left join i on o.run_id = i.run_id and o.at >= i.old"""
)
def j7_remap_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    seq = F.col("seq").cast("long")
    intervals = rows.filter("kind = 'view'").select("run_id", (seq * 10).alias("old"), F.lit(7).cast("long").alias("size"), (seq * 100).alias("new"))
    offsets = rows.select("run_id", "event_id", (seq * 10 + F.col("event_id") % 10).alias("at"))
    return J.remap_offsets(offsets, intervals, ["run_id"])


@query("select l.l_orderkey, l.l_linenumber, l.l_partkey from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'O' and l.l_quantity >= o.o_orderkey % 20 and l.l_quantity < o.o_orderkey % 20 + 15")
def j8_within_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 20).alias("offset"), F.lit(15).alias("len"))
    return J.within_section(load(spark, sf_dir, "lineitem"), sections, "O", "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select user_id, sum(coalesce(c, 1))::bigint as cost from events left join (values ('view', 3), ('error', 700)) t(k, c) on k = event_type group by user_id")
def j9_lookup_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lookup_cost(load(spark, sf_dir, "events"), {"view": 3, "error": 700}, "event_type").groupBy("user_id").agg(F.sum("cost").alias("cost"))


@query("select doc_id as id, item_id as needle, strpos(d.text, left(b.text, 20)) - 1 as start, length(b.text) as len from documents d, benchmark b where length(b.text) >= 20 and strpos(d.text, left(b.text, 20)) > 0 and substr(d.text, strpos(d.text, left(b.text, 20)), length(b.text)) = b.text")
def j10_locate_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.locate_passage(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return out.select("id", "needle", F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey not in (select l_orderkey from lineitem where l_tax > 0.07) and o_orderkey % 10 <> 3 and o_orderkey % 7 <> 0")
def j11_exclude_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sets = (items.filter("l_returnflag = 'R'"), items.filter("l_tax > 0.07"), orders.filter("o_orderkey % 10 = 3"), orders.filter("o_orderkey % 7 = 0"))
    return J.exclude_protected(orders, "o_orderkey", *sets)


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def j12_keys_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.keys_present(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), used, ["c_custkey"])


@query("select l_partkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as sources from lineitem where l_partkey % 5 <> 0 group by l_partkey")
def j13_reverse_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    jumps = load(spark, sf_dir, "lineitem").withColumn("l_partkey", F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")))
    return J.reverse_targets(jumps, "l_suppkey", "l_partkey").select("l_partkey", F.array_join("sources", ",").alias("sources"))


@query("select n_nationkey, mask::int as mask, seed::int as seed_no, case when mask = 0 then 'none' else array_to_string(list_filter([case when mask & 1 > 0 then 'shuffle' end, case when mask & 2 > 0 then 'split' end, case when mask & 4 > 0 then 'mask' end], lambda x: x is not null), ',') end as steps from nation, range(8) a(mask), range(3) b(seed)")
def j14_experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.experiment_grid(load(spark, sf_dir, "nation").select("n_nationkey"), ["shuffle", "split", "mask"], 3)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey")
def o1_ordered_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ordered_extract(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("select * from (select o_orderkey, 0::bigint as more from orders order by o_totalprice desc, o_orderkey limit 10) union all select null, greatest(count(*) - 10, 0)::bigint from orders")
def o2_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest orders, and a row with how many more there are."""
    first, more = O.head(load(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 10)
    return first.select("o_orderkey", F.lit(0).cast("long").alias("more")).unionByName(more.select(F.lit(None).cast("long").alias("o_orderkey"), "more"))


@query(f"with {SNAP}, x as (select o_custkey, o_orderstatus from orders), y as (select o_custkey, o_orderstatus from b) select *, 'a' as side from (select * from x except all select * from y) union all select *, 'b' from (select * from y except all select * from x)")
def o3_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return O.symmetric_difference(orders.select("o_custkey", "o_orderstatus"), snapshot_b(orders).select("o_custkey", "o_orderstatus"))


@query("select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as n from lineitem) where n = 1")
def o4_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dedup_keep_first(load(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("select c_custkey from customer where c_acctbal < 0 union select o_custkey from orders where o_orderstatus = 'P' union select c_custkey from customer where c_custkey % 10 = 0")
def o5_union_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    pending = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.union_protected("c_custkey", customer.filter("c_acctbal < 0"), pending, customer.filter("c_custkey % 10 = 0"))


@query(f"with {SNAP}, a as (select o_orderkey as key_a, coalesce(token, o_orderkey) as want from orders left join m on m.key = o_orderkey) select coalesce(key_a, b.o_orderkey) as key, case when key_a is null then 'added' else 'removed' end as kind from a full join b on want = b.o_orderkey where key_a is null or b.o_orderkey is null")
def o6_only_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return O.only_in(orders, snapshot_b(orders), snapshot_map(orders), "o_orderkey")
