"""Queries: hex, fingerprints, scalar functions and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import scalars as S
from gritstone.operators import aggregates as A
from gritstone.operators import checks as V
from gritstone.operators import keyed as K
from gritstone.operators.joins import lookup_cost
from gritstone.plans.registry import query
from gritstone.sources.tables import lines, load

SEED = "5eed" * 16


@query(
    """select doc_id, lpad_hex as normalized, case when n % 2 = 1 then null else h end as cli from (
    select doc_id, h, length(h) as n, case when length(h) % 2 = 1 then '0' || h else h end as lpad_hex from (select doc_id, hex(text) || case when doc_id % 2 = 0 then '' else 'a' end as h from documents))"""
)
def s2_normalize_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.hex(F.encode("text", "UTF-8")), F.when(F.col("doc_id") % 2 == 0, "").otherwise("a"))
    spaced = F.concat(F.lit(" 0x"), F.regexp_replace(digits, "(.{7})", "$1\n\t "))
    docs = load(spark, sf_dir, "documents").withColumn("spaced", spaced)
    return docs.select("doc_id", S.normalize_hex(F.col("spaced")).alias("normalized"), S.normalize_hex(F.col("spaced"), strict=False).alias("cli"))


@query("select strlen(text)::int as byte_length, sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_doc from documents group by all")
def s5_content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates share a length and a hash."""
    docs = load(spark, sf_dir, "documents")
    return docs.groupBy(F.octet_length("text").alias("byte_length"), F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query(
    """with p as (select o_orderkey, o_totalprice::bigint as b, (o_totalprice * (0.9 + (o_orderkey % 3) * 0.1))::bigint as a from orders)
select o_orderkey, b as bytes_before, a as bytes_after, a - b as delta, 32000 + 200 * b as cost_before, 32000 + 200 * a as cost_after, (32000 + 200 * a) - (32000 + 200 * b) as cost_delta,
round(case when b = 0 then 0.0 else (a - b)::double / b * 100 end, 9) as percent, case when a > b then 'larger' when a < b then 'smaller' else 'unchanged' end as note from p"""
)
def s8_size_cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    pairs = load(spark, sf_dir, "orders").select("o_orderkey", F.rint(price).cast("long").alias("b"), F.rint(price * (F.lit(0.9) + (F.col("o_orderkey") % 3) * 0.1)).cast("long").alias("a"))
    return V.size_cost_report(pairs, "o_orderkey", "b", "a").withColumn("percent", F.round("percent", 9))


@query("select event_id, event_type in ('purchase', 'error') as terminal, event_type in ('purchase', 'error', 'click', 'signup') as block_ending from events")
def p1_is_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select("event_id", S.is_terminal(kind, ("purchase", "error")).alias("terminal"), S.is_block_ending(kind, ("purchase", "error", "click", "signup")).alias("block_ending"))


@query("select user_id, count(*) as total, count(*) filter (event_type not in ('click', 'view')) as unknown, count(distinct event_type) filter (event_type not in ('click', 'view')) as unknown_kinds from events group by user_id")
def p2_unknown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unknown_stats(load(spark, sf_dir, "events"), ~F.col("event_type").isin("click", "view"), "event_type", ["user_id"])


@query(
    r"""with t as (select 'documents' as source, doc_id as id, text as x from documents union all select 'pages', page_id, html from pages), b as (select source, id, regexp_replace(x, '\x00+$', '') as y from t)
select source, id, strlen(y) >= 4 and (length(regexp_replace(y, '[^\x20-\x7E]', '', 'g'))::float / strlen(y)::float) >= 0.6::float as likely_text from b"""
)
def p3_is_likely_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    return docs.unionByName(pages).select("source", "id", S.is_likely_text(F.col("x")).alias("likely_text"))


@query("select doc_id, (21000 + 4 * z + 16 * (strlen(text) - z))::bigint as cost from (select doc_id, text, length(text) - length(replace(text, ' ', '')) as z from documents)")
def p4_payload_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", S.payload_cost(zero, F.octet_length("text") - zero).cast("long").alias("cost"))


@query("select doc_id, (32000 + 200 * strlen(text))::bigint as cost from documents")
def p5_deploy_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", S.deploy_cost(F.octet_length("text")).cast("long").alias("cost"))


@query("select l_orderkey, l_linenumber, round(case when l_quantity = 0 then 0.0 else (l_extendedprice - l_quantity) / l_quantity * 100 end, 6) as percent from lineitem")
def p6_pct_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.pct_increase(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("percent"))


@query("select l_orderkey, l_linenumber, round(5 * log2(l_quantity) + l_linenumber + 30 * (1 - l_discount), 6) as potency from lineitem")
def p7_potency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.potency(F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber")), 6).alias("potency"))


@query("select a.o_orderkey, round((b.o_totalprice - a.o_totalprice) - 0.25 * (b.o_custkey - a.o_custkey), 6) as score from orders a join orders b on b.o_orderkey = a.o_orderkey + 1")
def p8_compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_totalprice").alias("p2"), F.col("o_custkey").alias("n2"))
    return orders.join(after, "o_orderkey").select("o_orderkey", F.round(S.comparison(F.col("o_totalprice"), F.col("p2"), F.col("o_custkey"), F.col("n2")), 6).alias("score"))


@query("select doc_id, case when n_chars % 40 < 10 then 'strong' when n_chars % 40 < 25 then 'moderate' else 'weak' end as preservation, case when n_chars % 101 > 90 then 'high' when n_chars % 101 > 70 then 'moderate' else 'low' end as diversity from documents")
def p9_interpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, varied = S.interpret(F.col("n_chars") % 40, F.col("n_chars") % 101)
    return load(spark, sf_dir, "documents").select("doc_id", kept.alias("preservation"), varied.alias("diversity"))


@query("select event_id, case when contains(m, 'validation') or contains(m, 'invalid jump') then 'Validation' else 'Obfuscation' end as kind from (select event_id, case when event_type = 'error' then 'validation of ' || props when event_type = 'view' then 'invalid jump ' || props else props end as m from events)")
def p10_classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "error", F.concat(F.lit("validation of "), "props")).when(kind == "view", F.concat(F.lit("invalid jump "), "props")).otherwise(F.col("props"))
    return load(spark, sf_dir, "events").select("event_id", S.classify_failure(message).alias("kind"))


@query(
    """with e as (select user_id, arg_max(event_type, (ts, event_id)) as l, arg_min(event_type, (ts, event_id)) as f from events group by user_id), o as (select user_id, case l when 'purchase' then 'RETURN' when 'error' then 'REVERT' when 'click' then 'JUMP' when 'view' then 'JUMPI' end as l, case f when 'signup' then 'JUMPDEST' end as f from e)
select user_id, case l when 'RETURN' then 'Return' when 'REVERT' then 'Error' when 'JUMP' then 'Jump' when 'JUMPI' then 'Branch' else case when f = 'JUMPDEST' then 'Entry' else 'Normal' end end as block_type from o"""
)
def p11_block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    one = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", order).alias("last"), F.min_by("event_type", order).alias("first"))
    names = F.create_map(*(F.lit(x) for x in ("purchase", "RETURN", "error", "REVERT", "click", "JUMP", "view", "JUMPI")))
    return one.select("user_id", S.block_type(names[F.col("last")], F.when(F.col("first") == "signup", "JUMPDEST")).alias("block_type"))


@query(
    """with n as (select doc_id as code_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).{1,32}'), lambda x: sha256(x)), '') as h from documents), m as (select code_id, length(h) // 2 as size, case when h <> '' then ('0x' || right(h, 4))::int end as n from n)
select code_id, case when n <= size - 2 then size - 2 - n end::int as trailer_offset, case when n <= size - 2 then n + 2 end as trailer_len from m"""
)
def p13_trailer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.sources.tables import codes

    at, n = S.trailer_bounds(F.col("code"))
    return codes(spark, sf_dir).select("code_id", at.alias("trailer_offset"), n.alias("trailer_len"))


@query("select c_custkey, c_custkey as parsed, lpad(lower(to_hex(c_custkey)), 16, '0') as wide, case when length(to_hex(c_custkey)) <= 2 then lpad(lower(to_hex(c_custkey)), 2, '0') end as narrow from customer")
def p14_parse_format_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", S.parse_be(S.format_be(key, 20)).alias("parsed"), S.format_be(key, 8).alias("wide"), S.format_be(key, 1).alias("narrow"))


@query(
    r"""with d as (select doc_id, lang, text, string_split_regex(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[0-9]{16}') as p, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[0-9]{16}') as h from documents)
select doc_id, case when lang = 'es' then text else array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(substr(repeat(sha256('k' || h[i]), ceil(length(h[i]) / 64.0)::int), 1, length(h[i])), '')), '') end as text from d"""
)
def p18_mask_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return S.mask_literals(docs, "text", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[0-9]{16}", "k", F.col("lang") == "es").select("doc_id", "text")


@query("select l_returnflag, l_linestatus, sum(case when l_quantity::int + 90 between 96 and 127 then l_quantity::int + 90 - 96 + 2 else 1 end)::bigint as bytes from lineitem group by all")
def p19_encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = S.instr_size(F.col("l_quantity").cast("int") + 90)
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(size).alias("bytes"))


EVENT_COST = {"signup": 20000, "purchase": 800, "click": 3}


@query("select event_id, event_type, coalesce(c, 1) as cost from events left join (values ('signup', 20000), ('purchase', 800), ('click', 3)) t(k, c) on k = event_type")
def p20_gas_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_cost(load(spark, sf_dir, "events").select("event_id", "event_type"), EVENT_COST, "event_type")


@query("select o_custkey, n as n_shares, n - 1 as n_ops, gas, size from (select o_custkey, count(*) as n, sum(case o_orderstatus when 'O' then 40 else 3 end + case when rn = 1 then 0 else 3 end)::bigint as gas, (sum(case o_orderstatus when 'O' then 12 when 'F' then 33 else 0 end) + count(*) - 1)::bigint as size from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) group by o_custkey)")
def p21_split_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    where = F.when(F.col("o_orderstatus") == "O", "code").when(F.col("o_orderstatus") == "F", "data").otherwise("stack")
    shares = load(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(w) - 1).alias("share_no"), F.lit("ADD").alias("op"), where.alias("location"))
    return K.split_cost(shares, "o_custkey", "location")


@query(
    """select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(coalesce(stddev_samp(n_chars), 0), 6) as std, min(n_chars)::double as min, max(n_chars)::double as max, round(quantile_cont(n_chars::double, 0.25), 6) as p25, round(quantile_cont(n_chars::double, 0.5), 6) as median,
round(quantile_cont(n_chars::double, 0.75), 6) as p75, round(quantile_cont(n_chars::double, 0.95), 6) as p95, round(avg(n_chars) / 1000 * 100, 6) as ratio from documents group by lang"""
)
def a1_distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.distribution_summary(load(spark, sf_dir, "documents"), "n_chars", 1000, ["lang"])
    return out.select("lang", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "median", "p75", "p95", "ratio")))


@query(
    """with b as (select min(n_chars) as lo, greatest(1, floor((max(n_chars) - min(n_chars)) / 10.0))::bigint as w from documents)
select (lo + floor((n_chars - lo) / w::double)::bigint * w) as start, (lo + floor((n_chars - lo) / w::double)::bigint * w + w - 1) as "end", count(*) as n from documents, b group by all"""
)
def a2_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(load(spark, sf_dir, "documents"), "n_chars")


@query("select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line order by n desc, length(line) desc, line limit 10")
def a3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_k(lines(load(spark, sf_dir, "documents")), "line")


@query(
    """with d as (select lang, text from documents), g as (select lang, n, substr(text, i, n) as gram from (select lang, text, n, unnest(range(1, length(text) - n + 2)) as i from d, (values (2), (4), (8)) t(n) where length(text) >= n)),
k as (select lang, n::int as n, count(*) as windows, count(distinct gram) as distinct_windows from g group by lang, n), s as (select lang, avg(n_chars) as mean_chars from documents group by lang)
select lang, n, windows, distinct_windows, round(distinct_windows * 100.0 / windows, 6) as diversity, round(mean_chars, 6) as mean_chars from k join s using (lang)"""
)
def a4_ngram_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity of 2, 4 and 8 characters in each language, beside the mean length of its documents."""
    docs = load(spark, sf_dir, "documents")
    mean = A.distribution_summary(docs, "n_chars", 1000, ["lang"]).select("lang", F.round("mean", 6).alias("mean_chars"))
    grams = A.ngram_diversity(docs, "text", (2, 4, 8), ["lang"])
    return grams.join(mean, "lang").withColumn("diversity", F.round("diversity", 6))


@query("select l_shipdate::date as day, count(*) as samples, min(l_quantity) as l_quantity_min, round(avg(l_quantity), 6) as l_quantity_avg, max(l_quantity) as l_quantity_max, min(l_tax) as l_tax_min, round(avg(l_tax), 6) as l_tax_avg, max(l_tax) as l_tax_max from lineitem group by all")
def a5_min_avg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.min_avg_max(load(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["l_quantity", "l_tax"], ["day"])
    return out.withColumn("l_quantity_avg", F.round("l_quantity_avg", 6)).withColumn("l_tax_avg", F.round("l_tax_avg", 6))


@query(
    """with i as (select l_orderkey as pair_id, case when l_linenumber = 1 then 'header' else 'function' end as kind, (l_quantity::int % 3)::bigint as hunks, (l_quantity::int % 5)::bigint as removed, (l_quantity::int % 4)::bigint as added, l_quantity::bigint as unchanged, (l_quantity::int + 4)::bigint as total from lineitem)
select pair_id, sum(hunks)::bigint as hunks, sum(removed)::bigint as removed, sum(added)::bigint as added, sum(unchanged)::bigint as unchanged, sum(total)::bigint as total, count(*) filter (removed + added > 0) as changed_items, coalesce(sum(hunks) filter (kind = 'function'), 0)::bigint as function_hunks,
coalesce(sum(removed) filter (kind = 'function'), 0)::bigint as function_removed, coalesce(sum(added) filter (kind = 'function'), 0)::bigint as function_added, coalesce(sum(unchanged) filter (kind = 'function'), 0)::bigint as function_unchanged, coalesce(sum(total) filter (kind = 'function'), 0)::bigint as function_total, count(*) filter (removed + added > 0 and kind = 'function') as changed_functions from i group by pair_id"""
)
def a6_rollup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    items = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_linenumber") == 1, "header").otherwise("function").alias("kind"), (q % 3).alias("hunks"), (q % 5).alias("removed"), (q % 4).alias("added"), q.alias("unchanged"), (q + 4).alias("total"))
    return A.rollup_items(items)


@query("select event_type, count(distinct user_id) as n, round(count(distinct user_id) * 100.0 / (select count(distinct user_id) from events), 6) as percent from events group by event_type")
def a7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(load(spark, sf_dir, "events"), "user_id", "event_type").withColumn("percent", F.round("percent", 6))


@query("select count(distinct l_partkey) as n from lineitem")
def a8_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_count(load(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    """with f as (select user_id, max((event_type = 'purchase' and value > 90)::int) as a, max((event_type = 'error' and value > 95)::int) as b, max((event_type = 'signup' and value > 80)::int) as c from events group by user_id),
p as (select user_id, 'buyer' as pattern, 0.3 * a + 0.3 * b as score, array_to_string(list_filter([case when a = 1 then 'purchase' end, case when b = 1 then 'error' end], lambda x: x is not null), ',') as evidence from f union all select user_id, 'starter', 0.5 * c, case when c = 1 then 'signup' else '' end from f)
select user_id, pattern, round(score::double, 6) as score, evidence from p where score >= 0.3"""
)
def a9_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    rules = [("buyer", "purchase", 0.3, (kind == "purchase") & (value > 90)), ("buyer", "error", 0.3, (kind == "error") & (value > 95)), ("starter", "signup", 0.5, (kind == "signup") & (value > 80))]
    return A.evidence_score(load(spark, sf_dir, "events"), "user_id", rules).select("user_id", "pattern", F.round("score", 6).alias("score"), F.array_join("evidence", ",").alias("evidence"))


@query("select event_type as operation, user_id, count(*) as n from (select user_id, case when event_type in ('click', 'view', 'purchase') then event_type else 'Other' end as event_type from events) group by all")
def a13_op_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.op_breakdown(load(spark, sf_dir, "events"), "user_id", "event_type", ("click", "view", "purchase"))


@query(
    """select user_id, count(*) as iterations, count(*) filter (event_type = 'purchase') as successes, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'error' and value > 50) as mismatches, count(distinct case when event_type = 'error' then props end) as unique_failures,
round(case when epoch_us(max(ts)) > epoch_us(min(ts)) then count(*) * 1000000.0::double / (epoch_us(max(ts)) - epoch_us(min(ts))) else 0.0 end, 12) as rate from events group by user_id"""
)
def a14_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = A.run_stats(load(spark, sf_dir, "events"), kind == "purchase", kind == "error", (kind == "error") & (F.col("value") > 50), F.when(kind == "error", F.col("props")), "ts", ["user_id"])
    return out.withColumn("rate", F.round("rate", 12))


@query(
    """with c as (select l_orderkey as suite_id, l_linenumber as check_no, l_shipdate::date::varchar as statement, l_quantity < 45 as passed, l_tax as elapsed_ms from lineitem)
select suite_id, bool_and(passed) as valid, count(*) filter (passed) as proven, count(*) as total, round(count(*) filter (passed) / count(*)::double, 9) as success_rate, round(sum(elapsed_ms), 6) as elapsed_ms, sha256(string_agg(statement || '=' || passed::varchar, chr(10) order by check_no, statement || '=' || passed::varchar)) as digest from c group by suite_id"""
)
def a15_check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("suite_id"), F.col("l_linenumber").alias("check_no"), F.to_date("l_shipdate").cast("string").alias("statement"), (F.col("l_quantity") < 45).alias("passed"), F.col("l_tax").alias("elapsed_ms"))
    return A.check_rollup(checks).withColumn("success_rate", F.round("success_rate", 9)).withColumn("elapsed_ms", F.round("elapsed_ms", 6))


@query("select c_mktsegment, len, value, min(c_custkey) as first_seen from (select c_mktsegment, c_custkey, length(to_hex(c_nationkey)) as len, lower(to_hex(c_nationkey)) as value from customer) group by all")
def a19_literals_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.lower(F.hex("c_nationkey"))
    rows = load(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.length(value).cast("long").alias("len"), value.alias("value"))
    return A.literals_by_width(rows, "len", "value", "c_custkey", ["c_mktsegment"])


@query(
    """with e as (select user_id, event_id, event_type, case when event_type in ('click', 'view') then case when event_type = 'view' then 1 else -1 end else 0 end * value::bigint as d from events)
select user_id, count(*) filter (d <> 0) as modified, count(distinct case when d <> 0 then event_type end) as nodes, sum(greatest(d, 0))::bigint as added, sum(greatest(-d, 0))::bigint as removed, count(*) filter (event_type = 'signup') as remapped, count(*) filter (d <> 0) = 0 and count(*) filter (event_type = 'signup') = 0 as nothing_recorded from e group by user_id"""
)
def a22_group_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    signed = F.when(kind == "view", 1).when(kind == "click", -1).otherwise(0) * F.rint("value").cast("long")
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", signed.alias("d"))
    return A.group_change_summary(rows, "user_id", "event_type", "d", kind == "signup")
