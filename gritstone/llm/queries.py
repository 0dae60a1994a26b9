"""The queries over the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.collocations import collocations
from gritstone.llm.decontamination import benchmark_hits
from gritstone.llm.filter_audit import filter_audit
from gritstone.llm.language_id import identify
from gritstone.llm.near_dedup import classes
from gritstone.llm.packing import pack
from gritstone.llm.pseudo_likelihood import pseudo_likelihood
from gritstone.llm.repetition import repetition_rules
from gritstone.llm.secret_scan import joined, scan_secrets
from gritstone.llm.substring_dedup import substring_dedup
from gritstone.llm.token_output import packed_rows
from gritstone.llm.toxicity import score_toxicity
from gritstone.llm.url_cascade import filter_urls, rule_table

#: (verdict, host, path) of the url query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, usable=remainder(5) != 0)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = identify(docs, docs.filter(remainder(3) != 1))
    return named.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_decontamination": op2_decontamination,
    "op3_url_cascade": op3_url_cascade,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_output": op9_token_output,
    "op10_language_id": op10_language_id,
    "op11_secret_scan": op11_secret_scan,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op1_repetition": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
five as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i + 4], ' ')) as n from p where i + 4 <= len(w)),
hit as (select doc_id, count(distinct i + k) as n from five, (select unnest(range(5)) as k) where n > 1 group by doc_id),
long as (select distinct doc_id from (select doc_id, count(*) as n from p where i + 100 <= len(w) and doc_id in (select doc_id from hit where n > 101) group by doc_id, array_to_string(w[i:i + 100], ' ')) where n > 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, sum(n - 1) as n from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by doc_id),
s as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words,
  long.doc_id is not null as long from d left join dup using (doc_id) left join hit using (doc_id) left join long using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not long as kept from s""",
    "op2_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as key from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as key from p, (select distinct n from bw) where i + n - 1 <= len(w)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.key = bw.key),
h as (select doc_id, count(distinct i + k) as n from hit, (select unnest(range(10)) as k) where k < n group by doc_id),
it as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join h using (doc_id) left join it using (doc_id)""",
    "op3_url_cascade": r"""
with r(verdict, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from a),
f as (select u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.page_id)
select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join f using (page_id)""",
    "op5_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w[i] as word, i, len(w) as n, array_to_string(w[i:i + 12], ' ') as key from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
k as (select key, min(doc_id) as first from p where i + 12 <= n group by key),
s as (select p.doc_id, p.i from p join k using (key) where p.i + 12 <= p.n and k.first < p.doc_id),
gone as (select distinct doc_id, i + j as i from s, (select unnest(range(13)) as j)),
kept as (select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.i) as text from p left join gone on p.doc_id = gone.doc_id and p.i = gone.i where gone.doc_id is null group by p.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op8_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)""",
    "op12_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
i as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
f as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k as size, count(*) as f from i, (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(w) group by all),
t as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, phrase, size, f, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
held as (select lang, phrase, max(f) as most from (select lang, array_to_string(w[1:2], ' ') as phrase, f from c where size = 3 union all select lang, array_to_string(w[2:3], ' '), f from c where size = 3) group by all),
k as (select c.*, unnest(range(1, size)) as k from c),
s as (select k.lang, k.phrase, k.f as a, k, x.f as l, y.f as r, ((1000000::hugeint * k.f * k.f) // (x.f::hugeint * y.f))::bigint as score from k join f x on x.lang = k.lang and x.phrase = array_to_string(w[1:k], ' ') and x.size = k.k
  join f y on y.lang = k.lang and y.phrase = array_to_string(w[k + 1:], ' ') and y.size = k.size - k.k),
b as (select lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, score * 10 + k) as b from s group by all),
g as (select b.lang, b.phrase, a, b.l, b.r, b.score from b left join held on held.lang = b.lang and held.phrase = b.phrase where most is null or 100 * most < 50 * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from g)
select lang, rank, phrase, a, l, r, n, score from r join t using (lang) where rank <= 2000""",
    "op13_filter_audit": r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
d as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, row_number() over () as id from t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) = 1 as good, coalesce(toxic, 0) = 1 as toxic, len(w) < 100 as "A", 100 * len(list_distinct(w)) < 80 * len(w) as "B",
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as "C", regexp_matches(text, '[#$%&*|]') as "D",
  coalesce(d.doc_id > min(d.doc_id) over (partition by text), false) as "E" from d left join l on l.doc_id = d.doc_id),
m as (select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: (x = 'A' and "A") or (x = 'B' and "B") or (x = 'C' and "C") or (x = 'D' and "D") or (x = 'E' and "E")) as fails from f),
c as (select part, good, toxic, fails, count(*) as n from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select part, filter_order, step, filter_order[step] as own, good, toxic, fails, n, len(list_filter(fails, lambda y: instr(filter_order, y) < step)) > 0 as gone from c, o, (select unnest(range(1, 6))::int as step)),
r as (select part, filter_order, step, own, sum(case when not gone and not list_contains(fails, own) then n else 0 end)::bigint as kept, sum(case when not gone and list_contains(fails, own) then n else 0 end)::bigint as removed,
  sum(case when gone and list_contains(fails, own) then n else 0 end)::bigint as redundant, sum(case when fails = [own] then n else 0 end)::bigint as unique_fails,
  sum(case when not gone and list_contains(fails, own) and good then n else 0 end)::bigint as good_lost, sum(case when not gone and list_contains(fails, own) and toxic then n else 0 end)::bigint as toxic_lost from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r""",
}
