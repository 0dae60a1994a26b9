"""Operators against brute force on small fixtures with nulls, empty texts, copies, ties and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gritstone.llm import decontamination, language_id, near_dedup, packing, pseudo_likelihood, repetition, substring_dedup, token_output, toxicity, url_cascade
from gritstone.llm._tokens import Encoder, default_tokenizer

PLAIN = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchors string, spans string, comp int"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts of a small vocabulary, copies, near copies, shared passages, repeated lines, edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["été", "ñu", "The"]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = make(20)
    texts: list[str | None] = [None, "", "   \n\t", "one", "a b c d", "a b c d", make(4000), "x " * 60, "l1 l2 l3\n" * 12]
    while len(texts) < n:
        kind = rng.random()
        base = rng.choice([t for t in texts if t and len(t) > 100] or [make(80)])
        if kind < 0.35:
            texts.append(make(rng.randint(1, 150)))
        elif kind < 0.5:
            texts.append(base)
        elif kind < 0.75:
            words = base.split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(make(rng.randint(5, 40)) + "\n" + passage + " " + make(rng.randint(5, 40)))
    return [(k, t, "en", "s", len(t or ""), "x", "y", 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in corpus()}


def test_repetition(docs, empty):
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(docs).collect()}
    assert len(rows) == len(TEXTS)
    for k, t in TEXTS.items():
        w = PLAIN.findall(t)
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if PLAIN.search(x)]
        longest = max((n for n in range(len(w)) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), default=0) if len(w) < 80 else None
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        if longest is not None and longest >= 5:
            assert r["longest_repeat"] == longest
    assert repetition.repetition_rules(empty).count() == 0 and repetition.keep_unrepetitive(empty).count() == 0
    kept = repetition.keep_unrepetitive(docs)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["kept"]}


ITEMS = [(1, "w1 w2 w3"), (2, " ".join(f"w{k}" for k in range(20, 45))), (10, None), (11, "???"), (12, "w1 w2 w3"), (13, "one")]


def test_decontamination(spark, docs, empty):
    words = " ".join(f"w{k}" for k in range(25, 37))
    extra = spark.createDataFrame([(100, "pre W1, w2; w3 post end", "en", "s", 1, "x", "y", 1), (101, words, "en", "s", 1, "x", "y", 1)], SCHEMA)
    every = docs.unionByName(extra)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    for block_words in (2_000_000, 20):  # one automaton, and several blocks of items
        rows = {r["doc_id"]: r for r in decontamination.benchmark_hits(every, bench, block_words=block_words).collect()}
        for k, t in texts.items():
            w, hit, found = ALNUM.findall(lower(t)), set(), set()
            for item, x in ITEMS:
                v = ALNUM.findall(lower(x or ""))
                n = min(10, len(v))
                wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in wanted:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
            r = rows[k]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            runs = {tuple(v[i : i + n]) for _, x in ITEMS for v in [ALNUM.findall(lower(x or ""))] for n in range(1, len(v) + 1) for i in range(len(v) - n + 1)}
            longest = max((n for i in range(len(w)) for n in range(1, min(25, len(w) - i) + 1) if tuple(w[i : i + n]) in runs), default=0)
            assert r["longest_match"] == (longest if longest >= 10 else 0)
    left = {r["doc_id"]: r for r in decontamination.remove_benchmark(every, bench).collect()}
    blocks = {r["doc_id"]: r for r in decontamination.remove_benchmark(every.withColumn("row_key", F.lit(1)), bench, block_words=8).drop("row_key").collect()}
    assert blocks == left
    assert 101 not in left and left[100]["text"] == "pre post end" and left[100]["n_chars"] == 12
    assert left[0]["text"] is None and left[6]["doc_id"] == 6
    assert decontamination.benchmark_hits(empty, bench).count() == 0
    none = decontamination.benchmark_hits(docs, bench.filter("false"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(TEXTS)


def test_url_cascade(spark):
    rng = random.Random(2)
    hosts = ["a.net", "x.example.net", "example.com", "b.example.com", "fr.org", "q.org", "other.io", "NET", "net", "deep.a.b.net"]
    urls = [None, "", "nothing", "http://", "://a.net/", "http://a.net", "http://a.net?x/", "http://A.Net/x#y", "http://user@x.org:80/fr/"] + [f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'fr/', 'en', '', 'x/en/'])}{k}" for k in range(300)]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_cascade.filter_urls(pages, url_cascade.rule_table(spark, rules)).collect()}
    for k, u in enumerate(urls):
        rest = u[u.index("://") + 3 :] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        assert got[k] == (host, path, rule, verdict), u
    assert url_cascade.filter_urls(pages.filter("false"), url_cascade.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_cascade.filter_urls(pages, url_cascade.rule_table(spark, [])).collect()} == {"allow"}


def test_cascade_is_exact_on_a_large_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("substring(key, -2) = '77'").unionByName(spark.range(1).select(F.lit("elsewhere").alias("key")))
    (c,) = url_cascade.build_cascades(listed, universe)
    wrong = universe.filter(c.holds(F.col("key")) != (F.substring("key", -2, 2) == "77"))
    assert wrong.count() == 0 and len(c.levels) > 1
    parts = list(url_cascade.build_cascades(listed, universe, max_keys=7))  # a listing over the bound is split
    assert len(parts) > 4
    held = [universe.filter(c.holds(F.col("key"))).count() for c in parts]
    assert sum(held) == 40 and max(held) < 40
    every = F.lit(False)
    for c in parts:
        every |= c.holds(F.col("key"))
    assert universe.filter(every != (F.substring("key", -2, 2) == "77")).count() == 0


def test_a_million_url_rules(spark):
    k = F.col("id")
    block = spark.range(700_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), k, F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    allow = spark.range(300_000).select(F.lit("allow"), F.concat(F.lit("h"), k, F.lit(".org")), F.concat(F.lit("/"), k % 50, F.lit("/")))
    odd = spark.createDataFrame([(None, "h1.org", "/"), ("block", None, "/"), ("block", "h2.org", None), ("other", "h3.org", "/3/9")], "verdict string, host string, path string")
    rules = block.union(allow).union(odd)
    pages = spark.range(0, 1_000_000, 4000).select(k.alias("page_id"), F.concat(F.lit("https://www.H"), k, F.lit(".org/"), k % 50, F.lit("/x")).alias("url"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.filter_urls(pages, rules).collect()}
    assert len(got) == 250
    for n, found in got.items():
        want = (f"h{n}.org/{n % 50}/", "allow") if n < 300_000 else (f"h{n}.org/", "block") if n < 700_000 else (None, "allow")
        assert found == want
    assert url_cascade.filter_urls(pages, odd).filter("rule is not null").count() == 0


def test_url_rules_of_a_split_listing(spark):
    hosts = [f"h{k}.org" for k in range(30)]
    rules = [("block", h, "/a") for h in hosts[:20]] + [("allow", h, "/a/b") for h in hosts[10:]]
    pages = spark.createDataFrame([(k, f"https://x.{hosts[k % 30]}/a{'/b' if k % 2 else ''}") for k in range(90)] + [(5, f"https://x.{hosts[5]}/a/b")], "page_id long, url string").withColumn("keys", F.lit("clash"))
    table = url_cascade.rule_table(spark, rules)
    whole = sorted(tuple(r) for r in url_cascade.filter_urls(pages, table).collect())
    assert whole == sorted(tuple(r) for r in url_cascade.filter_urls(pages, table, max_keys=4).collect()) and len(whole) == 91
    for k, _, _, rule, verdict in whole:
        n = k % 30
        want = ("allow", f"{hosts[n]}/a/b") if n >= 10 and k % 2 else ("block", f"{hosts[n]}/a") if n < 20 else ("allow", None)
        assert (verdict, rule) == want


def removed_by_hand(texts: dict[int, str], k: int = 13) -> dict[int, tuple[int, int, str]]:
    words = {d: PLAIN.findall(t) for d, t in texts.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 5])
def test_substring_dedup(spark, empty, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = removed_by_hand({r[0]: r[1] or "" for r in rows})
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(df).collect()}
    assert got == want
    left = {r["doc_id"]: r for r in substring_dedup.remove_repeated(df).collect()}
    for d, (n, gone, sha) in want.items():
        if n and gone == n:
            assert d not in left
        else:
            assert hashlib.sha256(" ".join(PLAIN.findall(left[d]["text"] or "")).encode()).hexdigest() == sha
    assert substring_dedup.substring_dedup(empty).count() == 0 and substring_dedup.remove_repeated(empty).count() == 0


def test_substring_dedup_with_repeated_rows_and_null_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, "a " + text), (None, text), (None, None)]
    got = sorted(tuple(r)[1:3] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (30, 0), (30, 0), (30, 0), (31, 30)]


def test_substring_dedup_judges_each_row(spark):
    """Rows of one doc_id with different texts: each is cut by what documents with smaller ids have, and no other."""
    v = lambda a, b: " ".join(f"v{k}" for k in range(a, b))
    rows = [(1, v(0, 40)), (2, "p q " + v(5, 30)), (2, v(0, 40)), (2, "only " + v(100, 120)), (3, v(100, 120) + " end"), (3, v(0, 14)), (3, "r s " + v(5, 30) + " " + v(100, 116))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_marks", F.lit("clash")).withColumn("spans", F.lit("clash"))
    want = []
    for d, t in rows:
        w = t.split()
        earlier = {tuple(x[i : i + 13]) for e, y in rows if e < d for x in [y.split()] for i in range(len(x) - 12)}
        gone = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in earlier for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(df).collect())
    assert got == sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in want)
    left = sorted((r["doc_id"], r["text"].strip()) for r in substring_dedup.remove_repeated(df).collect())
    assert left == sorted((d, kept) for d, n, gone, kept in want if kept)


def classes_by_hand(texts: dict[int, str]) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for d, t in texts.items():
        w = PLAIN.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


@pytest.mark.parametrize("max_rounds", [4, 0])
def test_near_dedup(spark, docs, empty, max_rounds):
    want = classes_by_hand(TEXTS)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.classes(docs, max_rounds=max_rounds).collect()}
    assert got == want
    if max_rounds:
        left = near_dedup.near_dedup(docs)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {d for d, x in want.items() if x[2]}
        assert near_dedup.classes(empty).count() == 0


def test_near_dedup_of_a_group_around_a_missing_middle(spark):
    """Copies of one text that is not there itself: some link, others are a little too far apart."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    texts = {}
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.classes(df).collect()} == classes_by_hand(texts)


def ids_of(texts: dict[int, str], end: int) -> dict[int, list[int]]:
    t = Encoder(default_tokenizer()).tokenizer
    return {d: t.encode(x, add_special_tokens=False).ids + [end] for d, x in texts.items()}


def test_packing(docs, empty):
    want = ids_of(TEXTS, 2)
    rows = packing.pack(docs, shard=50).toPandas()
    for d, own in rows.sort_values("piece").groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            part = want[d][r.start : r.start + r.length]
            assert r.start == at and (r.piece == 0 or r.length == 1024) and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want[d])
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() <= 1024
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_places_by_the_rule():
    """Each piece where the squared counts of open sequences by gap become smallest, a new one only where none fits; of equal ones the smallest gap."""
    rng = random.Random(5)
    size = 40
    lengths = sorted((rng.randint(1, size) for _ in range(400)), reverse=True)
    sequence, offset = packing.sum_of_squares(np.array(lengths), size)
    gaps: dict[int, int] = {}  # of sequences
    for k, s in enumerate(lengths):
        count = defaultdict(int)
        for g in gaps.values():
            count[g] += g > 0
        choices = {}
        for g in {g for g in gaps.values() if g >= s}:
            after = dict(count)
            after[g] = after[g] - 1
            if g > s:
                after[g - s] = after.get(g - s, 0) + 1
            choices[g] = sum(v * v for v in after.values())
        own = int(sequence[k])
        if not choices:
            assert own not in gaps and offset[k] == 0
            gaps[own] = size
        else:
            assert gaps[own] == min(choices, key=lambda g: (choices[g], g))
        assert offset[k] == size - gaps[own]
        gaps[own] -= s


def test_sum_of_squares_wastes_little():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1024, 3000))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 1024)
    assert np.bincount(sequence, lengths).max() <= 1024
    assert sequence.max() + 1 <= 1.01 * -(-lengths.sum() // 1024)


def test_token_output(docs, empty):
    want = ids_of(TEXTS, 50256)
    table = token_output.packed_rows(docs, size=256).toArrow()
    matrix, places = token_output.read_matrix(table), token_output.position_ids(table, 256)
    assert matrix.shape == (table.num_rows, 256)
    got = defaultdict(dict)
    for k, r in enumerate(table.to_pylist()):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and r["position_resets"] == cu[:-1]
        assert all(places[k, a] == 0 for a in cu[:-1]) and (matrix[k, cu[-1] :] == 50256).all()
        for d, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            got[d][start] = matrix[k, a:b].tolist()
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in got.items()} == want
    assert token_output.packed_rows(empty).count() == 0


def test_segment_tree():
    rng, tree, rooms = random.Random(3), token_output.RoomTree(50), []
    for _ in range(500):
        if rooms and rng.random() < 0.4:
            r = rooms.pop(rng.randrange(len(rooms)))
            tree.add(r, -1)
        else:
            rooms.append(rng.randint(1, 50))
            tree.add(rooms[-1], 1)
        need = rng.randint(1, 50)
        assert tree.least(need) == min((r for r in rooms if r >= need), default=0)


def test_language_id(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    more = spark.createDataFrame([(9001, None, None), (9002, "", None), (9003, "123 !?", "en"), (9004, "É", None)], "doc_id long, text string, lang string")
    rows = language_id.identify(df.select("doc_id", "text", "lang").unionByName(more), df.filter(~held)).join(df.filter(held).select("doc_id", "lang"), "doc_id", "left").collect()
    judged = [r for r in rows if r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.98 * len(judged)
    edge = {r["doc_id"]: r for r in rows if r["doc_id"] > 9000}
    assert [edge[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and edge[9004]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    untrained = language_id.identify(more, empty)
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}


def kneser_ney(words: list[str], order: int):
    """Interpolated Kneser-Ney by dictionaries: the probability of a symbol after a context of at most order - 1 symbols."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]  # counts[m][context of m - 1 symbols][symbol]
    begins = defaultdict(int)
    for w in words:
        text = "^" + w + "^"
        for i in range(1, len(text)):
            n = min(i + 1, order)
            if n == order:
                counts[order][text[i - n + 1 : i]][text[i]] += 1
            else:
                begins[text[: i + 1]] += 1  # shorter, as the word begins: counted as it stands
    for m in range(order - 1, 0, -1):
        seen = defaultdict(set)
        for context, after in counts[m + 1].items():
            for x in after:
                seen[context[1:] + x].add(context[0])
        for gram, before in seen.items():
            counts[m][gram[:-1]][gram[-1]] += len(before)
        for gram, n in begins.items():
            if len(gram) == m:
                counts[m][gram[:-1]][gram[-1]] += n
    alphabet = {x for after in counts[1].values() for x in after}
    discount = {}
    for m in range(1, order + 1):
        every = [n for after in counts[m].values() for n in after.values()]
        once, twice = every.count(1), every.count(2)
        discount[m] = once / (once + 2 * twice) if once else 0.5

    def p(symbol: str, context: str, m: int) -> float:
        if m == 0:
            return 1 / (len(alphabet) + 1)
        after = counts[m].get(context[len(context) - m + 1 :] if m > 1 else "")
        below = p(symbol, context, m - 1)
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(symbol, 0) - discount[m], 0) / total + discount[m] * len(after) / total * below

    return p, alphabet


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_against_dictionaries(order):
    rng = random.Random(order)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = " ".join(words)
    sym, starts, ends, _ = language_id.letter_words(text, np.array([0, len(text)]))
    key, _, _ = language_id.grams(sym, starts, ends, order)
    u, c = np.unique(key, return_counts=True)
    model = language_id.KneserNey(["x"], np.zeros(len(u), np.int64), u, c, order)
    p, alphabet = kneser_ney(words, order)
    tests = ["abcd", "ddda", "a", "zab", "bzzb", "cabbage", "dd cab"]
    h, size = model.entropies(pa.array(tests))
    for k, t in enumerate(tests):
        logs = []
        for w in t.split():
            line = "^" + w + "^"
            logs += [np.log(p(line[i], line[max(0, i - order + 1) : i], min(i + 1, order))) for i in range(1, len(line))]
        assert size[k] == len(logs) and abs(h[k, 0] + np.mean(logs)) < 1e-5
    for context in ("ab", "^a", "zz", "dc"):
        own = context[-(order - 1) :]
        code = {"^": language_id.MARK} | {x: ord(x) for x in "abcdz"}
        base = 0
        for x in own:
            base = (base << language_id.BITS) | code[x]
        keys = np.array([(base << language_id.BITS) | code[x] for x in [*sorted(alphabet), "z"]], np.uint64)  # z stands for all that was never seen
        assert abs(np.exp(model.score(keys, np.full(len(keys), len(own) + 1)).astype(np.float64)).sum() - 1) < 1e-5


def test_languages_in_blocks(spark):
    """Many languages: the same result with all in one table and in blocks; nothing crashes with 1,500."""
    rng = random.Random(12)
    kinds = {f"l{k:02d}": [rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 2) + rng.choice("aeiou") for _ in range(8)] for k in range(12)}
    rows = [(k, " ".join(rng.choices(kinds[name], k=30)), name) for k, name in enumerate(list(kinds) * 8)] + [(900, None, None), (901, "12", "l00"), (901, "12", "l00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit("clash"))
    one = sorted(tuple(r)[:4] for r in language_id.identify(df).collect())
    more = sorted(tuple(r)[:4] for r in language_id.identify(df, max_cells=2000).collect())
    assert [r[:2] for r in one] == [r[:2] for r in more] and len(one) == len(rows)
    assert np.allclose([r[2:] for r in one], [r[2:] for r in more], atol=1e-4)
    assert sum(r[1] == rows[r[0]][2] for r in one if r[0] < 96) > 80
    many = spark.createDataFrame([(k, f"w{'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10 % 10]}x common words", f"x{k}") for k in range(1500)], "doc_id long, text string, lang string")
    assert language_id.identify(many, max_cells=2_000_000).filter("lang_pred <> 'und'").count() == 1500


def test_toxicity(spark, empty):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = toxicity.score_toxicity(df, labels, usable=~held).join(labels, "doc_id").filter(held).collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above > 0.85
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    scores = toxicity.score_toxicity(edge, labels.filter("false")).collect()
    assert [r["score"] for r in scores] == [0.5] * 3
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    m, y = rng.normal(size=200).round(1), (rng.random(200) < 0.4).astype(float)
    x, p = toxicity.isotonic(m, y)
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    values = np.unique(m)  # the least-squares fit: for each value the largest mean of what ends at it, over the smallest of what begins there
    mean = lambda a, b: y[(m >= a) & (m <= b)].mean()
    fit = [max(min(mean(a, b) for b in values[values >= v]) for a in values[values <= v]) for v in values]
    runs = {}
    for v, f in zip(values, fit, strict=True):
        runs.setdefault(round(f, 9), []).append(v)
    for own in runs.values():
        n = (m >= own[0]) & (m <= own[-1])
        assert abs(np.interp(own[0], x, p) - (y[n].sum() + 0.25) / (n.sum() + 0.5)) < 0.2  # smoothed, then made monotone
        assert np.interp(own[0], x, p) == np.interp(own[-1], x, p)


def features_by_hand(text: str, lexicon: dict[str, float], near: int = 4) -> list[float]:
    words = ALNUM.findall(lower(text))
    n = max(1, len(words))
    hits = [k for k, w in enumerate(words) if w in lexicon]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    close = [k for k in hits if any(abs(k - y) <= near for y in you)]
    undone = re.findall("[^\x00-\x60\x7b-\x7f]+", "".join(toxicity.SUBSTITUTES.get(c, lower(c)) for c in text))
    more = max(0, sum(w in lexicon for w in undone) - len(hits))
    data, plain = text.encode(), PLAIN.findall(text)
    letter = [65 <= b <= 90 or 97 <= b <= 122 or b > 0x80 for b in data]
    size = max(1, sum(len(w.encode()) for w in plain))
    inside = [k for k in range(1, len(data) - 1) if letter[k - 1] and letter[k + 1]]
    caps = lambda w: [c for c in w if "A" <= c <= "Z"]
    letters = lambda w: [b for b in w.encode() if 65 <= b <= 90 or 97 <= b <= 122 or b > 0x80]
    shouted = sum(len(caps(w)) >= 3 and len(caps(w)) == len(letters(w)) for w in plain)
    drawn = sum(letter[k] and data[k] < 128 and data[k] == data[k - 1] == data[k - 2] for k in range(2, len(data)))
    return [
        np.log1p(len(words)), len(hits) / n, len(hits), sum(lexicon[words[k]] for k in hits) / n, max([lexicon[words[k]] for k in hits], default=0), len({words[k] for k in hits}), more / n, more, len(close) / n, len(close), len(you) / n,
        len(caps(text)) / size, shouted / max(1, len(plain)), data.count(b"!") / size, data.count(b"?") / size, sum(b in b",.;:-()\"'" for b in data) / size,
        sum(data[k] in b"@$*#!|+" for k in inside) / size, sum(48 <= data[k] <= 57 for k in inside) / size, drawn / size, size / max(1, len(plain)),
    ]


def test_toxic_features_by_loops():
    rng = random.Random(6)
    lexicon = {"vile": 2.0, "scum": 1.5, "öde": 0.8}
    parts = ["vile", "V1LE", "sc*m", "Scum", "you", "YOU", "dich", "öde", "nice", "AAAH", "soooo", "b@d", "w0rd", "!", "??", "a-b", "(c)", "\n", "x.y", "été", "4pples"]
    texts: list[str | None] = [None, "", "vile", "  \n"] + [" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200)]
    got = toxicity.Features(lexicon).rows(pa.array(texts))
    want = np.array([features_by_hand(t or "", lexicon) for t in texts])
    assert np.allclose(got, want, atol=1e-5)


def test_trees_by_loops():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).astype(np.float32).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = toxicity.Trees(rounds=30).fit(x, y)
    for k in range(0, 400, 7):
        z = t.start
        for feature, limit, value in t.trees:
            node = 0
            for _ in range(t.depth):
                right = feature[node] >= 0 and x[k, feature[node]] > limit[node]
                node = 2 * node + (2 if right else 1)
            z += value[node - (2**t.depth - 1)]
        assert abs(z - t.margin(x[k : k + 1])[0]) < 1e-9
    # the first split: the best of all features and cuts by the gain of the logistic loss
    one = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    gain = lambda own: ((p - y[own]).sum()) ** 2 / (own.sum() * p * (1 - p) + one.ridge)
    every = np.ones(len(y), bool)
    best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) - gain(every) for j in range(5) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])))
    j, c = one.trees[0][0][0], one.trees[0][1][0]
    assert abs(gain(x[:, j] <= c) + gain(x[:, j] > c) - gain(every) - best) < 1e-6
    assert ((t.margin(x) > 0) == (y > 0.5)).mean() > 0.95


def test_toxicity_is_reproducible(spark):
    """Several labels of one doc_id: the highest counts, in whatever order rows come."""
    docs = spark.createDataFrame([(k, f"you are {'vile scum' if k % 3 == 0 else 'kind'} number n{k} indeed") for k in range(300)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(k, 0) for k in range(0, 300, 3)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    one, two = (sorted(tuple(r) for r in toxicity.score_toxicity(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 5))
    assert one == two and all(r[2] == int(r[0] % 3 == 0) for r in one)


def test_pseudo_likelihood(spark, empty):
    rng = random.Random(5)
    regular = [(k, "the cat sat on the mat and the dog ran off " * 8) for k in range(150)]
    odd = [(1000 + k, " ".join(rng.sample(regular[0][1].split(), 80))) for k in range(20)]
    df = spark.createDataFrame(regular + odd + [(5000, None), (5001, "")], "doc_id long, text string").repartition(2)
    rows = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(df, rounds=3).collect()}
    assert np.mean([rows[k]["score_per_token"] for k, _ in regular]) > np.mean([rows[k]["score_per_token"] for k, _ in odd]) + 0.3
    assert rows[5000]["score"] == 0 and rows[5001]["score_per_token"] is None
    assert pseudo_likelihood.pseudo_likelihood(empty).count() == 0


def test_pseudo_likelihood_trains_on_every_token(spark):
    """Texts of eight words: each place of the text is predicted in training, so no word is unlikely."""
    df = spark.createDataFrame([(k, "a b c d e f g h") for k in range(3000)], "doc_id long, text string").coalesce(1)
    row = pseudo_likelihood.pseudo_likelihood(df, size=16).first()
    assert row["score_per_token"] > -1


def test_pseudo_likelihood_tells_rare_words_apart(spark):
    """Texts that differ in one word of a shared class differ by the logarithm of its count; copies of a row, and other texts under its id, change nothing."""
    text = lambda w: f"the cat {w} the cat"
    rows = [(k, text("often")) for k in range(30)] + [(40, text("rare")), (40, text("rare")), (40, text("odd")), (None, text("odd")), (50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pseudo_likelihood.pseudo_likelihood(df, common=2, buckets=1).collect()
    assert len(got) == len(rows)
    often = next(r["score"] for r in got if r["doc_id"] == 7)
    assert np.allclose([r["score"] for r in got if r["doc_id"] in (40, None)], often + np.log(2 / 30), atol=1e-4)
    assert [r["score"] for r in got if r["doc_id"] in (50, 51)] == [0, 0]


def test_pseudo_likelihood_words_of_a_class_sum_to_one(spark):
    """The words of one class, each in the same context, have the probability of their class together."""
    words = [f"w{k}" for k in range(12) for _ in range(k + 1)]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    score = {words[r["doc_id"]]: r["score"] for r in pseudo_likelihood.pseudo_likelihood(df, common=0, buckets=1).collect()}
    assert np.isclose(sum(np.exp(s) for s in score.values()), 1, atol=1e-4)


def test_network_probabilities_and_gradient():
    common, buckets = 10, 3
    net = pseudo_likelihood.Network(common, buckets, 2, 4, 6)
    net.flat[:] = np.random.default_rng(2).normal(0, 0.5, len(net.flat))
    around = np.random.default_rng(1).integers(0, common + buckets + 1, (50, 4))
    every = np.stack([net.log_probability(np.full(50, t), around) for t in range(common + buckets)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-5)
    for k in range(50):  # by loops
        x = [v for w in around[k] for v in net.embed[w]]
        h = [np.tanh(sum(x[i] * net.w1[i, j] for i in range(16)) + net.b1[j]) for j in range(6)]
        z = [sum(h[j] * net.w2[j, c] for j in range(6)) + net.b2[c] for c in range(buckets)]
        for t in range(common + buckets):
            c, slot = (t % buckets, t // buckets) if t < common else (t - common, net.slots - 1)
            used = [s for s in range(net.slots) if s == net.slots - 1 or s * buckets + c < common]
            y = {s: sum(h[j] * net.w3[c, j, s] for j in range(6)) + net.b3[c, s] for s in used}
            want = z[c] - np.log(sum(map(np.exp, z))) + y[slot] - np.log(sum(map(np.exp, y.values())))
            assert abs(every[t, k] - want) < 1e-4
    token = around[:, 1] % (common + buckets)
    grad = net.gradient(token, around)
    for at in np.random.default_rng(3).choice(len(net.flat), 40, replace=False).tolist():
        kept = net.flat[at]
        loss = []
        for step in (0.01, -0.01):
            net.flat[at] = kept + step
            loss.append(-net.log_probability(token, around).astype(np.float64).mean())
        net.flat[at] = kept
        assert abs((loss[0] - loss[1]) / 0.02 - grad[at]) < 2e-3
    before = net.log_probability(token, around).mean()
    for _ in range(60):
        net.learn(token, around, 0.1)
    assert net.log_probability(token, around).mean() > before + 0.5


def test_pseudo_likelihood_is_the_sum_of_its_words(spark):
    """The score of each text, word by word, from the counts of the corpus and the first weights (no round of training)."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = {k: " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(0, 30))) for k in range(60)}
    texts[60] = texts[3] + " onlyhere"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    counts = defaultdict(int)
    for t in texts.values():
        for w in t.split():
            counts[w] += 1
    hashes = {w: int(next(pseudo_likelihood.chunks(pa.array([w]), pseudo_likelihood.ALNUM)).word_hash()[0]) for w in counts}
    common, buckets = 7, 2
    ranked = sorted(counts, key=lambda w: (-counts[w], hashes[w]))
    number = {w: k if k < common else common + hashes[w] % buckets for k, w in enumerate(ranked)}
    others = [sum(n for w, n in counts.items() if number[w] == common + c) for c in range(buckets)]
    net = pseudo_likelihood.Network(common, buckets, 2, 16, 24)
    net.flat[:] = net.start(np.array([counts[w] for w in ranked[:common]]), np.array(others))
    for head in (1 << 17, 9):  # all counts in the tasks, and the rarer ones by a join
        got = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(df, common=common, buckets=buckets, width=16, hidden=24, rounds=0, head=head).collect()}
        for k, t in texts.items():
            words = t.split()
            ids = [common + buckets] * 2 + [number[w] for w in words] + [common + buckets] * 2
            want = 0.0
            for i, w in enumerate(words):
                around = np.array([[ids[i], ids[i + 1], ids[i + 3], ids[i + 4]]])
                want += float(net.log_probability(np.array([number[w]]), around)[0])
                if number[w] >= common:
                    want += np.log(counts[w] / others[number[w] - common])
            assert got[k]["n_tokens"] == len(words) and abs(got[k]["score"] - want) < 1e-3


def test_pseudo_likelihood_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([r[:2] for r in corpus(4, 80)], "doc_id long, text string")
    score = lambda n, parts: {r["doc_id"]: r["score_per_token"] or 0.0 for r in pseudo_likelihood.pseudo_likelihood(df.repartition(n), shard=2000, common=100, buckets=8, parts=parts).collect()}
    one, two, three = score(1, 20_000), score(7, 20_000), score(7, 2)  # the last with several shards in a task
    assert one.keys() == two.keys() == three.keys() and max(abs(one[k] - other[k]) for k in one for other in (two, three)) < 1e-5
    assert len({round(x, 3) for x in one.values()}) > 30


def test_pretokenizer_agrees_with_the_tokenizer():
    rng = random.Random(7)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "漢", "1", "٣", "!", "<|endoftext|>", " ", "😀", "'S", "\r\n", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    e = Encoder(default_tokenizer())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, ids, ptr in e.rows(pa.array(texts), 2):
        got += [ids[a : b - 1].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    assert got == want
