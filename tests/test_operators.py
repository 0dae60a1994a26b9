"""Small exact cases and invariants of the operators, and plan checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.functions import scalars as S
from gritstone.operators import aggregates as A
from gritstone.operators import checks as V
from gritstone.operators import graphs as G
from gritstone.operators import joins as J
from gritstone.operators import keyed as K
from gritstone.operators import parsing as U
from gritstone.operators import sequences as W
from gritstone.operators import similarity as D
from gritstone.plans.steps import Step, build_steps, run_pipeline
from gritstone.sources.corpus import read_code_corpus, read_failure_reports, read_trace_log, write_report

SEED = "ab" * 32


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def code_table(spark, *digits):
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(digits)], "code_id long, h string")
    return rows.select("code_id", F.unhex("h").alias("code"))


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v int")
    row = A.distribution_summary(df, "v", 100).first()
    assert (row["p25"], row["median"], row["p75"]) == (17.5, 25.0, 32.5) and row["ratio"] == 25.0


def test_summary_of_nothing_is_zero(spark):
    row = A.distribution_summary(spark.createDataFrame([], "v int"), "v", 100).first()
    assert (row["n"], row["mean"], row["std"], row["p95"]) == (0, 0.0, 0.0, 0.0)
    assert A.histogram(spark.createDataFrame([], "v int"), "v").collect() == []


def test_normalize_hex(spark):
    df = spark.createDataFrame([(" 0xAB C\n",), ("zz",), ("a_b",), (None,)], "x string")
    rows = df.select(S.normalize_hex(F.col("x")).alias("a"), S.normalize_hex(F.col("x"), strict=False).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("0ABC", None), (None, None), (None, "ab"), (None, None)]


def test_decode_known_codes(spark):
    instr = U.decode_instructions(code_table(spark, "600160ff0100", "", "61aa"))
    first = [(r["pc"], r["mnemonic"], r["imm"]) for r in instr.filter("code_id = 0").orderBy("idx").collect()]
    assert first == [(0, "PUSH1", "01"), (2, "PUSH1", "ff"), (4, "ADD", None), (5, "STOP", None)]
    assert instr.filter("code_id = 1").first()["mnemonic"] == "EMPTY"
    assert instr.filter("code_id = 2").count() == 0  # a PUSH cut off by the end


def test_blocks_and_metrics(spark):
    codes = code_table(spark, "600050", "6000600157600256", "00")
    instr = U.decode_instructions(codes)
    blocks, rows = U.block_table(instr)
    blocks = U.with_control(blocks, J.resolve_targets(instr, blocks), rows)
    got = {r["code_id"]: (r["blocks"], r["max_stack"]) for r in A.graph_size(blocks, G.build_edges(blocks)).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (1, 0)}
    assert {r["code_id"] for r in G.graph_metrics(codes, blocks, G.build_edges(blocks)).collect()} == {0, 1, 2}


def test_blocks_in_one_pass(spark):
    import random

    rng = random.Random(5)
    ops = [0x00, 0x01, 0x50, 0x56, 0x57, 0x58, 0x5B, 0x5F, 0x60, 0x60, 0x61, 0x67, 0x80, 0xF3, 0x0C]
    texts = ["", "60", "5b", "6003565b00", "600056", "60015801565b", "6001600201565b", "66ffffffffffffff56", "675656565656565656" + "56"]
    for _ in range(300):
        out = bytearray()
        for _ in range(rng.randrange(1, 60)):
            op = rng.choice(ops)
            out.append(op)
            if 0x60 <= op <= 0x7F:
                out += (bytes(op - 0x60) + bytes([rng.randrange(40)])) if rng.random() < 0.8 else rng.randbytes(op - 0x5F)
        texts.append(out[: rng.randrange(1, len(out) + 1)].hex())
    codes = spark.createDataFrame([(k, bytes.fromhex(x)) for k, x in enumerate(texts)] + [(len(texts), None)], "code_id int, code binary").coalesce(2)
    instr = U.decode_instructions(codes)
    blocks, rows = U.block_table(instr)
    want = U.with_control(blocks, J.resolve_targets(instr, blocks), rows)
    got = U.code_blocks(codes)
    assert got.columns == want.columns
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    assert {r["tag"] for r in got.select("control.tag").distinct().collect()} == {None, "Terminal", "Jump", "Branch", "Fallthrough", "Unknown"}
    assert U.code_blocks(codes.limit(0)).count() == 0


def test_longest_common_run(spark):
    pairs = spark.createDataFrame([(1, "abcdefg", "xyzabcuvw"), (2, "aaaa", "bbbb"), (3, "hello wide world", "say hello wide word"), (4, "", "x")], "pair_id int, a string, b string")
    got = {r["pair_id"]: (r["length"], r["content"]) for r in D.longest_common_run(pairs, "a", "b").collect()}
    assert got == {1: (3, "abc"), 2: (0, ""), 3: (14, "hello wide wor"), 4: (0, "")}


def test_longest_common_run_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("abc") for _ in range(40)), "".join(rng.choice("abc") for _ in range(40))) for k in range(30)]

    def brute(a, b):
        best = (0, 0)
        for j in range(len(b)):
            for n in range(len(b) - j, best[0], -1):
                if b[j : j + n] in a:
                    best = (n, j)
                    break
        return best[0], b[best[1] : best[1] + best[0]]

    got = {r["pair_id"]: (r["length"], r["content"]) for r in D.longest_common_run(spark.createDataFrame(rows, "pair_id int, a string, b string"), "a", "b").collect()}
    assert got == {k: brute(a, b) for k, a, b in rows}


def test_line_diffs_agree_on_totals(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "q"), (3, "", "")], "pair_id int, a string, b string")
    got = {r["pair_id"]: tuple(r)[1:] for r in D.line_diff_stats(pairs, "a", "b").collect()}
    assert got == {1: (2, 1, 2, 2, 3), 2: (1, 0, 1, 0, 0), 3: (0, 0, 0, 0, 0)}
    hunks = D.replacements(pairs, "a", "b").filter("pair_id = 1").orderBy("hunk_no").collect()
    assert [(r["before"], r["after"]) for r in hunks] == [(["b"], ["x"]), ([], ["d"])]


def diff_by_hand(p: list[str], q: list[str]) -> list[tuple[list[str], list[str]]]:
    """The hunks: lines unique on both sides that cross no other are anchors; equal lines are matched on from them, then back."""
    uni = [(i, q.index(x)) for i, x in enumerate(p) if p.count(x) == 1 and q.count(x) == 1]
    anchors = [(i, j) for i, j in uni if all((i < k) == (j < m) for k, m in uni if k != i)]
    match = {}
    marks = [(-1, -1), *anchors, (len(p), len(q))]
    for (i, j), (k, m) in zip(marks[:-1], marks[1:], strict=True):
        if i >= 0:
            match[i] = j
        n = 1
        while i + n < k and j + n < m and p[i + n] == q[j + n]:
            match[i + n] = j + n
            n += 1
        last, back = j + n - 1, 1
        while k - back > i + n - 1 and m - back > last and p[k - back] == q[m - back]:
            match[k - back] = m - back
            back += 1
    gaps: dict[int, tuple[list[str], list[str]]] = {}
    for i, x in enumerate(p):
        if i not in match:
            gaps.setdefault(sum(k < i for k in match), ([], []))[0].append(x)
    for j, x in enumerate(q):
        if j not in match.values():
            gaps.setdefault(sum(m < j for m in match.values()), ([], []))[1].append(x)
    assert [match[i] for i in sorted(match)] == sorted(match.values())
    return [gaps[g] for g in sorted(gaps)]


def test_ordered_diff_against_loops(spark):
    import random

    rng = random.Random(3)
    rows = [(0, None, "x"), (1, "", ""), (2, "a\nb", None), (3, "same\ntext", "same\ntext")]
    for k in range(4, 80):
        p = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 15))]
        q = list(p)
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randrange(len(q) + 1), rng.random()
            if kind < 0.4:
                q.insert(at, rng.choice("abcxyz"))
            elif kind < 0.7 and q:
                q.pop(at % len(q))
            elif q:
                q.insert(at, q.pop(rng.randrange(len(q))))
        rows.append((k, "\n".join(p), "\n".join(q)))
    pairs = spark.createDataFrame(rows, "pair_id int, a string, b string")
    stats = {r["pair_id"]: tuple(r)[1:] for r in D.line_diff_stats(pairs, "a", "b").collect()}
    hunks: dict[int, list] = {}
    for r in D.replacements(pairs, "a", "b").orderBy("pair_id", "hunk_no").collect():
        hunks.setdefault(r["pair_id"], []).append((r["before"], r["after"]))
    for k, a, b in rows:
        p, q = (x.split("\n") if x else [] for x in (a, b))
        want = diff_by_hand(p, q)
        assert hunks.get(k, []) == want
        removed, added = (sum(len(h[s]) for h in want) for s in (0, 1))
        assert stats[k] == (len(want), removed, added, len(p) - removed, len(p))


def test_longest_common_run_of_short_and_repeated_texts(spark):
    pairs = spark.createDataFrame([(1, "ab" * 300, "xx" + "ab" * 20 + "y"), (2, "abcabcabd", "abd"), (3, "xyz" * 5, "zzyxx"), (4, None, "a"), (5, "é漢é漢", "漢é")], "pair_id int, a string, b string")
    got = {r["pair_id"]: (r["length"], r["content"], r["at_b"]) for r in D.longest_common_run(pairs, "a", "b").collect()}
    assert got == {1: (40, "ab" * 20, 2), 2: (3, "abd", 0), 3: (2, "zx", 3) if "zx" in "zzyxx" else (1, "z", 0), 4: (0, "", None), 5: (2, "漢é", 0)}


def test_longest_common_run_of_repeated_megabytes(spark):
    """Texts of a million characters that repeat two: no more work than others; one of them has a run broken in the middle."""
    rows = [(1, "ab" * 500_000, "xx" + "ab" * 499_000 + "y"), (2, "a" * 300_000, "a" * 150_000 + "é" + "a" * 150_001), (3, None, ""), (4, "é" * 5, "é" * 5)] + [(k, "abc" * k, "cab" * k) for k in range(5, 60)]
    pairs = spark.createDataFrame(rows, "pair_id int, a string, b string").repartition(2)
    got = {r["pair_id"]: (r["length"], r["at_b"], len(r["content"])) for r in D.longest_common_run(pairs, "a", "b").collect()}
    assert got[1] == (998_000, 2, 998_000) and got[2] == (150_001, 150_001, 150_001) and got[3] == (0, None, 0) and got[4] == (5, 0, 5)
    assert all(got[k] == (3 * k - 1, 1, 3 * k - 1) for k in range(5, 60))
    assert D.longest_common_run(pairs.limit(0), "a", "b").count() == 0


def test_longest_common_run_against_sql(spark):
    """Every window of every length of both sides in SQL."""
    import random

    import duckdb

    rng = random.Random(30)
    rows = [(k, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    c = duckdb.connect()
    c.execute("create table pairs(pair_id int, a varchar, b varchar)")
    c.executemany("insert into pairs values (?, ?, ?)", rows)
    sql = """with wa as (select distinct pair_id, substr(a, i, n) as w from (select pair_id, a, i, unnest(range(1, length(a) - i + 2)) as n from (select pair_id, a, unnest(range(1, length(a) + 1)) as i from pairs))),
    wb as (select pair_id, j, substr(b, j, n) as w from (select pair_id, b, j, unnest(range(1, length(b) - j + 2)) as n from (select pair_id, b, unnest(range(1, length(b) + 1)) as j from pairs))),
    h as (select pair_id, w, min(j) as j from wa join wb using (pair_id, w) group by all), r as (select pair_id, arg_min({'w': w, 'j': j}, (-length(w), j)) as x from h group by pair_id)
    select pair_id, coalesce(length(x.w), 0), coalesce(x.w, ''), x.j - 1 from pairs left join r using (pair_id)"""
    want = {k: rest for k, *rest in c.execute(sql).fetchall()}
    got = D.longest_common_run(spark.createDataFrame(rows, "pair_id int, a string, b string"), "a", "b").collect()
    assert {r["pair_id"]: [r["length"], r["content"], r["at_b"]] for r in got} == want


def test_preserved_run_study_against_loops(spark):
    import random
    import statistics

    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ab") for _ in range(30)), "".join(rng.choice("ab") for _ in range(30))) for k in range(20)] + [(20, "", "x")]
    study = D.preserved_run_study(spark.createDataFrame(rows, "pair_id int, a string, b string"), "a", "b", base=30.0)
    runs = {k: max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0) for k, a, b in rows}
    assert {r["pair_id"]: r["length"] for r in study["runs"].collect()} == runs
    row = study["summary"].first()
    assert abs(row["mean"] - statistics.mean(runs.values())) < 1e-9 and abs(row["ratio"] - statistics.mean(runs.values()) / 30 * 100) < 1e-9 and row["median"] == statistics.median(runs.values())
    assert sum(r["n"] for r in study["histogram"].collect()) == 21
    grams = [b[i : i + 8] for _, _, b in rows for i in range(len(b) - 7)]
    verdict = study["verdict"].first()
    assert abs(verdict["diversity"] - len(set(grams)) * 100 / len(grams)) < 1e-9
    covered = {r["content"]: r["n"] for r in study["coverage"].collect()}
    assert sum(covered.values()) == sum(n > 0 for n in runs.values())
    assert verdict["preservation"] == ("strong" if row["ratio"] < 10 else "moderate" if row["ratio"] < 25 else "weak")


def test_ngram_diversity_against_loops(spark):
    rows = [("en", "hello hello"), ("en", None), ("en", ""), ("de", "äöü äöü äöü"), (None, "xyz"), ("fr", "a")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {(r["lang"], r["n"]): (r["windows"], r["distinct_windows"], round(r["diversity"], 9)) for r in A.ngram_diversity(df, "text", (0, 2, 4), ["lang"]).collect()}
    for lang in ("en", "de", None, "fr"):
        for n in (0, 2, 4):
            grams = [t[i : i + n] for x, t in rows if x == lang and t and n for i in range(len(t) - n + 1)]
            assert got[lang, n] == (len(grams), len(set(grams)), round(len(set(grams)) * 100 / len(grams), 9) if grams else 0.0)
    whole = {r["n"]: (r["windows"], r["distinct_windows"]) for r in A.ngram_diversity(df, "text", (2,)).collect()}
    every = [t[i : i + 2] for _, t in rows if t for i in range(len(t) - 1)]
    assert whole == {2: (len(every), len(set(every)))}


def test_decode_of_long_and_mixed_codes(spark):
    """Codes of one batch are decoded together: as each alone, by a loop."""
    import random

    rng = random.Random(1)
    raw = [rng.randbytes(n) for n in (1, 2, 40, 0, 300, 1_500_000, 77)] + [b"\x7f", b"\x60", None, b"\x61\x01\x02\x00"]
    codes = spark.createDataFrame(list(enumerate(raw)), "code_id long, code binary").coalesce(1)
    names = U.mnemonics()
    rows = U.decode_instructions(codes).select("code_id", "idx", "pc", "opcode", "mnemonic", "imm", "size").toPandas()
    for k, code in enumerate(raw):
        own = rows[rows.code_id == k].sort_values("idx")
        if not code:
            assert own.mnemonic.tolist() == ["EMPTY"] and own["size"].tolist() == [0]
            continue
        want, at = [], 0
        while at < len(code):
            n = code[at] - 0x5E if 0x60 <= code[at] <= 0x7F else 1
            if at + n > len(code):
                break
            want.append((len(want), at, code[at], names[code[at]], code[at + 1 : at + n].hex() if n > 1 else None, n))
            at += n
        got = [(int(i), int(p), int(o), m, x, int(z)) for i, p, o, m, x, z in own[["idx", "pc", "opcode", "mnemonic", "imm", "size"]].itertuples(index=False)]
        assert [(a[:4], a[4] or None, a[5]) for a in got] == [(a[:4], a[4], a[5]) for a in want]


def test_dominators_of_small_graphs(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 2, 3), (0, 3, 4), (0, 4, 3)], "code_id int, src int, dst int")
    roots = spark.createDataFrame([(0, 0)], "code_id int, node int")
    dom = {r["node"]: r["idom"] for r in G.immediate_dominators(edges, roots).collect()}
    assert dom == {0: None, 1: 0, 2: 0, 3: 0, 4: 3}
    back = {r["node"]: r["idom"] for r in G.immediate_dominators(edges, spark.createDataFrame([(0, 4)], "code_id int, node int"), reverse=True).collect()}
    assert back == {4: None, 3: 4, 1: 3, 2: 3, 0: 3}


def test_dominators_and_overlap_against_loops(spark):
    """Random graphs: a node dominates another if that is out of reach without it."""
    import random

    rng = random.Random(7)
    graphs = {g: sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)} | {(k, k + 1) for k in range(n - 1) if rng.random() < 0.8}) for g, n in enumerate((1, 2, 4, 7, 9, 12))}
    rows = [(g, a, b) for g, e in graphs.items() for a, b in e]
    edges = spark.createDataFrame(rows, "code_id int, src int, dst int")

    def reach(e, root, without=None):
        seen, todo = set(), [root] if root != without else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in e if a == x and b != without]
        return seen

    def idoms(e, root):
        nodes = reach(e, root)
        doms = {v: {d for d in nodes if d != v and v not in reach(e, root, d)} for v in nodes}
        return {v: max(doms[v], key=lambda d: len(doms[d]), default=None) for v in nodes}

    want, last = {}, {0: 0, 1: 1, 2: 3, 3: 6, 4: 8, 5: 11}
    for g, e in graphs.items():
        if e:
            want[g] = idoms(e, 0), idoms([(b, a) for a, b in e], last[g])
    roots = spark.createDataFrame([(g, 0) for g in want], "code_id int, node int")
    ends = spark.createDataFrame([(g, last[g]) for g in want], "code_id int, node int")
    dom, pdom = G.immediate_dominators(edges, roots), G.immediate_dominators(edges, ends, reverse=True)
    by_rounds = G.immediate_dominators(edges, roots, limit=8)  # the smallest graphs in a task, the others in rounds
    for out, k in ((dom, 0), (pdom, 1), (by_rounds, 0)):
        assert {(r["code_id"], r["node"]): r["idom"] for r in out.collect()} == {(g, v): d for g, w in want.items() for v, d in w[k].items()}
    got = {r["code_id"]: r["overlap"] for r in G.dominator_overlap(dom, pdom).collect()}
    for g, (one, two) in want.items():
        own = [v for v, d in one.items() if d is not None]
        share = sum(two.get(v) == one[v] for v in own) / len(own) if own else 0.0
        assert abs(got[g] - share) < 1e-9


def test_reachable_over_many_rounds(spark):
    """A chain that is longer than the tables that a search keeps before it puts them together."""
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(40)] + [(1, 40, 0), (2, 5, 6)], "code_id int, src int, dst int")
    roots = spark.createDataFrame([(1, 0), (1, 30), (2, 5), (2, 6)], "code_id int, node int")
    for limit in (0, 100, 1_000_000):
        got = G.reachable(edges, roots, limit=limit).groupBy("code_id", "root").count().collect()
        assert {(r["code_id"], r["root"]): r["count"] for r in got} == {(1, 0): 41, (1, 30): 41, (2, 5): 2, (2, 6): 1}


def counted_rounds(monkeypatch):
    from gritstone.operators import graphs

    seen = []
    write = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: seen.append(1) or write(df))
    return seen


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """5,000 nodes one behind the other, a ladder beside it, circles that nothing leads to, and a root inside a chain."""
    seen = counted_rounds(monkeypatch)
    path = [(1, k, k + 1) for k in range(5000)] + [(1, 9001, 9002), (1, 9002, 9001), (1, 9002, 9003)]
    ladder = [e for k in range(0, 600, 2) for e in ((2, k, k + 1), (2, k, k + 2), (2, k + 1, k + 2))]
    edges = spark.createDataFrame(path + ladder, "code_id int, src int, dst int")
    roots = spark.createDataFrame([(1, 0), (1, 2500), (2, 0)], "code_id int, node int")
    got = G.reachable(edges, roots, limit=0).groupBy("code_id", "root").count().collect()
    assert {(r["code_id"], r["root"]): r["count"] for r in got} == {(1, 0): 5001, (1, 2500): 2501, (2, 0): 601}
    assert len(seen) < 45  # tables written; the pointers of the path double thirteen times


def test_dominators_of_a_deep_chain(spark, monkeypatch):
    """10,000 nodes deep, with a branch that meets the chain again near its end: rows stay small and rounds few."""
    seen = counted_rounds(monkeypatch)
    chain = [(1, k, k + 1) for k in range(10_000)] + [(1, 10, 20_000), (1, 20_000, 9_990), (1, 9_999, 5)]
    edges = spark.createDataFrame(chain, "code_id int, src int, dst int")
    root = spark.createDataFrame([(1, 0)], "code_id int, node int")
    got = {r["node"]: r["idom"] for r in G.immediate_dominators(edges, root, limit=0).collect()}
    assert {r["node"]: r["idom"] for r in G.immediate_dominators(edges, root).collect()} == got
    assert got == {0: None, 20_000: 10, 9_990: 10} | {k: k - 1 for k in range(1, 10_001) if k != 9_990}
    assert len(seen) < 250


def test_graph_metrics_by_hand(spark):
    """6000600157600256: two blocks and two edges, one item deep after two pushes; 600050: one block, two edges."""
    codes = code_table(spark, "600050", "6000600157600256", "00", "600160015601")
    instr = U.decode_instructions(codes)
    blocks, rows = U.block_table(instr)
    blocks = U.with_control(blocks, J.resolve_targets(instr, blocks), rows)
    edges = G.build_edges(blocks)
    got = {r["code_id"]: r.asDict() for r in G.graph_metrics(codes, blocks, edges).collect()}
    count = {r["code_id"]: r["count"] for r in edges.groupBy("code_id").count().collect()}
    assert [(got[k]["byte_len"], got[k]["blocks"], got[k]["max_stack"]) for k in range(4)] == [(3, 1, 1), (8, 2, 2), (1, 1, 0), (6, got[3]["blocks"], got[3]["max_stack"])]
    import math

    for k, r in got.items():
        assert r["edges"] == count[k] and abs(r["potency"] - (5 * math.log2(r["blocks"] + 2) + r["edges"] + 30 * (1 - r["overlap"]))) < 1e-9
    assert (got[0]["edges"], got[2]["edges"]) == (2, 2)
    size = {r["code_id"]: (r["blocks"], r["edges"], r["max_stack"], r["ok"]) for r in A.graph_size(blocks, edges).collect()}
    assert size == {k: (r["blocks"], r["edges"], r["max_stack"], True) for k, r in got.items()}


def test_determinism_check_sees_change(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    seeded_job = lambda s: df.select(S.seeded("x", s, F.col("k")).alias("h"))
    assert V.determinism_check(seeded_job, SEED, "cd" * 32, df.select(F.col("k").cast("string").alias("h"))).first().asDict() == {"same_seed_equal": True, "other_seed_differs": True, "changed": True}
    assert V.determinism_check(lambda s: df, SEED, "cd" * 32, df).first().asDict() == {"same_seed_equal": True, "other_seed_differs": False, "changed": False}


def test_differences_of_tables_with_repeated_rows(spark):
    from gritstone.operators import sets as O

    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z")], "k int, v string")
    got = sorted((r["k"], r["v"] or "", r["side"]) for r in O.symmetric_difference(a, b).collect())
    assert got == [(1, "x", "a"), (2, "", "b"), (3, "z", "a"), (4, "z", "b")]
    assert tuple(V.tables_equivalent(a, b).first()) == (2, 2, False) and tuple(V.tables_equivalent(a, a).first()) == (0, 0, True)
    assert sorted((r["k"], r["change"]) for r in J.edge_changes(a, b, ["k"]).collect()) == [(3, "removed"), (4, "added")]


def test_tokens_are_distinct_and_keep_the_byte(spark):
    keys = spark.range(500).withColumnRenamed("id", "k")
    rows = K.token_map(keys, "k", SEED, width=2, preserve=1).collect()
    assert len(rows) == 500 and len({r["token"] for r in rows}) == 500
    assert all(r["token"][2:] == f"{r['key'] & 255:02x}" for r in rows)
    with pytest.raises(ValueError):
        K.token_map(keys, "k", SEED, preserve=7)
    assert K.token_map(keys.filter("k < 0"), "k", SEED).count() == 0


def test_keys_of_one_token_all_get_one(spark, tmp_path):
    """36150 and 100871 propose one token first. The SQL has only the smaller key; the query has all rows of the SQL and the other key with a token of its own."""
    import duckdb

    import __spark_entry__

    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(100871,), (36150,), (7,)], "c_custkey long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view customer as from '{path}/*.parquet'")
    sql = dict(con.execute(__spark_entry__.oracle_sql()["k2_token_map"]).fetchall())
    got = {r["key"]: r["token"] for r in __spark_entry__.queries()["k2_token_map"](spark, str(tmp_path)).collect()}
    assert set(sql) == {7, 36150} and sql.items() <= got.items()
    assert set(got) == {7, 36150, 100871} and len(set(got.values())) == 3


def test_a_null_key_has_no_token(spark, tmp_path):
    """with a null among the keys the query raised after 64 rounds; its SQL leaves the null out."""
    import duckdb

    import __spark_entry__

    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(1,), (None,), (5,), (None,)], "c_custkey long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view customer as from '{path}/*.parquet'")
    sql = con.execute(__spark_entry__.oracle_sql()["k2_token_map"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["k2_token_map"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(sql) and sorted(k for k, _ in got) == [1, 5]
    assert K.token_map(spark.createDataFrame([(None,)], "k long"), "k", SEED).count() == 0


def test_splits_recombine(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 7919 % 100003).alias("v"))
    shares = K.split_chain(df, "v", "k", SEED)
    assert {r["op"] for r in shares.select("op").distinct().collect()} >= {"XOR", "ADD"}
    assert K.recombine(shares, "k").join(df, "k").filter("value <> v").count() == 0
    two = K.split_additive(df, "v", "k", SEED)
    assert two.filter("share_a + share_b <> v or share_a < 0 or (v > 1 and (share_a < 1 or share_a >= v))").count() == 0


def test_permutation_is_a_bijection_and_guarded(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(9)] + [("c", 5)], "g string, v int")
    rows = K.permute_within(df, "g", "v", SEED).collect()
    assert all(sorted(r["new_value"] for r in rows if r["g"] == g) == list(range(9)) for g in "ab")
    same = K.permute_within(df, "g", "v", SEED, unresolved=F.col("v") == 3)
    assert same.filter("v <> new_value").count() == 0
    assert V.determinism_check(lambda s: K.permute_within(df, "g", "v", s), SEED, "cd" * 32).first().asDict() == {"same_seed_equal": True, "other_seed_differs": True}


def test_markers_without_compat_keep_rows(spark):
    log = spark.createDataFrame([(1, k, x) for k, x in enumerate(["x", "S", "y", "S", "z", "E", "w", "F", "v"])], "run int, seq int, kind string")
    k = F.col("kind")
    args = (["run"], ["seq"], k == "S", k == "E", F.lit("G"), k == "F")
    every = [(r["kind"], r["group_name"]) for r in W.group_by_markers(log, *args, compat=False).orderBy("seq").collect()]
    assert every == [("x", "Setup"), ("S", "G"), ("y", "G"), ("S", "G"), ("z", "G"), ("E", "G"), ("w", "Setup"), ("F", "Finalize"), ("v", "Finalize")]
    kept = [r["kind"] for r in W.group_by_markers(log, *args).orderBy("seq").collect()]
    assert kept == ["x", "S", "z", "E", "w", "F", "v"]


def test_sections_with_braces(spark):
    text = ["head", "#", "uint a;", "function f {", "  if {", "  }", "}", "tail"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(text)], "id int, line_no int, line string")
    line = F.col("line")
    rows = W.section_text(lines, ["id"], "line_no", "line", line == "#", line.startswith("function"), F.lit("k1")).orderBy("first_line").collect()
    assert [(r["kind"], r["n_lines"], r["name"]) for r in rows] == [("header", 2, None), ("storage", 1, None), ("function", 4, "Unresolved_k1"), ("footer", 1, None)]


def test_non_equi_joins_have_no_cross_product(spark):
    rows = spark.createDataFrame([(1, k, k) for k in range(50)], "code_id int, pc long, at long")
    spans = spark.createDataFrame([(1, "Runtime", 10, 5)], "code_id int, kind string, offset int, len int")
    inside = J.within_section(rows, spans, "Runtime")
    assert sorted(r["pc"] for r in inside.collect()) == [10, 11, 12, 13, 14]
    moved = J.remap_offsets(rows.select("code_id", "at"), spark.createDataFrame([(1, 10, 5, 100)], "code_id int, old long, size long, new long"), ["code_id"])
    assert {r["at"]: r["moved"] for r in moved.collect() if r["moved"] is not None} == {10 + k: 100 + k for k in range(5)}
    docs = spark.createDataFrame([(1, "zz the quick brown fox jumps over"), (2, "nothing here at all to see")], "doc_id long, text string")
    needles = spark.createDataFrame([(7, "the quick brown fox jumps"), (8, "short")], "item_id long, text string")
    found = J.locate_passage(docs, needles, "doc_id", "item_id")
    assert [tuple(r) for r in found.collect()] == [(1, 7, 3, 25)]
    for df in (inside, moved, found):
        assert "Cartesian" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_table_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "k int, v double")
    assert V.tables_equivalent(a, a).first()["equivalent"]
    assert V.tables_equivalent(a, a.distinct()).first()["only_a"] == 1
    assert V.first_divergence(a.withColumn("s", F.lit(0)), a.filter("k = 1").withColumn("s", F.lit(0)), "k", "s", ["v"]).first()["k"] == 2
    rules = [("range", "positive", F.col("v") > 0), ("range", "small", F.col("v") < 2)]
    after = V.rule_suite(a, rules)
    assert [r["passed"] for r in after.collect()] == [True, False]
    assert [r["preserved"] for r in V.preserved(after, after).orderBy("description").collect()] == [True, False]


def test_pipeline_steps(spark):
    registry = {"half": Step("half", lambda df, ctx: df.filter("id % 2 = 0")), "bad": Step("bad", lambda df, ctx: df.filter("nothing > 1"))}
    assert [s.name for s in build_steps(" half,, h ", registry, {"h": "half"})] == ["half", "half"]
    with pytest.raises(ValueError):
        build_steps("what", registry)
    out, seen, ctx = run_pipeline(spark.range(10), build_steps("half,bad", registry), SEED, on_error="skip")
    assert out.count() == 5 and ctx.log[-1]["kind"] == "error"
    assert (seen[0][1].get["rows"], seen[0][2].get["rows"]) == (10, 5)
    with pytest.raises(Exception):
        run_pipeline(spark.range(10), build_steps("bad", registry), SEED)


def test_sources_and_sinks(spark, tmp_path):
    d = tmp_path / "codes"
    d.mkdir()
    (d / "a.hex").write_text("60 01\n")
    (d / "b.txt").write_text("0x6002")
    (d / "c.bin").write_bytes(b"\x60\xff")
    got = {r["name"].rsplit("/")[-1]: bytes(r["code"]) for r in read_code_corpus(spark, str(d)).collect()}
    assert got == {"a.hex": b"\x60\x01", "b.txt": b"\x60\x02", "c.bin": b"\x60\xff"}
    t = tmp_path / "trace.json"
    t.write_text('{"metadata":{"transforms_applied":["x"]},"trace":[{"kind":"Build","diff":"None"},{"kind":{"TransformStart":{"name":"Shuffle"}},"remapped_pcs":{"1":2}}]}')
    rows = read_trace_log(spark, str(t)).orderBy("seq").collect()
    assert [(r["seq"], r["kind"], r["attrs"]) for r in rows] == [(0, "Build", None), (1, "TransformStart", {"name": "Shuffle"})]
    f = tmp_path / "fail"
    f.mkdir()
    (f / "crash_1.json").write_text('{"id":"ab","message":"m","input":{"contract":"c"}}')
    (f / "crash_2.json").write_text("{broken")
    (f / "other.json").write_text('{"id":"no"}')
    good, bad = read_failure_reports(spark, str(f))
    assert [(r["id"], r["logs"]) for r in good.collect()] == [("ab", [])] and bad.count() == 1
    write_report("e1", {"summary": spark.range(2)}, str(tmp_path / "report"))
    write_report("e2", {"summary": spark.range(5)}, str(tmp_path / "report"))
    write_report("e1", {"summary": spark.range(3)}, str(tmp_path / "report"))  # again: its own rows alone are replaced
    counts = spark.read.parquet(str(tmp_path / "report" / "summary")).groupBy("experiment_id").count().collect()
    assert {r["experiment_id"]: r["count"] for r in counts} == {"e1": 3, "e2": 5}


def test_masking_leaves_the_rest(spark):
    df = spark.createDataFrame([("mail a@b.c now", False), ("a@b.c", True), ("none", False)], "text string, safe boolean")
    rows = [r["text"] for r in S.mask_literals(df, "text", r"[a-z]+@[a-z.]+", "s", F.col("safe")).collect()]
    assert rows[0].startswith("mail ") and rows[0].endswith(" now") and len(rows[0]) == len("mail a@b.c now") and "@" not in rows[0]
    assert rows[1:] == ["a@b.c", "none"]


def sections_by_hand(code: bytes, runtime: bytes | None):
    """Sections of one code, step by step."""
    if not code:
        return []
    size, aux = len(code), len(code)
    n = int.from_bytes(code[-2:], "big") if size >= 2 else size
    if size >= 2 and n <= size - 2:
        aux = size - 2 - n
    if aux == 0:
        return [("Auxdata", 0, size)]
    instr, pc = [], 0
    while pc < size:
        op = code[pc]
        k = op - 0x5F if 0x60 <= op <= 0x7F else 0
        if pc + 1 + k > size:
            break
        instr.append((pc, op, code[pc + 1 : pc + 1 + k]))
        pc += 1 + k
    terminal = {0x00, 0xF3, 0xFD, 0xFE, 0xFF}
    at = len(instr) - 1
    while at >= 0 and (instr[at][1] == 0 or instr[at][0] >= aux):
        at -= 1
    while at >= 0 and instr[at][1] not in terminal:
        at -= 1
    pad = instr[at][0] + 1 if at >= 0 and instr[at][0] + 1 < aux else None
    init, run, length = 0, 0, aux
    where = code.find(runtime[:20]) if runtime and len(runtime) >= 20 else -1
    if where >= 0 and code[where : where + len(runtime)] == runtime:
        init, run, length = max(where - 1, 0), where, len(runtime)
    if init == 0 and run == 0 and aux > 100:
        copies = [k for k, x in enumerate(instr) if x[1] == 0x39]
        found = None
        if copies:
            c = copies[0]
            back = [k for k in range(c, min(c + 20, len(instr))) if instr[k][1] == 0xF3]
            if back:
                e = instr[back[0]][0] + 1
                r = next((int.from_bytes(instr[k][2], "big") for k in range(c - 1, max(c - 11, -1), -1) if instr[k][2] and e < int.from_bytes(instr[k][2], "big") < 100_000), e)
                found = (e, r) if r < aux else None
            if not found:
                for k, x in enumerate(instr):
                    if x[1] == 0x36:
                        opening = k >= 4 and [i[1:] for i in instr[k - 4 : k]] == [(0x60, b"\x80"), (0x60, b"\x40"), (0x52, b""), (0x60, b"\x04")]
                        r = instr[k - 4][0] if opening else x[0]
                        if 100 < r < aux:
                            found = (r, r)
                            break
        if found:
            init, run, length = *found, aux - found[1]
    if init == 0 and run > 0:
        init = run
    length = max(0, min(length, aux - run))
    args = run > 0 and init < run < aux and run - init >= 4
    head = run if not args and run > init and run - init < 4 else init
    out = []
    if args:
        out.append(("ConstructorArgs", init, run - init))
    if not args and pad is not None:
        out.append(("Padding", pad, aux - pad))
    if head == 0 and run == 0:
        run, length = 0, aux
    elif head > 0:
        out.append(("Init", 0, head))
    if not args and pad is not None and run <= pad < run + length:
        length = pad - run
    if length > 0 and run < aux:
        out.append(("Runtime", run, length))
    if aux < size:
        out.append(("Auxdata", aux, size - aux))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_sections_by_hand(spark):
    import random

    rng = random.Random(12)
    trailer = "a1" * 8 + "0008"
    runtime = "6080604052" + "01" * 30 + "fe"
    texts = ["600a600c600039600a6000f3" + runtime + "aabbccdd" + trailer, "600160015b00", "00", "0000", "fe" * 30 + "001e", "", runtime + trailer, "5b" + runtime + trailer, "5b5b5b5b5b" + runtime + "0102" + trailer]
    for gap in (0, 1, 3, 4, 9):  # a copy with a return; the number pushed is the runtime's place
        head = "61" + f"{9 + gap:04x}" + "60003960 00f3".replace(" ", "")
        texts.append(head + "00" * gap + "6001" * 60 + "fe" + trailer)
    texts.append("39" + "5b" * 120 + "608060405260043601" + "5b" * 40 + "fe00" + trailer)
    texts.append("39" + "5b" * 120 + "36" + "5b" * 40 + "fd00" + trailer)
    for _ in range(150):
        texts.append("".join(rng.choice(["39", "f3", "36", "00", "fe", "6080604052600436", "61" + f"{rng.randint(0, 300):04x}", "5b", f"{rng.randint(0, 255):02x}"]) for _ in range(rng.randint(1, 200))) + rng.choice(["", trailer, "0000"]))
    codes = code_table(spark, *texts)
    instr = U.decode_instructions(codes)
    known = {0: runtime, 6: runtime, 7: runtime, 8: runtime, 1: "6001", 5: runtime} | {k: texts[k][2 * (k % 7) :][: 2 * (20 + k)] for k in range(20, 100)}
    table = spark.createDataFrame(list(known.items()), "code_id long, h string").select("code_id", F.unhex("h").alias("runtime"))
    for given in (table, None):
        got: dict = {}
        for r in U.locate_sections(codes, instr, given).collect():
            got.setdefault(r["code_id"], []).append((r["kind"], r["offset"], r["len"]))
        for k, text in enumerate(texts):
            code = bytes.fromhex(text)
            want = sections_by_hand(code, bytes.fromhex(known[k]) if given is not None and k in known else None)
            assert sorted(got.get(k, []), key=lambda x: (x[1], x[0])) == want, (k, text)
    kinds = [r["kind"] for r in U.locate_sections(codes, instr, table).filter("code_id = 0").orderBy("offset").collect()]
    assert kinds == ["Init", "Runtime", "Padding", "Auxdata"]
    status = {r["code_id"]: r["status"] for r in U.checked_sections(codes, instr, table).collect()}
    assert all(status[k] == "ok" for k in (0, 1, 2, 3, 4, *range(6, 16))) and 5 not in status


def test_block_summary_and_functions(spark):
    codes = code_table(spark, "6000600657005b00")
    instr = U.decode_instructions(codes)
    blocks, rows = U.block_table(instr)
    blocks = U.with_control(blocks, J.resolve_targets(instr, blocks), rows)
    edges = G.build_edges(blocks)
    got = {r["node"]: (r["n_instr"], r["operations"], r["incoming"], r["outgoing"]) for r in A.block_summary(blocks.filter("kind = 'Body'"), edges, rows).collect()}
    assert got[2] == (3, ["PUSH1", "PUSH1", "JUMPI"], ["Fallthrough"], ["BranchFalse", "BranchTrue"])
    assert got[4] == (2, ["JUMPDEST", "STOP"], ["BranchTrue"], ["Fallthrough"])
    entry = spark.createDataFrame([(0, "aa", 2)], "code_id long, entry string, node int")
    reach = G.reachable(edges, entry.select("code_id", "node")).select("code_id", F.lit("aa").alias("entry"), "node")
    row = A.function_rollup(reach, rows, blocks.filter("kind = 'Body'")).first()
    assert (row["entry"], row["read_only"], row["payable"]) == ("aa", True, False)


def test_near_pairs_of_large_groups(spark):
    """Every gram links the texts that have it: all pairs up to the bound, pairs with the smallest id beyond it."""
    text = {k: "one text that nine documents have, letter for letter" for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    text |= {k: f"{k} {'z' * k} begins apart; but this passage of theirs is in seven texts" for k in range(20, 27)}
    text |= {30: "a passage that two texts alone have, and no other", 31: "> a passage that two texts alone have, and no other", 40: "short"}
    having = {}
    for k, t in text.items():
        for i in range(len(t) - 31):
            having.setdefault(t[i : i + 32], set()).add(k)
    want = set()
    for ids in having.values():
        want |= {(a, b) for a in ids for b in ids if a < b and (len(ids) <= 5 or a == min(ids))}
    assert (3, 11) in want and (20, 26) in want and (30, 31) in want
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    assert {tuple(r) for r in D.near_pairs(df).collect()} == want


def test_hex_of_whole_texts(spark, tmp_path):
    from gritstone.plans import core

    text = {k: "ab é漢 1" * k for k in (0, 1, 7, 8, 40, 41)}
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in core.s2_normalize_hex(spark, str(tmp_path)).collect():
        odd = r["doc_id"] % 2 == 1
        digits = text[r["doc_id"]].encode().hex() + ("a" if odd else "")
        assert (r["normalized"] or "").lower() == ("0" if odd else "") + digits
        assert (r["cli"] is None) if odd else (r["cli"] or "").lower() == digits


def test_masking_keeps_the_length_of_long_matches(spark):
    texts = [f"to {'a' * n}@b.c now" for n in (1, 59, 60, 61, 508, 509, 2000)]
    rows = S.mask_literals(spark.createDataFrame([(t,) for t in texts], "text string"), "text", r"[a-z]+@[a-z.]+", "s").collect()
    assert [len(r["text"]) for r in rows] == [len(t) for t in texts]
    assert all(r["text"].startswith("to ") and r["text"].endswith(" now") and "@" not in r["text"] for r in rows)


def test_rejects_ranges_and_documents(spark):
    df = spark.createDataFrame([(1, "0xAB"), (2, "zz"), (3, None), (4, "abc")], "k int, x string")
    assert [r["k"] for r in S.rejected_hex(df, "k", "x").collect()] == [2]
    assert sorted(r["k"] for r in S.rejected_hex(df, "k", "x", strict=False).collect()) == [2, 4]
    big = 1 << 256
    rows = spark.createDataFrame([(str(big - 1), True), (str(big), False), ("0", True), ("-1", False), ("000" + str(big - 1), True), ("", False), (str(10 * big), False)], "x string, want boolean")
    assert rows.filter(S.in_word_range(F.col("x")) != F.col("want")).count() == 0
    report = V.size_cost_report(spark.createDataFrame([(1, 10, 12), (2, 10, 10), (3, 10, 5)], "k int, b long, a long"), "k", "b", "a")
    assert V.size_cost_counts(report).first().asDict() == {"pairs": 3, "larger": 1, "smaller": 1, "unchanged": 1, "delta": -3, "cost_delta": -600}
    assert '"note":"larger"' in V.as_documents(report, "k").filter("k = 1").first()["document"]


def test_reentry(spark):
    calls = spark.createDataFrame([(1, k, x) for k, x in enumerate("([)](")] + [(2, k, x) for k, x in enumerate("((")], "run int, seq int, x string")
    x = F.col("x")
    row = V.no_reentry(calls, ["run"], ["seq"], x == "(", x == ")").first()
    assert (row["violations"], row["passed"]) == (1, False)
    assert V.no_reentry(calls.filter("run = 1"), ["run"], ["seq"], x == "(", x == ")").first()["passed"]


def test_pushed_texts_and_replaced_spans(spark):
    words = b"only the owner may call".hex()
    direct = "6308c379a0" + "76" + words + "00"  # PUSH4 selector, PUSH23 text
    shifted = "62461bcd" + "60e5" + "1b" + "7f" + words + "00" * 9 + "00"
    codes = code_table(spark, direct, shifted, "76" + words + "00", "6308c379a0" + "6f" + "ff" * 16 + "00")
    _, rows = U.block_table(U.decode_instructions(codes))
    got = sorted((r["code_id"], r["length"], r["text"]) for r in U.pushed_texts(rows).collect())
    assert got == [(0, 23, "only the owner may call"), (1, 23, "only the owner may call")]
    spans = spark.createDataFrame([(0, 1, 2, "aa"), (0, 4, 0, "bbbb"), (1, 0, 3, ""), (2, 1, 2, "00"), (2, 2, 1, "00"), (3, 0, 99, "")], "code_id long, offset int, len int, data string")
    out = {r["code_id"]: (r["code"], r["ok"]) for r in U.replace_spans(code_table(spark, "0102030405", "010203", "01020304", "01", "0a0b"), spans).collect()}
    assert out == {0: ("01aa04bbbb05", True), 1: ("", True), 2: (None, False), 3: (None, False), 4: ("0a0b", True)}


def test_decode_for_sql_users(spark):
    U.register_decode(spark)
    rows = spark.sql("select idx, pc, mnemonic, imm from decode(unhex('600160ff0161')) order by idx").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "PUSH1", "01"), (1, 2, "PUSH1", "ff"), (2, 4, "ADD", None)]


def test_steps_that_fail_while_they_run(spark):
    steps = [Step("half", lambda df, ctx: (df.filter("id % 2 = 0"), True)), Step("breaks", lambda df, ctx: df.filter("raise_error(cast(id as string)) is null")), Step("same", lambda df, ctx: (df, False))]
    out, seen, ctx = run_pipeline(spark.range(10), steps, SEED, on_error="skip")
    assert out.count() == 5 and [(x["kind"], x.get("changed")) for x in ctx.log] == [("start", None), ("end", True), ("start", None), ("error", None), ("start", None), ("end", False)]


def test_equal_tables_shuffle_digests_alone(spark):
    """No row of equal tables passes to the comparison; of tables that differ in one row, those of its bucket do."""
    a = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("step"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("v"))
    b = a.repartition(3, "v")
    same = V.differing(a, b, ["k"], 4096)
    assert [df.count() for df in same] == [0, 0]
    row = V.tables_equivalent(a, b).first()
    assert (row["only_a"], row["only_b"], row["equivalent"]) == (0, 0, True)
    other = b.withColumn("v", F.when(F.col("k") == 777, 9).otherwise(F.col("v")))
    left, right = V.differing(a, other, ["k"], 4096)
    assert 0 < left.count() == right.count() < 40
    row = V.tables_equivalent(a, other).first()
    assert (row["only_a"], row["only_b"], row["equivalent"]) == (1, 1, False)
    assert [tuple(r) for r in V.first_divergence(a, other, "k", "step", ["v"]).collect()] == [(777, 0)]
    # rows count as often as they stand, and a null is told from its neighbour
    x = spark.createDataFrame([(1, None), (1, None), (None, 1)], "p int, q int")
    y = spark.createDataFrame([(1, None), (None, 1), (None, 1)], "p int, q int")
    row = V.tables_equivalent(x, y).first()
    assert (row["only_a"], row["only_b"]) == (1, 1)
    assert V.tables_equivalent(x.limit(0), y.limit(0)).first()["equivalent"]


def test_line_diffs_of_pairs_that_share_a_long_text(spark):
    """One narrow pass gives the ordered and the order-free diff: nothing is shuffled for a line, and a pair's lines are not joined with another's."""
    long = "\n".join(f"line {k} é" for k in range(300))
    rows = [(k, long, long.replace(f"line {k} é", f"other {k}").replace("line 7 é\n", "")) for k in range(40)] + [(40, None, None), (41, None, ""), (42, "", "a")]
    pairs = spark.createDataFrame(rows, "pair_id int, a string, b string").coalesce(1)
    stats, counts = D.line_diff_stats(pairs, "a", "b"), D.line_multiset_diff(pairs, "a", "b")
    by_marks = D.line_diff_stats(pairs.select("pair_id", *(D.line_marks(F.col(c)).alias(c) for c in "ab")).filter("pair_id < 40"), "a", "b")
    for df in (stats, counts, by_marks, D.replacements(pairs, "a", "b")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got, free = ({r["pair_id"]: tuple(r)[1:] for r in df.collect()} for df in (stats, counts))
    assert {r["pair_id"]: tuple(r)[1:] for r in by_marks.collect()} == {k: v for k, v in got.items() if k < 40}
    hunks = {}
    for r in D.replacements(pairs, "a", "b").orderBy("pair_id", "hunk_no").collect():
        hunks.setdefault(r["pair_id"], []).append((r["before"], r["after"]))
    for k, a, b in rows:
        p, q = (x.split("\n") if x else [] for x in (a, b))
        want = diff_by_hand(p, q)
        removed, added = (sum(len(h[s]) for h in want) for s in (0, 1))
        assert hunks.get(k, []) == want and got[k] == (len(want), removed, added, len(p) - removed, len(p))
    assert free[3] == (2, 1, 298, 300) and 40 not in free and free[41] == (0, 1, 0, 0) and free[42] == (1, 1, 0, 1)


def test_code_blocks_with_details_against_windows(spark):
    """Operations, keys, flags and jumps of the one pass: as by windows over instructions."""
    import random

    rng = random.Random(12)
    some = [0x00, 0x01, 0x34, 0x55, 0x56, 0x57, 0x58, 0x5B, 0x5B, 0x5F, 0x60, 0x60, 0x61, 0x63, 0x63, 0x66, 0x67, 0x80, 0xF3]
    raw = [bytes(rng.choice(some) if rng.random() < 0.8 else rng.randrange(12) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, b"\x7f", bytes.fromhex("60006001015660035801565b"), bytes.fromhex("6003580156"), bytes.fromhex("6004600101565b")]
    codes = spark.createDataFrame(list(enumerate(raw)), "code_id long, code binary")
    instr = U.decode_instructions(codes)
    blocks, rows = U.block_table(instr)
    jumps = J.resolve_targets(instr, blocks)
    detailed = U.code_blocks(codes, details=True)
    key = lambda df: sorted(map(str, df.collect()))
    found = detailed.filter("jump_idx is not null").select("code_id", F.col("jump_idx").alias("idx"), F.col("last_op").alias("op"), F.col("jump_form").alias("form"), F.col("jump_value").alias("value"), F.col("control.target").alias("target"))
    assert key(found) == key(jumps) and {r["form"] for r in found.collect()} == {"direct", "sum", "relative", None}
    body, edges = detailed.filter("kind = 'Body'"), G.build_edges(detailed)
    want = U.with_control(blocks, jumps, rows).filter("kind = 'Body'")
    assert key(A.block_summary(body, edges)) == key(A.block_summary(want, edges, rows))
    assert key(A.entry_points(detailed)) == key(A.entry_points(rows.join(blocks.select("code_id", "node", "start_pc"), ["code_id", "node"])))
    none = edges.select("code_id", F.lit("aa").alias("entry"), F.col("src").alias("node")).limit(0)
    assert key(A.function_rollup(none, None, body)) == key(A.function_rollup(none, rows, want))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_likely_text_at_the_bound(spark):
    """Three of five bytes are 0.6 as 32-bit floats; a NUL before a last line break is no trailing one."""
    texts = ["abc\n\n", "abcdef\n\n\n\n", "abc\n\n\n", "ab\0\n", "abc\0\n", "abcd\0\0", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(S.is_likely_text(F.col("t"))).collect()]
    assert got == [True, True, False, False, True, True, False, None]


def test_longest_common_run_leaves_out_what_no_run_can_hold():
    import random

    import numpy as np
    import pyarrow as pa

    from gritstone.functions import runs

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a = [word(rng.randint(0, 400)) for _ in range(60)]
    b = [word(rng.randint(0, 300)) + (x[5 : rng.randint(5, 400)] if k % 3 else "") + word(20) for k, x in enumerate(a)]
    points = [np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in (a, b)]
    at = [np.concatenate([[0], np.cumsum(list(map(len, x)))]) for x in (a, b)]
    kept = runs.shareable(np.concatenate(points), *at)
    assert 0 < kept.sum() < len(kept)
    length, place = runs.longest_common_runs(pa.array(a), pa.array(b))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        best = max((n for j in range(len(y)) for n in range(len(y) - j + 1) if y[j : j + n] in x), default=0) if len(y) < 120 else None
        assert best is None or length[k] == best
        assert y[place[k] : place[k] + length[k]] in x if length[k] else place[k] == -1
    every = runs.shareable
    try:
        runs.shareable = lambda p, *_: np.ones(len(p), bool)
        whole = runs.longest_common_runs(pa.array(a), pa.array(b))
    finally:
        runs.shareable = every
    assert (whole[0] == length).all() and (whole[1] == place).all()
