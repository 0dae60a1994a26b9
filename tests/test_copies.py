"""Pairs of texts that share a passage: all of them, however large a group is, and neither they nor their texts are shuffled."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gritstone.operators import copies


def passages(texts: dict[int, str], n: int = 32) -> dict[str, set[int]]:
    having: dict[str, set[int]] = {}
    for k, t in texts.items():
        for i in range(len(t) - n + 1):
            having.setdefault(t[i : i + n], set()).add(k)
    return having


def all_pairs(texts: dict[int, str]) -> set[str]:
    return {f"{a}-{b}" for ids in passages(texts).values() for a in ids for b in ids if a < b}


@pytest.fixture(scope="module")
def texts() -> dict[int, str]:
    """Nine copies, seven and eight texts that share a passage of their own, one text with both passages, pairs, and texts that share nothing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 8))) + rng.choice(["", ".", " the end"])
    body = lambda n: "\n".join(line() for _ in range(n))
    one, two, copy = "this passage of theirs is in seven texts or more.", "a line of licence that many of the texts have", body(12)
    out = {k: copy for k in range(3, 12)}
    out |= {k: f"{body(3)}\n{one}\n{body(k % 5)}" for k in range(20, 27)}
    out |= {k: f"{body(2)}\n{two} {k}\n{body(4)}" for k in range(30, 38)}
    out |= {40: f"{one}\n{two}\n{two}", 41: body(9), 43: "short", 44: "", 45: "{\n" + body(30)}
    return out | {42: out[41].replace(" the end", "", 1) + "\nmore", 46: out[45][: len(out[45]) // 2] + "\n}\n" + body(3)}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, folder: str, name: str):
    return __spark_entry__.queries()[name](spark, folder)


def same_as_sql(spark, folder: str, name: str) -> list:
    con = duckdb.connect()
    con.execute(f"create view documents as from '{folder}/documents.parquet/*.parquet'")
    got = run(spark, folder, name)
    wanted = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rows = got.collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))
    return rows


def nothing_of_a_pair_is_shuffled(df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_replacements_of_all_pairs(spark, folder, texts):
    """groups of more than five texts had their pairs with the smallest id alone, and both texts of each pair were shuffled."""
    pairs = all_pairs(texts)
    assert {"4-5", "21-26", "31-37"} <= pairs
    nothing_of_a_pair_is_shuffled(run(spark, folder, "d5_replacements"))
    rows = same_as_sql(spark, folder, "d5_replacements")
    assert {r["pair_id"] for r in rows} == {p for p in pairs if len({texts[int(k)] for k in p.split("-")}) == 2}


@pytest.mark.parametrize("rare", [None, 2, 5])
def test_pairs_of_small_slices(spark, folder, texts, monkeypatch, rare):
    """The same pairs, each once, whatever slices hold the texts."""
    from gritstone.operators.similarity import near_pairs

    wanted = {(a, b) for ids in passages(texts).values() for a in ids for b in ids if a < b and (rare is None or len(ids) <= rare or a == min(ids))}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for rows, few in ((2, 3), (1000, 16)):
        monkeypatch.setattr(copies, "SLICE_ROWS", rows)
        monkeypatch.setattr(copies, "FEW", few)
        got = [tuple(r) for r in near_pairs(docs, rare=rare).collect()]
        assert len(got) == len(wanted) and set(got) == wanted


def test_no_pairs(spark, tmp_path):
    for k, rows in enumerate(([], [(1, "alone, but long enough to have passages of its own"), (2, None), (3, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert run(spark, f"{tmp_path}/{k}", "d5_replacements").count() == 0


def test_structured_diff_where_slices_meet(spark, folder, texts):
    """sections of both texts were shuffled for each pair, three times. Its SQL has the cut at five texts still, and no finding to take it out."""
    nothing_of_a_pair_is_shuffled(run(spark, folder, "d7_structured_diff"))
    rows = same_as_sql(spark, folder, "d7_structured_diff")
    assert {r["kind"] for r in rows} == {"header", "storage", "function"} and {"3-4", "20-26"} <= {r["pair_id"] for r in rows}


def test_structured_diff_as_by_joins(spark, folder, texts):
    """Footers go, and items are those of ``structured_diff``."""
    from gritstone.operators import similarity as D
    from gritstone.plans.studies import sectioned

    docs = spark.read.parquet(f"{folder}/documents.parquet").union(spark.createDataFrame([(k, f"{{\nfirst {k}.\n the one {{\nthe same {k}\n}}\nthis line is behind a function, in a footer\nx the two") for k in (60, 61)], "doc_id long, text string"))
    parts = sectioned(docs)
    assert parts.filter("kind = 'footer'").count() == 2
    pairs = D.near_pairs(docs, rare=None).selectExpr("concat_ws('-', id_a, id_b) as pair_id", "id_a", "id_b")
    sides = [pairs.select("pair_id", F.col(c).alias("id")).join(parts, "id").drop("id") for c in ("id_a", "id_b")]
    wanted = D.structured_diff(*sides, spark.createDataFrame([], "key string, token string")).drop("item_no")
    got = D.near_structured_diff(docs, parts)
    assert got.dtypes == [(c, t) for c, t in zip(got.columns, ("string",) * 4 + ("bigint",) * 5, strict=True)] and got.columns == wanted.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))


def test_diff_study_of_all_pairs(spark, folder, texts):
    """as D5; a pair's items are summed where its slices meet."""
    nothing_of_a_pair_is_shuffled(run(spark, folder, "d8_diff_study"))
    assert same_as_sql(spark, folder, "d8_diff_study")[0]["samples"] == len(all_pairs(texts))


def longest_by_hand(a: str, b: str) -> tuple[int, int]:
    best, at, row = 0, -1, [0] * (len(b) + 1)
    ends: dict[int, int] = {}
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        for j, n in enumerate(row):
            if n and n >= best:
                ends[n] = min(ends.get(n, j), j) if n == best else j
                best = n
    return best, ends[best] - best if best else at


def test_longest_runs_of_all_pairs(spark, folder, texts):
    """as D5; also runs that stand twice and texts whose passages all come in another order."""
    nothing_of_a_pair_is_shuffled(run(spark, folder, "d1_longest_common_run"))
    got = {r["pair_id"]: r for r in run(spark, folder, "d1_longest_common_run").collect()}
    assert set(got) == all_pairs(texts) and len(got) > 60
    for pair, r in got.items():
        a, b = (texts[int(k)] for k in pair.split("-"))
        length, at = longest_by_hand(a, b)
        assert (r["length"], r["at_b"], r["content_hash"]) == (length, at, hashlib.sha256(b[at : at + length].encode()).hexdigest())
    assert len({r["length"] for r in got.values()}) > 8


def test_runs_that_only_hashes_have(spark, folder, texts, monkeypatch):
    """A run of passages whose hashes alone are equal is looked up by its characters."""
    from gritstone.operators import similarity as D

    longest = D.longest_equal
    monkeypatch.setattr(D, "longest_equal", lambda *args: (longest(*args)[0] + 9, longest(*args)[1]))
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id >= 40")
    work = {}
    monkeypatch.setattr(D, "over_near_pairs", lambda texts, text, along, fn, schema, n: work.update(fn=fn))
    D.near_runs(docs)
    blobs = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([[1]], pa.list_(pa.int64())), pa.array([[1]], pa.list_(pa.int64())), pa.array([texts[k]])], ["id", "gives", "takes", "text"]) for k in (45, 46)]
    sides = []
    for b in blobs:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        sides.append(copies.Side(sink.getvalue().to_pybytes()))
    (out,) = work["fn"](*sides, *copies.partners(*sides))
    length, at = longest_by_hand(texts[45], texts[46])
    assert out.to_pylist() == [{"pair_id": "45-46", "length": length, "content": texts[46][at : at + length], "at_b": at}]


def test_run_study_of_all_pairs(spark, folder, texts):
    """as D5; the same row as by the study over joined pairs, and the runs of pairs are not written."""
    from gritstone.operators import similarity as D

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = [(p, *(texts[int(k)] for k in p.split("-"))) for p in sorted(all_pairs(texts))]
    study = D.preserved_run_study(spark.createDataFrame(pairs, "pair_id string, a string, b string"), "a", "b", base=1000.0)
    want = study["summary"].crossJoin(study["verdict"].drop("ratio")).first().asDict()
    row = run(spark, folder, "d2_preserved_run_study").first().asDict()
    assert {k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()} == row and row["n"] == len(pairs)
    none = D.near_run_study(docs.filter("doc_id < 4"), 1000.0).first().asDict()
    assert (none.pop("n"), none.pop("preservation"), none.pop("variety"), set(none.values())) == (0, "strong", "low", {0.0})


def test_summary_of_weighted_values(spark):
    from gritstone.operators import aggregates as A

    for values in ([], [7], [3, 3], [1, 2, 2, 5, 5, 5, 11], [130_000] * 3 + [32]):
        rows = spark.createDataFrame([(v,) for v in values], "v int")
        want = A.distribution_summary(rows, "v", 10.0).first().asDict()
        got = A.weighted_summary(rows.groupBy("v").agg(F.count("*").alias("t")), "v", "t", 10.0).first().asDict()
        assert got == pytest.approx(want)


def test_portions_of_many_lines(texts, monkeypatch):
    """All pairs of a portion have their row, also where it has more lines than are looked at together."""
    from gritstone.operators import similarity as D

    monkeypatch.setattr(D, "LINE_SLICE", 3)
    part = pa.RecordBatch.from_arrays([pa.array([f"0-{k}" for k in range(9)]), pa.array([[1, 2]] * 9), pa.array([[2, k] for k in range(9)])], ["pair_id", "a", "b"])
    work = {}
    monkeypatch.setattr(D, "over_near_pairs", lambda texts, text, along, fn, schema: work.update(fn=fn))
    monkeypatch.setattr(D, "by_rows", lambda fn: fn)
    monkeypatch.setattr(D, "line_marks", lambda c: c)
    monkeypatch.setattr(D.F, "col", lambda c: type("C", (), {"alias": lambda self, n: self})())
    docs = type("T", (), {"select": lambda self, *c: self})()
    D.near_line_stats(docs, D.multiset_stats, ("removed", "added", "unchanged", "total"))
    assert [r["pair_id"] for b in work["fn"](part) for r in b.to_pylist()] == [f"0-{k}" for k in range(9)]


@pytest.mark.parametrize("name", ["d3_line_diff_stats", "d4_line_multiset_diff"])
def test_line_diffs_of_all_pairs(spark, folder, texts, name):
    """As D5; the marks of lines of both texts were shuffled for each pair."""
    nothing_of_a_pair_is_shuffled(run(spark, folder, name))
    assert {r["pair_id"] for r in same_as_sql(spark, folder, name)} == all_pairs(texts)
