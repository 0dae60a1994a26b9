"""Every operator and the pipeline on texts of several megabytes, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import decontamination, language_id, near_dedup, packing, pseudo_likelihood, repetition, substring_dedup, token_output, toxicity, url_cascade

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
PASSAGE = " ".join(rng.choices(WORDS, k=40))
LONG = " ".join(rng.choices(WORDS, k=300_000)) + " " + PASSAGE + " " + " ".join(rng.choices(WORDS, k=200_000))
NEAR = LONG[:-8] + " changed"
SHORT = "a short text of eleven words that stands here by itself"
TEXTS = [(1, LONG), (2, NEAR), (3, "before it " + PASSAGE + " and behind"), (4, None), (5, ""), (6, SHORT), (6, SHORT), (7, " \n\t ")]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in TEXTS]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "ids", "spans", "anchors", "print", "class", "comp", "shard", "own", "h", "size", "toxic", "row_marks", "row_spans"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


def words(t):
    return (t or "").split()


def test_long_texts_are_several_slices():
    assert len(LONG) > 2_500_000


def test_repetition(long_docs):
    rows = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in repetition.repetition_rules(long_docs).collect())
    assert [r[:2] for r in rows] == [(k, len(words(t))) for k, t in TEXTS] and rows[0][2]
    assert {r["doc_id"] for r in repetition.keep_unrepetitive(long_docs).collect()} == {1, 2, 3, 6}


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_decontamination(spark, long_docs, block_words):
    bench = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, "nothing of that kind stands anywhere in these texts here"), (None, None)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    rows = sorted((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontamination.benchmark_hits(long_docs, bench, block_words=block_words).collect())
    assert [r for r in rows if r[1]] == [(1, 40, 2), (2, 40, 2), (3, 40, 2)] and len(rows) == len(TEXTS)
    left = decontamination.remove_benchmark(long_docs, bench, block_words=block_words)
    assert left.schema == long_docs.schema
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept[1] == LONG.replace(PASSAGE + " ", "") and 3 not in kept and kept[4] is None


def test_substring_dedup(long_docs):
    rows = sorted(tuple(r) for r in substring_dedup.substring_dedup(long_docs).collect())
    n = len(words(LONG))
    alike = next(k for k, (x, y) in enumerate(zip(words(LONG), words(NEAR), strict=False)) if x != y)  # the words that both begin with
    assert [r[1:3] for r in rows] == [(n, 0), (len(words(NEAR)), alike), (44, 40), (0, 0), (0, 0), (11, 0), (11, 0), (0, 0)]
    assert rows[0][3] == hashlib.sha256(LONG.encode()).hexdigest() and rows[2][2] == 40
    left = substring_dedup.remove_repeated(long_docs)
    assert left.schema == long_docs.schema
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept[1] == LONG and kept[3] == "before it and behind" and kept[4] is None and kept[5] == ""


def test_near_dedup(long_docs):
    rows = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.classes(long_docs).collect())
    assert rows == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (6, 6), (7, 7)]
    left = near_dedup.near_dedup(long_docs)
    assert left.columns == long_docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6, 6, 7]


def test_packing(long_docs):
    rows = packing.pack(long_docs).toPandas()
    one = rows[rows.doc_id == 1].sort_values("piece")
    assert one.length.sum() > 500_000 and (one.length.iloc[1:] == 1024).all()
    assert sorted(rows[rows.doc_id.isin([4, 5])].length) == [1, 1] and (rows.doc_id == 6).sum() == 2
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    again = packing.pack(long_docs.repartition(1)).toPandas()  # ties in order of document and piece
    key = ["doc_id", "piece", "sequence_id", "offset"]
    assert len(again) == len(rows) and np.array_equal(again[key[:2]].sort_values(key[:2]).values, rows[key[:2]].sort_values(key[:2]).values)


def test_token_output(long_docs):
    table = token_output.packed_rows(long_docs).toArrow()
    got = {}
    matrix = token_output.read_matrix(table)
    for k, r in enumerate(table.to_pylist()):
        for d, a, b in zip(r["doc_ids"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            got[d] = got.get(d, 0) + b - a
            assert (matrix[k, a:b] < 50257).all()
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[4] == got[5] == 1 and got[1] > 500_000


def test_language_id(long_docs):
    rows = {r["doc_id"]: r for r in language_id.identify(long_docs).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 3, 4, 5, 7)] == ["en", "en", "und", "und", "und"]


def test_toxicity(spark, long_docs):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (6, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = toxicity.score_toxicity(long_docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(long_docs.filter("false"), labels).count() == 0


def test_pseudo_likelihood(long_docs):
    rows = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in pseudo_likelihood.pseudo_likelihood(long_docs).collect())
    assert [r[:2] for r in rows] == [(k, len(words(t))) for k, t in TEXTS]
    assert rows[5][:2] == rows[6][:2] and np.isclose(rows[5][2], rows[6][2]) and all((s < 0) == (n > 0) for _, n, s in rows)


def test_urls(spark):
    long = "https://a.example.net/en/" + "x/" * 1_500_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "https://" + "h." * 100_000 + "net/")], "page_id long, url string").withColumn("keys", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = sorted((r["page_id"], r["verdict"], r["rule"]) for r in url_cascade.filter_urls(pages, url_cascade.rule_table(spark, [("block", "net", "/"), ("allow", "example.net", "/en/")])).collect())
    assert got == [(1, "allow", "example.net/en/"), (1, "allow", "example.net/en/"), (2, "allow", None), (3, "block", "net/")]


@pytest.mark.parametrize("rows", ["none", "some"])
def test_pipeline(spark, long_docs, tmp_path, rows):
    import corpus_pipeline

    docs = long_docs.filter("false") if rows == "none" else long_docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item that no document has in it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    if rows == "none":
        assert len(out) == 0
    else:
        assert sorted(set(out.doc_id)) == [1, 3, 6] and (out.doc_id == 6).sum() == 2
