"""The pipeline on a small table against its stages done by hand."""

from __future__ import annotations

import importlib
import random

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, leak, base = text(60), text(30), text(200)
    words = base.split(" ")
    words[50] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(words)), (3, "again and again " * 40), (4, text(40) + " " + passage + " " + text(40)), (5, text(50) + " " + passage + " " + text(50)),
        (6, text(80) + " " + leak + " " + text(80)), (7, text(120)), (8, None), (9, ""), (10, "short"),
    ]
    sf = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert sorted(seen[0]) == [0, 1, 2, 4, 5, 6, 7]
    assert sorted(seen[1]) == [0, 4, 5, 6, 7]
    texts = dict(rows)
    assert seen[2][4]["text"] == texts[4] and passage not in seen[2][5]["text"] and seen[2][5]["text"] == texts[5].replace(passage + " ", "")
    assert seen[2][5]["n_chars"] == len(seen[2][5]["text"])
    assert leak not in seen[3][6]["text"] and seen[3][7]["text"] == texts[7]
    packed = docs.toPandas()
    assert set(packed.doc_id) == {0, 4, 5, 6, 7} and packed.groupby("sequence_id").length.sum().max() <= 1024
    once = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(once[key].sort_values(key).values, packed[key].sort_values(key).values)


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
