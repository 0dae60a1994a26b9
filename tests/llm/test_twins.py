"""Words that a polynomial hash modulo 2^64 cannot tell apart, names with dots, and the verified table of spans."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from gritstone.llm import decontamination, language_id, near_dedup, packing, repetition, substring_dedup, token_output
from gritstone.llm._tokens import Encoder, default_tokenizer
from gritstone.llm._words import chunks, distinct_spans, lanes


def twins(doublings: int) -> tuple[str, str]:
    x, y = "a", "b"
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


X, Y = twins(10)
LONG_X, LONG_Y = twins(11)
SCHEMA = "doc_id long, text string"


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), SCHEMA)


def ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids + [2]


def test_repetition(spark):
    left = repetition.repetition_rules(rows(spark, f"{LONG_X} one\n{LONG_Y} one\n{LONG_X} one")).collect()
    assert left[0]["n_dup_lines"] == 1


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, X)], "item_id long, text string")
    hits = decontamination.benchmark_hits(rows(spark, X, Y), bench).collect()
    assert {r["doc_id"]: r["n_hit"] for r in hits} == {1: 1, 2: 0}


def test_substring_dedup(spark):
    shared = " ".join(f"p{k}" for k in range(12))
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(rows(spark, f"{shared} {X}", f"zz {shared} {Y} yy", f"q {shared} {X}")).collect()}
    assert out == {1: 0, 2: 0, 3: 13}


def test_near_dedup(spark):
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(rows(spark, X, Y, X)).collect()} == {1: 1, 2: 2, 3: 1}


def test_packing(spark):
    import zlib

    out = packing.pack(rows(spark, X, Y, "ab " * 3 + Y)).collect()
    want = {k: zlib.crc32(np.array(ids(t), "<u4").tobytes()) for k, t in enumerate((X, Y, "ab " * 3 + Y), 1)}
    assert {r["doc_id"]: r["ids_crc32"] for r in out} == want


def test_token_output(spark):
    table = token_output.packed_rows(rows(spark, X, Y)).toArrow()
    flat = token_output.read_matrix(table).ravel().tolist()
    for text in (X, Y):
        own = [*ids(text)[:-1], 50256]
        assert any(flat[k : k + len(own)] == own for k in range(len(flat)))


def test_language_id():
    sym, starts, ends, _ = language_id.letter_words(f"{X} {Y} {X}", np.array([0, 3 * len(X) + 2]))
    where, number = language_id.distinct_words(sym, starts, ends)
    assert len(where) == 2 and number[0] == number[2] != number[1]


def test_encoder_compares_bytes(monkeypatch):
    """Even where all pieces had one hash, each would get its own ids."""
    from gritstone.llm import _words

    monkeypatch.setattr(_words.Lanes, "hashes", lambda self: np.zeros(len(self.size), np.uint64))
    encoder = Encoder(default_tokenizer())
    texts = ["one two three", "two one", X, "", "naïve 12 twelve"]
    for _ in range(2):
        for _, flat, ptr in encoder.rows(pa.array(texts), 2):
            assert [flat[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [ids(t) for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_distinct_spans(seed, monkeypatch):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))) for _ in range(40)] + [X, Y]
    texts = [" ".join(rng.choices(pool, k=rng.choice([0, 1, 300]))) for _ in range(6)]
    if seed > 2:  # hashes of two values only: bytes decide
        from gritstone.llm import _words

        monkeypatch.setattr(_words.Lanes, "hashes", lambda self: (self.size % 2).astype(np.uint64) << np.uint64(63))
        monkeypatch.setattr(_words, "mix", lambda x: x)
    for c in chunks(pa.array(texts)):
        seen: dict = {}
        want = [seen.setdefault((r, w), len(seen)) for r in range(c.n) for w in c.words(r)]
        first, number = distinct_spans(lanes(c.data, c.starts, c.ends), c.rows())
        assert number.tolist() == want and len(first) == len(seen)


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "nine ten " + " ".join(f"w{k}" for k in range(20)), "z")], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame([(1, "nine ten"), (2, "nothing of it"), (3, "here")], "item_id long, text string")
    assert repetition.keep_unrepetitive(docs).schema == docs.schema
    for block_words in (200_000, 2):
        left = decontamination.remove_benchmark(docs, bench, block_words=block_words)
        assert left.schema == docs.schema and left.collect()[0]["a.b"] == "z" and left.collect()[0]["text"].startswith("w0 ")
    assert substring_dedup.remove_repeated(docs).schema == docs.schema
    assert near_dedup.near_dedup(docs).columns == docs.columns
