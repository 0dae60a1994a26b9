"""Queries whose files, shuffles or task memory must not grow faster than their input."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from gritstone.operators import aggregates as A
from gritstone.operators import checks as V
from gritstone.operators import graphs as G
from gritstone.operators import parsing as U
from gritstone.sources.corpus import read_code_corpus, read_trace_log, write_packed
from gritstone.sources.scratch import shared_folder


def files_in(folder: str) -> set[str]:
    return {str(p) for p in Path(folder.removeprefix("file:")).rglob("*.*") if p.is_file()}


def test_packed_files_read_like_files(spark, tmp_path):
    rows = [("a.hex", b"6001"), ("b", b"0x60 01\n"), ("c", b"\xff\x00\n"), ("e", b"0x\xff")]
    (tmp_path / "plain").mkdir()
    for name, content in rows:
        (tmp_path / "plain" / name).write_bytes(content)
    write_packed(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "packed"))
    plain = {r["name"].rsplit("/")[-1]: r["code"] for r in read_code_corpus(spark, str(tmp_path / "plain")).collect()}
    packed = {r["name"]: r["code"] for r in read_code_corpus(spark, str(tmp_path / "packed"), packed=True).collect()}
    assert packed == plain and len(packed) == 4
    log = '{"metadata":{"transforms_applied":[]},"trace":[{"kind":"view","diff":"None"},{"kind":{"Purchase":{"props":"ü"}},"diff":"None"}]}'
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "1.json").write_text(log, encoding="utf-8")
    write_packed(spark.createDataFrame([("1", log)], "name string, content string"), str(tmp_path / "logs"))
    named = lambda df: [tuple(r)[1:] for r in df.orderBy("seq").collect()]
    assert named(read_trace_log(spark, str(tmp_path / "logs"), packed=True)) == named(read_trace_log(spark, str(tmp_path / "one")))


def test_corpora_and_logs_take_few_files(spark, tmp_path):
    """a file for each key took the file system some milliseconds each."""
    spark.range(400).selectExpr("id as s_suppkey", "concat('name ', id) as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(800).selectExpr("id as event_id", "id % 400 as user_id", "'view' as event_type", "1.0 as value", "timestamp_seconds(id) as ts", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    for name, rows in (("s1_read_code_corpus", 400), ("s3_read_trace_log", 800)):
        before = files_in(shared_folder(spark))
        assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == rows
        assert len(files_in(shared_folder(spark)) - before) < 100


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def odd_codes(spark, trailer: bool = True):
    """Random codes of few operations, so that copies, returns, openings and endings meet; empty, null, cut-off and tiny ones; with and without a known runtime."""
    rng = random.Random(3)
    parts = ["39", "f3", "36", "00", "fd", "fe", "5b", "01", "0c", "6080604052600436", "6080604052600435", "60", "61000a", "620000ff", "63000000f0", "6f" + "00" * 14 + "0096", "7f" + "00" * 29 + "01ffff", "5f", "61ffff"]
    rows = []
    for k in range(400):
        own = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 60, 120])))
        code = "".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 40]))) + rng.choice(["", own, own]) + (rng.choice(["", "a1a10002", "0000", "ffff"]) if trailer else "")
        rows.append((k, bytearray.fromhex(code) if k % 37 else None, bytearray.fromhex(own) if k % 3 == 0 else None))
    return spark.createDataFrame(rows, "code_id long, code binary, runtime binary").repartition(3)


def test_sections_of_codes_in_one_pass(spark):
    """the same as by windows and joins over the instructions, without a shuffle."""
    codes = odd_codes(spark)
    wanted = U.checked_sections(codes.drop("runtime"), U.decode_instructions(codes), codes.filter("runtime is not null").select("code_id", "runtime"))
    got = U.sections_of_codes(codes)
    assert got.columns == ["code_id", "kind", "offset", "len", "status"]
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, wanted.select(got.columns).collect()))
    assert {x[1] for x in found} == {"Init", "ConstructorArgs", "Runtime", "Padding", "Auxdata"} and len({x[4] for x in found}) > 1
    assert shuffles(U.sections_of_codes(spark.range(3).selectExpr("id as code_id", "unhex('6001') as code", "unhex('60') as runtime"))) == 0


def test_encoding_and_unknowns_in_one_pass(spark, tmp_path):
    """The same as over rows of instructions; codes without an instruction have no row, as in the SQL."""
    codes = odd_codes(spark).drop("runtime")
    instr = U.decode_instructions(codes)
    assert sorted(map(tuple, U.encode_codes(codes).collect())) == sorted(map(tuple, U.encode_check(instr, codes).collect()))
    wanted = A.unknown_stats(instr.filter("idx is not null"), F.col("mnemonic") == "UNKNOWN", "opcode", ["code_id"])
    every = codes.unionByName(spark.createDataFrame([(1000, bytearray(range(256)) * 2), (1001, bytearray(b"\xef\xef\x0c\x60"))], codes.schema))
    got = {r["code_id"]: tuple(r)[1:] for r in U.unknown_opcodes(every).collect()}
    assert got.pop(1001) == (3, 3, 2) and got.pop(1000)[2] > 60
    assert got == {r["code_id"]: tuple(r)[1:] for r in wanted.collect()}
    spark.createDataFrame([(1, "some text"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, most in (("u2_encode_check", 0), ("p2_unknown_opcodes", 1)):
        out = __spark_entry__.queries()[name](spark, str(tmp_path))
        assert shuffles(out) <= most and [r["code_id"] for r in out.collect()] == [1]


def test_decode_in_arrow_batches(spark):
    """the table function's rows come from Arrow batches, not one by one."""
    codes = odd_codes(spark).drop("runtime")
    U.register_decode(spark, "decode_odd")
    codes.createOrReplaceTempView("odd_codes")
    got = spark.sql("select code_id, d.* from odd_codes, lateral decode_odd(code) d")
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.drop("imm").collect())) == sorted(map(tuple, U.decode_instructions(codes).filter("idx is not null").drop("imm").collect()))


def test_interval_properties_deal_their_rows(spark, monkeypatch):
    """the number of tasks follows the rows, whatever spark.sql.shuffle.partitions is."""
    monkeypatch.setattr(V, "ROWS_A_TASK", 100)
    codes = spark.range(1000).withColumnRenamed("id", "code_id")
    sections = codes.selectExpr("code_id", "inline(array(named_struct('kind', 'Init', 'offset', 0, 'len', 4), named_struct('kind', 'Runtime', 'offset', 4, 'len', 6)))")
    out = V.interval_properties(sections, codes.selectExpr("code_id", "10 as size"))
    assert out.rdd.getNumPartitions() == 21
    assert out.filter("no_overlap and full_cover and in_order and unique_kinds").count() == 1000


def test_ngram_diversity_sends_many_hashes_a_row(spark, monkeypatch):
    """a bucket of hashes travels as one row; counts are the same in any number of buckets."""
    docs = spark.createDataFrame([("a", "abcabcabd ü€"), ("a", None), ("b", ""), (None, "xyxyxyxy"), ("b", "abcab"), ("a", "zz")], "lang string, text string").repartition(3)
    texts = {"a": ["abcabcabd ü€", "zz"], "b": ["", "abcab"], None: ["xyxyxyxy"]}
    wanted = {}
    for lang, own in texts.items():
        for n in (2, 4, 8):
            grams = [t[i : i + n] for t in own for i in range(len(t) - n + 1)]
            wanted[lang, n] = (len(grams), len(set(grams)))
    for size in (1, 1 << 23):
        monkeypatch.setattr(A, "BUCKET", size)
        out = A.ngram_diversity(docs, "text", (2, 4, 8), ["lang"])
        assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["lang"], r["n"]): (r["windows"], r["distinct_windows"]) for r in out.collect()} == wanted


def test_code_metrics_in_one_pass(spark):
    """the same as by windows, joins and a group for each graph; also where graphs over the limit go the long way."""
    rng = random.Random(21)
    raw = [None, b"", b"\x7f", b"\x60", b"\x00", b"\x5b" * 200, bytes.fromhex("5b6008576000560000" + "5b"), bytes.fromhex("5b60085760005600" + "5b"), bytes.fromhex("6001600201565b"), bytes.fromhex("6003565b00")]
    for k in range(300):  # blocks of four bytes that mostly jump to each other, the near ones more often
        size = rng.randrange(1, 40)
        to = lambda at, n=size: 4 * min(max(at + rng.randrange(-3, 4), 0), n - 1) if rng.random() < 0.8 else rng.randrange(4 * n)
        ends = [lambda at: bytes([0x60, to(at), 0x57])] * 6 + [lambda at: bytes([0x60, to(at), 0x56]), lambda at: b"\x50\x5f\x80", lambda at: b"\x5f\x5f\xfd"][: 1 + k % 3]
        raw.append(b"".join(b"\x5b" + rng.choice(ends)(at) for at in range(size)) + b"\x5b" * (k % 2))
    codes = spark.createDataFrame(list(enumerate(raw)), "code_id long, code binary").repartition(3)
    blocks = U.code_blocks(codes)
    edges = G.build_edges(blocks)
    for root, limit in (("last", G.SMALL), ("exit", G.SMALL), ("last", 30)):
        wanted = G.graph_metrics(codes, blocks, edges, root)
        got = G.code_metrics(codes, root, limit)
        assert got.dtypes == wanted.dtypes
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, wanted.collect())) and len(rows) == len(raw) - 4
        assert len({r[5] for r in rows}) > 5 and rows[7 - 4][5] == 0.25
        assert any(r[3] > 30 for r in rows) and any(r[3] <= 30 for r in rows)
    assert G.code_metrics(codes.limit(0)).count() == 0


def test_graph_metrics_write_one_table(spark, tmp_path):
    """neither blocks nor edges nor graphs are written between, nor shuffled."""
    spark.range(40).selectExpr("id as doc_id", "repeat(concat('some text ', id), cast(id * 20 as int)) as text").write.parquet(str(tmp_path / "documents.parquet"))
    before = files_in(shared_folder(spark))
    out = __spark_entry__.queries()["g5_graph_metrics"](spark, str(tmp_path))
    assert out.count() == 39 and shuffles(out) == 0
    assert len({str(Path(f).parent) for f in files_in(shared_folder(spark)) - before}) == 1


def test_selectors_with_targets_that_no_code_has(spark):
    """of many codes made of digests some have a key with a PUSH8 or wider behind it, whose number conv refused."""
    opening, wanted = "60003560e01c", {}
    rows = []
    for k, (size, digits) in enumerate([(2, "0102"), (32, "ff" * 32), (8, "ff" * 8), (8, "7f" + "ff" * 7), (16, "00" * 14 + "0a0b"), (9, "01" + "00" * 8), (1, "00"), (7, "ff" * 7), (8, "0fffffffffffffff"), (0, "")]):
        rows.append((k, bytearray.fromhex(f"{opening}63aabbcc{k:02x}14{0x5F + size:02x}{digits}57")))
        wanted[k] = int(digits, 16) if digits and int(digits, 16) < 1 << 60 else None
    got = U.selector_table(U.decode_instructions(spark.createDataFrame(rows, "code_id long, code binary"))).collect()
    assert {r["code_id"]: r["target"] for r in got} == wanted
    assert [r["selector"] for r in sorted(got)] == [f"aabbcc{k:02x}" for k in range(len(rows))]
