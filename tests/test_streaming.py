"""Streams give what batches of the same rows give."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.streaming import run_log as R

EVENTS = "/root/testdata/sf0.001/events.parquet"


def source(spark, tmp_path, streaming: bool):
    folder = tmp_path / "events"
    if not folder.exists():
        spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).parquet(str(folder)) if streaming else spark.read.parquet(str(folder))


def drain(spark, df, name: str, mode: str = "append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def named(df):
    k = F.col("event_type")
    return df.select("ts", "event_id", F.when(k == "error", "Validation").otherwise("Obfuscation").alias("kind"), R.failure_id(k, F.col("props"), F.lit("")).alias("id"))


def test_dedup(spark, tmp_path):
    batch = {r["id"] for r in R.dedup_failures(named(source(spark, tmp_path, False))).collect()}
    stream = drain(spark, R.dedup_failures(named(source(spark, tmp_path, True)), watermark="60 days"), "dedup")
    assert {r["id"] for r in stream.collect()} == batch


def test_rate(spark, tmp_path):
    k = F.col("event_type")
    args = (k == "purchase", k == "error", F.when(k == "error", F.col("props")))
    batch = {r["window_start"]: r["iterations"] for r in R.rate_monitor(source(spark, tmp_path, False), *args, width="1 day").collect()}
    stream = drain(spark, R.rate_monitor(source(spark, tmp_path, True), *args, width="1 day"), "rate", "complete")
    assert {r["window_start"]: r["iterations"] for r in stream.collect()} == batch


def test_sessions(spark, tmp_path):
    batch = {(r["user_id"], r["start"], r["n"]) for r in R.gap_sessions(source(spark, tmp_path, False), "user_id").collect()}
    stream = {(r["user_id"], r["start"], r["n"]) for r in drain(spark, R.gap_sessions(source(spark, tmp_path, True), "user_id"), "sessions").collect()}
    assert stream <= batch and len(stream) > 0.8 * len(batch)  # the last ones are still open


def test_open_groups(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 0, "S"), (1, 1, "a"), (1, 2, "E"), (1, 3, "b"), (1, 4, "S"), (1, 5, "c"), (2, 0, "S"), (2, 1, "E")]
    log = spark.createDataFrame(rows, "run_id long, seq long, kind string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    later = spark.createDataFrame([(9, 0, "E")], "run_id long, seq long, kind string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_900_000)))
    folder = str(tmp_path / "log")
    log.coalesce(1).write.parquet(folder)
    later.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kind = F.col("kind")
    out = drain(spark, R.stream_segments(stream, kind == "S", kind == "E", timeout_ms=60_000, watermark="1 minute"), "groups")
    got = {tuple(r) for r in out.collect()}
    assert {(1, 0, 2, 3, "closed"), (1, 3, 3, 1, "cut"), (2, 0, 1, 2, "closed"), (1, 4, 5, 2, "timeout")} <= got


def staged(spark, tmp_path, name: str, *files):
    """A stream of (run_id, seq, second, kind), a file a trigger."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path / name)
    for rows in files:
        df = spark.createDataFrame(rows, "run_id long, seq long, second long, kind string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second")))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), spark.read.parquet(folder)


def test_ends_that_come_too_late(spark, tmp_path):
    first = [(1, 0, 0, "S"), (1, 1, 1, "a"), (2, 0, 0, "S"), (3, 0, 0, "S")]
    pause = [(9, 0, 500, "S"), (9, 1, 500, "E")]
    later = [(1, 2, 1000, "E"), (2, 1, 1000, "S"), (2, 2, 1001, "E"), (3, 1, 1000, "a"), (3, 2, 1001, "E")]
    stream, _ = staged(spark, tmp_path, "late", first, pause, pause, later, [(9, 2, 5000, "S"), (9, 3, 5000, "E")])
    kind = F.col("kind")
    out = drain(spark, R.stream_segments(stream, kind == "S", kind == "E", timeout_ms=60_000, watermark="1 minute"), "late_groups")
    groups, late = R.late_ends(out)
    assert {tuple(r) for r in late.collect()} == {(1, 0, 2)}
    got = {tuple(r) for r in groups.collect()}
    assert {(1, 0, 1, 2, "timeout"), (2, 0, 0, 1, "timeout"), (3, 0, 0, 1, "timeout"), (2, 1, 2, 2, "closed"), (3, 1, 2, 2, "closed")} <= got
    assert not any(r[:2] == (1, 2) for r in got)


def test_tails_of_a_stream(spark, tmp_path):
    import random

    from gritstone.operators.sequences import tail_before_failure

    rng = random.Random(6)
    rows = [(run, seq, 10 * seq, "error" if rng.random() < 0.15 else "view") for run in range(1, 6) for seq in range(60)]
    stream, batch = staged(spark, tmp_path, "tails", *([r for r in rows if 20 * k <= r[1] < 20 * k + 20] for k in range(3)))
    for n in (1, 4, 400):
        out = drain(spark, R.stream_tails(stream, F.col("kind") == "error", n), f"tails_{n}")
        want = tail_before_failure(batch, ["run_id"], ["seq"], F.col("kind") == "error", n).select("run_id", "seq", "back", "failure_no")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
