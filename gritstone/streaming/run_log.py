"""Run logs and failures, as batches and as streams: identity, de-duplication, rates, open groups, replay.

Functions that take a stream also take a batch of the same columns: with ``availableNow`` both give the
same rows, but for what arrives later than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gritstone.operators.sets import dedup_keep_first

STORED = ("Validation", "DeploymentMismatch")


def failure_id(kind: Column, steps: Column, message: Column) -> Column:
    """16 hex digits that name a failure; the seed has no part in it."""
    return F.substring(F.sha2(F.concat_ws("|", kind, steps, message), 256), 1, 16)


def dedup_failures(df: DataFrame, order: Sequence[str] = ("ts",), kind: str = "kind", stored: Sequence[str] = STORED, watermark: str = "1 hour") -> DataFrame:
    """R2: the first row of each id of the stored kinds. On a stream, ids are remembered for the watermark."""
    kept = df.filter(F.col(kind).isin(*stored))
    if df.isStreaming:
        return kept.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])
    return dedup_keep_first(kept, ["id"], order)


def drop_noop_events(trace: DataFrame, changed: Column, marker: Column) -> DataFrame:
    """Events that neither change nor remap anything go; markers stay."""
    return trace.filter(F.coalesce(changed, F.lit(False)) | F.coalesce(marker, F.lit(False)))


def rate_monitor(df: DataFrame, ok: Column, mismatch: Column, failure: Column, ts: str = "ts", width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour", exact: bool = False) -> DataFrame:
    """For each tumbling (or sliding) window: iterations, ok, mismatches, distinct failures and iterations a second.

    Distinct failures are approximate unless ``exact``, which streams do not allow.
    """
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    kinds = F.count_distinct(failure) if exact else F.approx_count_distinct(failure)
    one = rows.groupBy(window.alias("w")).agg(F.count("*").alias("iterations"), F.count_if(ok).alias("ok"), F.count_if(mismatch).alias("mismatches"), kinds.alias("unique_failures"))
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return one.select(F.col("w.start").alias("window_start"), "iterations", "ok", "mismatches", "unique_failures", (F.col("iterations") / seconds).alias("rate"))


def gap_sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", watermark: str = "1 day") -> DataFrame:
    """R4 where only pauses matter: sessions that end after ``gap`` without a row: key, start, end of the last row plus gap, n."""
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    one = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return one.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class OpenGroup(StatefulProcessor):
    """State of R4: the open group of a key; it closes at an end marker or when its timer runs out.

    A group that ran out is remembered: an end marker that comes next, and so too late, is given as ``late`` with that group's first
    row, not as a group of its own. A start, or another row, forgets it.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "first long, last long, n long, until long")
        self.overdue = handle.getValueState("overdue", "first long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        state = self.group.get() if self.group.exists() else None
        overdue = self.overdue.get() if self.overdue.exists() else None
        out = []
        for r in every.itertuples(index=False):
            late, overdue = overdue, None
            if late is not None and state is None and r.is_end and not r.is_start:
                out.append((*key, late[0], r.seq, late[1] + 1, "late"))
                continue
            if r.is_start or state is None:
                if state is not None and state[2]:
                    out.append((*key, state[0], state[1], state[2], "cut"))
                state = (r.seq, r.seq, 0, 0)
            state = (state[0], r.seq, state[2] + 1, r.ts_ms + self.timeout_ms)
            if r.is_end:
                out.append((*key, state[0], state[1], state[2], "closed"))
                state = None
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if overdue is None:
            self.overdue.clear()
        if state is None:
            self.group.clear()
        else:
            self.group.update(state)
            self.handle.registerTimer(state[3])
        yield pd.DataFrame(out, columns=["run_id", "first_seq", "last_seq", "n", "how"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.group.exists():
            first, last, n, _ = self.group.get()
            self.group.clear()
            self.overdue.update((first, n))
            yield pd.DataFrame([(*key, first, last, n, "timeout")], columns=["run_id", "first_seq", "last_seq", "n", "how"])

    def close(self) -> None:
        pass


def stream_segments(stream: DataFrame, is_start: Column, is_end: Column, timeout_ms: int = 3_600_000, watermark: str = "1 hour") -> DataFrame:
    """Closed groups of an unbounded log (run_id, seq, ts): run_id, first_seq, last_seq, n, how (closed, cut, timeout), and ends that come after the timeout of their group (late; ``late_ends`` takes them out)."""
    rows = stream.select("run_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), F.coalesce(is_start, F.lit(False)).alias("is_start"), F.coalesce(is_end, F.lit(False)).alias("is_end")).withWatermark("ts", watermark)
    return rows.groupBy("run_id").transformWithStateInPandas(OpenGroup(timeout_ms), "run_id long, first_seq long, last_seq long, n long, how string", "append", "eventTime")


def late_ends(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of ``stream_segments`` without ends that came too late, and these: run_id, first_seq of the group that had run out, end_seq."""
    late = F.col("how") == "late"
    return groups.filter(~late), groups.filter(late).select("run_id", "first_seq", F.col("last_seq").alias("end_seq"))


class LastRows(StatefulProcessor):
    """State of R5: the last ``n`` rows of a key since its last failure, and how many failures it has had."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "seq long")
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        failures = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        for r in every.itertuples(index=False):
            kept = [*kept[1 - self.n :], r.seq] if self.n > 1 else [r.seq]
            if r.is_failure:
                failures += 1
                out += [(*key, seq, len(kept) - 1 - k, failures) for k, seq in enumerate(kept)]
                kept = []
        if kept:
            self.kept.put([(x,) for x in kept])
        else:
            self.kept.clear()
        self.failures.update((failures,))
        yield pd.DataFrame(out, columns=["run_id", "seq", "back", "failure_no"])

    def close(self) -> None:
        pass


def stream_tails(stream: DataFrame, is_failure: Column, n: int = 400, watermark: str = "1 hour") -> DataFrame:
    """R5 of an unbounded log (run_id, seq, ts), whose runs arrive in order: run_id, seq, back, failure_no of the last ``n`` rows up to and with each failure, as soon as it comes.

    What ``tail_before_failure`` gives on a batch. A run keeps ``n`` numbers of rows at most, older ones go.
    """
    rows = stream.select("run_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), F.coalesce(is_failure, F.lit(False)).alias("is_failure")).withWatermark("ts", watermark)
    return rows.groupBy("run_id").transformWithStateInPandas(LastRows(n), "run_id long, seq long, back long, failure_no long", "append", "eventTime")


def replay(failures: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored failures with the outcome of running their input again: REPRODUCED if it fails alike."""
    again = results.select(*key, F.col("id").alias("again"))
    return failures.join(again, list(key), "left").withColumn("outcome", F.when(F.col("again").eqNullSafe(F.col("id")), "REPRODUCED").otherwise("NOT REPRODUCED")).drop("again")


def mismatch(a: DataFrame, b: DataFrame, key: Sequence[str], ok: str = "ok") -> DataFrame:
    """Keys at which the original is well and the variant failed."""
    return a.filter(ok).select(*key).join(b.filter(~F.col(ok)).select(*key), list(key))
