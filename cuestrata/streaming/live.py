"""Live forms of the session, dedup and monitor rules on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType

from cuestrata import rules
from cuestrata.session import scratch


def live_scenes(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "1500 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """Sessions split by silence, as event-time session windows.

    Count, first and last event are folded per session before they reach the state store.
    """
    df = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "first_ts", "last_ts")


def live_dedup(stream: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "2 seconds") -> DataFrame:
    """Drop repeats of ``keys`` that arrive within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


MONITOR_SCHEMA = (
    "run_id bigint, events bigint, completed bigint, actual_secs double, predicted_secs double, "
    "timeout_scale double, extra_retry_budget int, strict_first_pass boolean")
STATE_SCHEMA = (
    "events bigint, chunks array<int>, actual array<double>, predicted array<double>, scale double, extra int, strict boolean")


def live_monitor(stream: DataFrame, profile: str = "balanced") -> DataFrame:
    """Progress and policy per run, kept in the state store and updated per trigger.

    State holds one entry per chunk of a run, never its events.
    """
    floor = rules.MONITOR_FLOOR[profile]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            events, chunks, actual, predicted, scale, extra, strict = state.get
            done = {c: (a, p) for c, a, p in zip(chunks, actual, predicted)}
        else:
            events, done, scale, extra, strict = 0, {}, 1.0, 0, False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for e in rows.itertuples(index=False):
            events += 1
            late = not e.success and "timed out" in (getattr(e, "reason", "") or "").lower()
            slow = bool(e.success and not e.from_cache and e.actual_secs > 2 * e.predicted_secs)
            strict = bool(not e.success or e.quality_score < floor)
            if e.success:
                done[int(e.chunk_index)] = (float(e.actual_secs), max(float(e.predicted_secs), 0.001))
            scale = min(3.0, max(1.0, scale * (1.20 if slow else 0.98)))
            extra = min(extra + 1, 2) if slow else extra
            extra = max(extra, 1) if strict else extra
            if late:
                scale, extra = min(4.0, max(1.0, scale * 1.35)), min(extra + 1, 3)
        spent = sum(a for a, _ in done.values())
        meant = sum(p for _, p in done.values())
        state.update((events, list(done), [a for a, _ in done.values()], [p for _, p in done.values()], scale, extra, strict))
        yield pd.DataFrame([(key[0], events, len(done), spent, meant, scale, extra, strict)], columns=[
            "run_id", "events", "completed", "actual_secs", "predicted_secs", "timeout_scale", "extra_retry_budget", "strict_first_pass"])

    return stream.groupBy("run_id").applyInPandasWithState(
        update, MONITOR_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


LIVE_SCHEMA = (
    "run_id bigint, chunk_index int, event_id bigint, ts timestamp, completed bigint, eta_secs double, slow boolean, low_quality boolean, "
    "timeout_scale double, extra_retry_budget int, strict_first_pass boolean")
LIVE_STATE = (
    "chunks array<int>, actuals array<double>, predicteds array<double>, actual double, predicted double, scale double, extra int, strict boolean")


def live_chunk_monitor(stream: DataFrame, totals: DataFrame, profile: str = "balanced", idle_ms: int = 86_400_000, watermark: str = "1 hour") -> DataFrame:
    """One row per success event as it arrives: progress, remaining seconds, flags and the policy after it.

    The stream form of ``chunk_monitor`` and ``adaptive_policy``: over events that arrive in order both
    give the same figures.  ``totals`` (run_id, total_predicted_secs) is a static table.  State holds the
    last success of each chunk of a run, never its events; a run without an event for ``idle_ms`` of event
    time is forgotten, and events later than ``watermark`` are dropped.
    """
    floor = rules.MONITOR_FLOOR[profile]
    names = [f.split()[0] for f in LIVE_SCHEMA.split(", ")]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chunks, actuals, predicteds, actual, predicted, scale, extra, strict = state.get if state.exists else ([], [], [], 0.0, 0.0, 1.0, 0, False)
        done = dict(zip(chunks, zip(actuals, predicteds, strict=True), strict=True))
        events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok = events["success"].to_numpy(bool)
        slow = ok & ~events["from_cache"].to_numpy(bool) & (events["actual_secs"] > 2 * events["predicted_secs"]).to_numpy()
        low = ~ok | (events["quality_score"] < floor).to_numpy()
        reason = events["reason"].fillna("") if "reason" in events else pd.Series("", index=events.index)
        late = ~ok & reason.str.lower().str.contains("timed out", regex=False).to_numpy(bool)
        columns = zip(
            events["chunk_index"].tolist(), events["event_id"].tolist(), events["ts"].tolist(), ok.tolist(), slow.tolist(), low.tolist(), late.tolist(),
            events["actual_secs"].tolist(), events["predicted_secs"].clip(lower=0.001).tolist(), events["total_predicted_secs"].tolist(), strict=True)
        out = []
        for chunk, event, ts, fine, is_slow, is_low, is_late, secs, meant, total in columns:
            scale = min(3.0, max(1.0, scale * (1.20 if is_slow else 0.98)))
            extra = min(extra + 1, 2) if is_slow else extra
            extra, strict = max(extra, 1) if is_low else extra, is_low
            if is_late:
                scale, extra = min(4.0, max(1.0, scale * 1.35)), min(extra + 1, 3)
            if fine:
                before = done.get(chunk, (0.0, 0.0))
                actual, predicted = actual + secs - before[0], predicted + meant - before[1]
                done[chunk] = (secs, meant)
                eta = max(0.0, total - predicted) * max(0.05, actual / predicted) if predicted > 0 else 0.0
                out.append((key[0], chunk, event, ts, len(done), eta, is_slow, is_low, scale, extra, strict))
        state.update((list(done), [a for a, _ in done.values()], [p for _, p in done.values()], actual, predicted, scale, extra, strict))
        last = int(events["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    known = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).join(totals.select("run_id", F.col("total_predicted_secs").cast("double").alias("total_predicted_secs")), "run_id")
    return known.groupBy("run_id").applyInPandasWithState(update, LIVE_SCHEMA, LIVE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(out: DataFrame, spark: SparkSession, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now and read back what it wrote.

    Output and progress go to ``folder``, where a later call goes on, or to a new one in the shared folder.  For ``update`` streams each batch is
    written with its number as ``batch_id``.
    """
    folder = folder or scratch(spark, name)
    where, progress = f"{folder}/rows", f"{folder}/progress"
    writer = out.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", where).outputMode("append").start()
    else:
        query = writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{where}/batch_id={i}")).outputMode(mode).start()
    query.awaitTermination()
    schema = out.schema if mode == "append" else out.schema.add("batch_id", LongType())
    return spark.read.schema(schema).parquet(where)
