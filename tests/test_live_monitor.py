"""The live monitor against its batch form, over a restart, and how it forgets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cuestrata.operators import monitor
from cuestrata.streaming import live

SCHEMA = "run_id long, chunk_index int, event_id long, ts timestamp, success boolean, actual_secs double, predicted_secs double, quality_score double, from_cache boolean, reason string"


def events(spark):
    rng = random.Random(4)
    rows = [(i % 3, rng.randint(0, 5), i, 1_700_000_000 + i * 7, rng.random() < 0.8, rng.random() * 90, rng.choice([0.0, 20.0, 40.0]), rng.random(), rng.random() < 0.2, rng.choice(["Timed OUT", "bad", None])) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    whole, source, folder = events(spark), str(tmp_path / "in"), str(tmp_path / "progress")
    totals = spark.createDataFrame([(r, 300.0 + r) for r in range(3)], "run_id long, total_predicted_secs double")
    for lo, hi in ((0, 50), (50, 51), (51, 120)):  # three runs of the stream, each a new query on the same folder
        whole.where(f"event_id >= {lo} and event_id < {hi}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        got = live.run_to_table(live.live_chunk_monitor(stream, totals), spark, "monitor", folder=folder)
    names = ["run_id", "chunk_index", "event_id", "completed", "slow", "low_quality"]
    row = lambda r: (*(r[c] for c in names), round(r.eta_secs, 9))
    rows = got.collect()
    assert sorted(map(row, rows)) == sorted(map(row, monitor.chunk_monitor(whole, totals).collect()))
    last = {}
    for r in sorted(rows, key=lambda r: r.event_id):
        upto = whole.where(f"run_id = {r.run_id} and event_id <= {r.event_id}")
        last[r.run_id] = (r, upto)
    for r, upto in last.values():
        p = monitor.adaptive_policy(upto).first()
        assert (round(r.timeout_scale, 9), r.extra_retry_budget, r.strict_first_pass) == (round(p.timeout_scale, 9), p.extra_retry_budget, p.strict_first_pass)


def test_idle_runs_are_forgotten(spark, tmp_path):
    """Another run's event moves the clock; the first run then begins anew."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "progress")
    totals = spark.createDataFrame([(0, 300.0), (1, 300.0)], "run_id long, total_predicted_secs double")
    one = lambda run, chunk, event, ts: (run, chunk, event, ts, True, 10.0, 20.0, 0.9, False, None)
    for rows in ([one(0, 1, 1, 1000), one(0, 2, 2, 1001)], [one(1, 1, 3, 90_000)], [one(0, 3, 4, 90_001)]):
        batch = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.col("ts").cast("timestamp"))
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        got = live.run_to_table(live.live_chunk_monitor(stream, totals, idle_ms=60_000, watermark="0 seconds"), spark, "monitor", folder=folder)
    assert {(r.event_id, r.completed) for r in got.collect()} == {(1, 1), (2, 2), (3, 1), (4, 1)}
