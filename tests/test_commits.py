"""Stored logs: repeated commits, failed batches, compaction, two writers, later columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuestrata.sources.commits import Commits
from cuestrata.sources.run_log import RunLog

SCHEMA = "run_id long, ts string, plan string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"2026-01-{i:02d}", f"p{i}") for i in ids], SCHEMA)


def ids(df):
    return sorted(r.run_id for r in df.collect())


def test_append_read_and_repeat(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.read() is None and not log.compact()
    assert log.append(rows(spark, 1, 2), "a") and log.append(rows(spark, 3), "b")
    assert not log.append(rows(spark, 1, 2), "a")
    assert ids(log.read()) == [1, 2, 3] and ids(log.read(2)) == [2, 3]
    assert log.append(rows(spark, 4).withColumn("extra", F.lit(7)), "c")
    assert {(r.run_id, r.extra) for r in log.read().collect()} == {(1, None), (2, None), (3, None), (4, 7)}


def test_compaction_keeps_the_newest(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    for i in range(1, 5):
        log.append(rows(spark, i), f"run-{i}")
    assert log.compact(3) and ids(log.read()) == [2, 3, 4]
    assert not log.append(rows(spark, 4), "run-4")  # still known
    assert log.append(rows(spark, 5), "run-5") and ids(log.read()) == [2, 3, 4, 5]
    assert log.commits.vacuum() == 4 and ids(log.read()) == [2, 3, 4, 5] and log.commits.vacuum() == 0


def test_failed_batch_is_never_read(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, 1), "a")
    bad = rows(spark, 2).withColumn("plan", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        log.append(bad, "b")
    rows(spark, 9).write.parquet(f"{tmp_path}/log/data/left-over")
    assert ids(log.read()) == [1]
    assert log.append(rows(spark, 2), "b") and ids(log.read()) == [1, 2]


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    one, two = Commits(spark, path), Commits(spark, path)
    folders = []
    for writer, i in ((one, 1), (two, 2)):
        folders.append(writer.folder())
        rows(spark, i).write.parquet(f"{path}/{folders[-1]}")
    seen, calls = one.all(), []
    real = one.all

    def stale():
        calls.append(1)
        return seen if len(calls) == 1 else real()

    two.commit("b", folders[1])
    monkeypatch.setattr(one, "all", stale)  # has not seen the other's commit
    assert one.commit("a", folders[0])
    assert [(c.number, c.token) for c in two.all()] == [(0, "b"), (1, "a")] and ids(two.read()) == [1, 2]
    assert not one.append(rows(spark, 3), "late", base=True, after=0)  # a commit came in between
    assert ids(two.read()) == [1, 2]
