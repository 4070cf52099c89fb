"""Registered queries against their SQL on the smallest tables, and stability of results."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")

SAMPLE = [
    "scene_quality", "structural_health", "source_scene_quality", "merge_intervals", "verify_against_speech", "cue_confidence",
    "low_confidence_spans", "align_by_time", "phrase_consistency", "stitch_chunks", "splice", "knowledge_snapshot", "best_run_similar",
    "chunk_monitor", "adaptive_policy", "read_srt", "live_scenes", "live_monitor",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, con, name):
    err, n = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert not err and n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["recording_id", "scene_id", "n", "difficulty", "score", "floor", "passed"] and df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["scene_split_gap", "stitch_chunks", "low_confidence_spans"])
def test_same_rows_for_any_partitioning(spark, name):
    seen = []
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = entry.queries()[name](spark, SF)
        seen.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    """Times alone are read for scenes."""
    plan = entry.queries()["scene_split_gap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("text:" in line.split("ReadSchema")[1] for line in scans)
