"""Groups taken whole, by blocks, or some of each: the same rows, and few reads of the source."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuestrata.operators import intervals, monitor, names, ordered, quality, runs, scenes
from cuestrata.functions import repair

SCHEMA = "recording_id long, pos int, start_ms long, end_ms long, text string"


@pytest.fixture(scope="module")
def cues(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for rec in range(6):
        at = 0
        for pos in range(5 if rec % 2 else 60):
            at += rng.choice([0, 300, 900, 2000, 5000])
            rows.append((rec, pos, at, at + rng.choice([100, 800, 3000]), rng.choice(["hello there you", "I'm's here", "no no", "", "Anna went home"])))
    path = str(tmp_path_factory.mktemp("cues") / "cues")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def reads(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


OPERATORS = {
    "prev_end": scenes.prev_end, "gap": scenes.scene_split, "overlap": lambda c: scenes.scene_split(c, "overlap"), "bad_timing": lambda c: scenes.scene_split(c, "gap", bad_timing=True),
    "scene_quality": scenes.scene_quality, "source": scenes.source_scene_quality, "adjacent": scenes.adjacent_duplicate, "structural": quality.structural_health,
    "merged": lambda c: intervals.merge_intervals(c.select("recording_id", "start_ms", "end_ms")), "translation": quality.translation_quality,
    "gaps": lambda c: intervals.complement(c, c.groupBy("recording_id").agg((F.max("end_ms") + 999).alias("duration_ms"))),
    "islands": lambda c: intervals.silence_islands(c.withColumn("energy_db", -(F.col("pos") * 7 % 60).cast("double"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_whole_groups_and_blocks_agree(cues, monkeypatch, name):
    rows = lambda: sorted(map(str, OPERATORS[name](cues).collect()))
    want = rows()
    assert want
    for most in (0, 20):  # all by blocks; the long recordings by blocks
        monkeypatch.setattr(ordered, "WHOLE_ROWS", most)
        assert rows() == want


def test_one_read_and_one_shuffle(cues):
    assert reads(scenes.prev_end(cues)) == 1 and exchanges(scenes.prev_end(cues)) == 1
    assert reads(scenes.scene_split(cues)) == 1 and exchanges(scenes.scene_split(cues)) == 1
    assert reads(scenes.scene_quality(cues)) == 1  # of the staged features
    assert exchanges(scenes.scene_quality(cues)) == 1
    assert reads(scenes.source_scene_quality(cues)) == 1
    assert reads(intervals.merge_intervals(cues)) == 1 and exchanges(intervals.merge_intervals(cues)) <= 3


def test_long_token_loop(spark):
    text = "a b " * 10000 + "c d c d e"
    row = repair.collapse_token_loops(spark.createDataFrame([(text,)], "text string")).first()
    assert row.text.split() == ["a", "b"] * 5000 + ["c", "d", "e"]
    mixed = "x y x y z x y x y x y x y w"
    assert repair.collapse_token_loops(spark.createDataFrame([(mixed,)], "text string")).first().text == "x y z x y x y w"


def test_policy_of_a_long_minute(spark, monkeypatch):
    """A minute of many events is chained in pieces, with the result of one chain."""
    rng = random.Random(2)
    events = [(1 + i % 2, i, f"2026-01-01 00:0{i % 3}:{i % 60:02d}", i % 7, rng.random() < 0.8, rng.random() * 100, 30.0, rng.random(), False, rng.choice(["Timed out", "bad"])) for i in range(600)]
    df = spark.createDataFrame(events, "run_id long, event_id long, ts string, chunk_index int, success boolean, actual_secs double, predicted_secs double, quality_score double, from_cache boolean, reason string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    rows = lambda: [(r.run_id, round(r.timeout_scale, 9), r.extra_retry_budget, r.strict_first_pass) for r in monitor.adaptive_policy(df).orderBy("run_id").collect()]
    want = rows()
    monkeypatch.setattr(monitor, "PIECE", 7)
    assert rows() == want
    got = {}
    for run, _, _, _, ok, actual, meant, score, _, reason in sorted(events, key=lambda e: (e[2], e[1])):
        scale, extra, _ = got.get(run, (1.0, 0, False))
        slow, low, late = ok and actual > 2 * meant, not ok or score < 0.65, not ok and reason == "Timed out"
        scale = min(3.0, max(1.0, scale * (1.2 if slow else 0.98)))
        extra = min(extra + 1, 2) if slow else extra
        extra = max(extra, 1) if low else extra
        if late:
            scale, extra = min(4.0, max(1.0, scale * 1.35)), min(extra + 1, 3)
        got[run] = scale, extra, low
    assert want == [(k, round(s, 9), e, x) for k, (s, e, x) in sorted(got.items())]


def test_name_leaders_follow_ranks(spark):
    """Chains of near names: a follower of a leader leads nobody."""
    rng = random.Random(6)
    words = sorted({"K" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)} | {"Bo", "Ba", "Bob"})
    count = {w: rng.randint(1, 4) for w in words}
    rows = [(1, i, 0, 1, w) for i, w in enumerate(w for w in words for _ in range(count[w]))]
    got = {r.word: r.canonical for r in names.name_leaders(spark.createDataFrame(rows, SCHEMA)).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    leaders, want = [], {}
    for w in sorted(words, key=lambda w: (-count[w], w)):
        first = next((x for x in leaders if x[0] == w[0] and abs(len(x) - len(w)) <= 2 and edits(x, w) <= 2), None)
        if first:
            want[w] = first
        else:
            leaders.append(w)
    assert got == want


def test_similar_runs_by_bounds(spark):
    """All pairs give the same best run; the search meets fewer of them, even among runs as random as these."""
    rng = random.Random(3)
    log = [(i, f"2026-01-{1 + i % 28:02d}", rng.choice(["cuda", "none", None]), rng.choice([None, 4096, 8192]), rng.choice("ab"), "en", "x", True, rng.choice([5.0, 60.0, 200.0, 400.0]) * rng.random(),
            rng.choice([None, 0.0, 3600.0]), rng.choice([None, rng.random()]), rng.choice([None, rng.randint(0, 60)]), f"p{i}", "d", "strict", rng.choice(["h1", "h2", None])) for i in range(600)]
    log += [(10_000 + i, *log[0][1:]) for i in range(300)]
    log = spark.createDataFrame(log, "run_id long, ts string, gpu_backend string, gpu_vram_mb long, source_lang string, target_lang string, input_kind string, success boolean, elapsed_secs double, audio_duration_secs double, avg_difficulty double, scene_count int, plan string, device_fingerprint string, quality_profile string, content_profile_hash string")
    log = log.withColumns({"output_cues": F.lit(None).cast("int"), "output_non_empty_ratio": F.lit(None).cast("double"), "output_top_line_ratio": F.lit(None).cast("double")})
    asks = [(i, rng.choice("aB"), "EN", "x", "strict", rng.choice(["h1", "h3"]), rng.choice(["cuda", "NONE", None]), rng.choice([None, 2048, 6000]), rng.choice([None, rng.random()]), rng.choice([None, rng.randint(0, 60)])) for i in range(200)]
    queries = spark.createDataFrame(asks, "query_id long, source_lang string, target_lang string, input_kind string, quality_profile string, content_profile_hash string, backend string, vram_mb long, avg_difficulty double, scene_count int")
    best, pairs, seen = {}, 0, log.collect()
    for i, lang, _, _, _, h, backend, vram, hard, many in asks:
        backend = backend.lower() if backend else None
        for r in seen:
            b = r.gpu_backend
            if r.source_lang != lang.lower() or not (b == backend if backend else (b or "none") == "none"):
                continue
            if vram is not None and r.gpu_vram_mb is not None and r.gpu_vram_mb > vram * 6 // 5:
                continue
            pairs += 1
            score = r.elapsed_secs / (r.audio_duration_secs / 3600) if (r.audio_duration_secs or 0) > 0 else r.elapsed_secs
            score += 45.0 if (r.content_profile_hash or "none") != h else 0.0
            score += abs(r.avg_difficulty - hard) * 320 if r.avg_difficulty is not None and hard is not None else 25.0
            score += abs(r.scene_count - many) / max(r.scene_count, many, 1) * 180 if r.scene_count is not None and many is not None else 20.0
            if vram is not None and r.gpu_vram_mb is not None:
                spare = vram - r.gpu_vram_mb
                score += -spare / 256.0 * 8 if spare < 0 else -min(20.0, spare / 1024.0)
            best[i] = min(best.get(i, (score, r.ts, r.run_id)), (score, r.ts, r.run_id))
    got = {r.query_id: (round(r.score, 9), r.run_id) for r in runs.best_run_similar(queries, log).collect()}
    assert got == {i: (round(s, 9), run) for i, (s, _, run) in best.items()}
    assert runs.similar_pairs(queries, log).count() < pairs / 2
