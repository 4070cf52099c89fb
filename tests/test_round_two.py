"""Batches written one after the other, gates on unreadable times, recordings without a hypothesis, long logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestrata.operators import content, evaluate, quality, runs, selection
from cuestrata.sources import asr, report, srt

CUES = "recording_id bigint, pos int, start_ms bigint, end_ms bigint, text string"


def cues(spark, *recordings, n=6, null_at=None):
    rows = [(r, i, None if i == null_at else i * 2000, i * 2000 + 900, f"line {r} {i}") for r in recordings for i in range(n)]
    return spark.createDataFrame(rows, CUES)


def test_later_batches_keep_earlier_recordings(spark, tmp_path):
    for r in (1, 2):
        srt.write_srt(cues(spark, r), str(tmp_path / "srt"))
        report.write_report(cues(spark, r), str(tmp_path / "report"))
        segments = cues(spark, r).selectExpr("recording_id", "start_ms", "end_ms", "-0.5D AS avg_logprob", "0.1D AS no_speech_prob", "1.2D AS compression_ratio")
        asr.write_segments(segments, str(tmp_path / "asr"))
    for name in ("srt", "report", "asr"):
        read = spark.read.text(str(tmp_path / name))
        assert {r.recording_id for r in read.select("recording_id").distinct().collect()} == {1, 2}
    lines = [r.value for r in spark.read.text(str(tmp_path / "asr" / "recording_id=1")).collect()]
    assert len(lines) == 6 and '"start":2.0' in lines[1]


def test_unreadable_and_missing_verdicts_do_not_pass(spark):
    rows = cues(spark, 1, n=300).unionByName(cues(spark, 2, n=300, null_at=7)).unionByName(cues(spark, 3, n=3))
    gate = quality.structural_gate(quality.structural_health(rows), "strict").where("recording_id <> 3")
    for profile, bad in (("strict", "rejected"), ("fast", "warned")):
        status = {r.recording_id: r.status for r in selection.enforce_gate(rows.select("recording_id").distinct(), gate, profile).collect()}
        assert status == {1: "passed", 2: bad, 3: bad}


def test_evaluation_keeps_recordings_of_either_side(spark):
    out = {r.recording_id: r for r in evaluate.evaluation_gate(evaluate.evaluate(cues(spark, 1, 2), cues(spark, 1, 3))).collect()}
    assert set(out) == {1, 2, 3} and out[1].passed and not out[2].passed
    assert out[2].hyp_cues == 0 and out[2].ref_cues == 6 and out[2].time_coverage_ratio == 0 and out[2].non_empty_rate == 0


def test_lookups_search_the_whole_log(spark):
    common = dict(plan="p", audio_duration_secs=3600.0, avg_difficulty=0.5, scene_count=10, gpu_backend="cuda", gpu_vram_mb=8000, device_fingerprint="d",
                  source_lang="JA", target_lang="en", input_kind="srt", quality_profile="fast", content_profile_hash="h", success=True,
                  output_non_empty_ratio=1.0, output_cues=10, output_top_line_ratio=0.1)
    rows = [dict(common, run_id=i, ts=i, elapsed_secs=10.0 if i == 3 else 100.0 + i % 5) for i in range(900)]
    log = spark.createDataFrame(rows)
    asked = spark.createDataFrame([dict(query_id=q, device_fingerprint=d, source_lang="ja", target_lang="EN", input_kind="srt", quality_profile="fast",
                                        content_profile_hash="h", backend="cuda", vram_mb=8000, avg_difficulty=0.5, scene_count=10) for q, d in ((1, "d"), (2, "other"))])
    got = {r.query_id: (r.run_id, r.matched) for r in runs.best_run(asked, log).collect()}
    assert got == {1: (3, "exact"), 2: (3, "similar")}


def test_content_hash_sees_every_scene(spark):
    scenes = spark.range(100).selectExpr("1L AS recording_id", "id * 1000D AS scene_start_ms", "1000D AS duration_ms", "0.5D AS speech_density", "0.3D AS difficulty")
    other = scenes.withColumn("difficulty", F.when(F.col("scene_start_ms") == 90000, 0.9).otherwise(F.col("difficulty")))
    whole = spark.sql("SELECT 1L AS recording_id, 100D AS total_secs, 50D AS speech_secs, 0.3D AS avg_difficulty, 0D AS speaker_complexity, 0D AS energy_variance, 0D AS overlap_risk, 100L AS scene_count")
    one, again, two = (content.content_hash(whole, s).first().content_hash for s in (scenes, scenes.repartition(7), other))
    assert one == again != two


def test_files_with_either_line_end_and_rejects(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,000\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n\n\n00:00:05,000 --> 00:00:06,000\nNo index\n"
    for name, text in {"lf": body, "crlf": body.replace("\n", "\r\n"), "empty": "", "blank": "\r\n \r\n", "lone": "1\r\n\r\n2\r\n"}.items():
        (tmp_path / f"{name}.srt").write_bytes(text.encode())
    rows = {}
    for r in srt.read_srt(spark, str(tmp_path)).collect():
        rows.setdefault(r.recording_id.rsplit("/", 1)[1], []).append((r.pos, r.idx, r.timing, r.text))
    assert set(rows) == {"lf.srt", "crlf.srt"} and sorted(rows["lf.srt"]) == sorted(rows["crlf.srt"])
    assert [(p, i, t) for p, i, _, t in sorted(rows["crlf.srt"])] == [(0, 1, "Hello\nthere"), (1, 2, "Bye"), (2, 3, "No index")]
    bad = {r.recording_id.rsplit("/", 1)[1]: r.reason for r in srt.read_srt_rejects(spark, str(tmp_path)).collect()}
    assert bad == {"blank.srt": "no cues", "lone.srt": "missing timing line"}


def test_whole_path_from_cues_to_status(spark):
    from cuestrata.operators.process import process

    rows = cues(spark, 1, n=12).unionByName(cues(spark, 2, n=300, null_at=3))
    out, told = process(rows, lambda texts, before, after, tags: [t.upper() for t in texts], "strict")
    got = {(r.recording_id, r.status) for r in out.select("recording_id", "status").distinct().collect()}
    assert (2, "rejected") in got and {r for r, _ in got} == {1, 2} and out.count() == 312
    assert [r.recording_id for r in told.select("recording_id").collect()] == [1]
    assert all("LINE 1" in r.text.upper() for r in out.where("recording_id = 1").collect())


def test_chunks_by_each_recordings_own_target(spark):
    from cuestrata.operators.process import plan_recordings

    rec = spark.createDataFrame([(1, 1_000_000, 0.9), (2, 8_000_000, 0.5), (3, 100_000, None)], "recording_id bigint, duration_ms bigint, avg_difficulty double")
    gaps = spark.range(1, 800).selectExpr("1 + id % 2 AS recording_id", "id * 10000D AS centroid_ms").where("recording_id = 2 OR centroid_ms < 1000000")
    chunks = plan_recordings(gaps, rec).collect()
    sizes = {r: [c.end_ms - c.start_ms for c in chunks if c.recording_id == r] for r in (1, 2, 3)}
    assert len(sizes[3]) == 1 and len(sizes[1]) in range(6, 9) and len(sizes[2]) in range(20, 25)
    assert max(c.end_ms for c in chunks if c.recording_id == 2) == 8_000_000
