import random

from pyspark.sql import functions as F

from cuestrata.operators import folds, monitor, runs, selection


def test_edit_distance():
    assert [folds.edit_distance(a, b) for a, b in [("kitten", "sitting"), ("", "abc"), ("été", "eté"), ("x", "x")]] == [3, 3, 1, 0]


def chunks(spark, offsets):
    return spark.createDataFrame([(1, i, o) for i, o in enumerate(offsets)], "recording_id bigint, chunk_index int, offset_ms bigint")


def ccues(spark, rows):
    return spark.createDataFrame([(1, c, p, s, s + 500, t) for p, (c, s, t) in enumerate(rows)],
                                 "recording_id bigint, chunk_index int, pos int, start_ms bigint, end_ms bigint, text string")


def test_stitch_facts(spark):
    got = folds.stitch_chunks(ccues(spark, [(0, 298_000, "hello there"), (1, 298_500, "hello there"), (1, 305_000, "bye")]), chunks(spark, [0, 0]))
    assert [(r.chunk_index, r.start_ms) for r in got.orderBy("start_ms").collect()] == [(0, 298_000), (1, 305_000)]
    moved = folds.stitch_chunks(ccues(spark, [(0, 0, "a"), (1, 5_000, "b")]), chunks(spark, [0, 300_000]))
    assert sorted(r.start_ms for r in moved.collect()) == [0, 305_000]
    single = folds.stitch_chunks(ccues(spark, [(0, 100, "a"), (0, 200, "a")]), chunks(spark, [7_000]))
    assert sorted(r.start_ms for r in single.collect()) == [100, 200]


def stitch_loop(rows):
    kept = []
    for start, chunk, pos, text in sorted(rows):
        if kept:
            ls, lc, lt = kept[-1][0], kept[-1][1], kept[-1][3]
            gap = start - ls
            if lc != chunk and gap < 3000 and 1 - folds.edit_distance(lt, text) / max(len(lt), len(text), 1) >= 0.6:
                continue
            if gap < 2000 and lt == text:
                continue
        kept.append((start, chunk, pos, text))
    return [k[2] for k in kept]


def test_stitch_against_a_loop(spark):
    random.seed(4)
    texts = ["yes", "yes.", "no", "come here", "come hero", "well then"]
    rows = [(random.randint(0, 60_000), random.randint(0, 2), i, random.choice(texts)) for i in range(400)]
    df = spark.createDataFrame([(1, c, p, s, s + 300, t) for s, c, p, t in rows],
                               "recording_id bigint, chunk_index int, pos int, start_ms bigint, end_ms bigint, text string")
    got = folds.stitch_chunks(df, chunks(spark, [0, 0, 0])).orderBy("start_ms", "chunk_index", "pos").collect()
    assert [r.pos for r in got] == stitch_loop(rows)


def test_compaction_facts(make):
    both = folds.compact_cues(make([(0, 1000, "I think"), (1050, 2000, "we should go.")])).collect()
    assert [(r.text, r.merges, r.end_ms) for r in both] == [("I think we should go.", 1, 2000)]
    twice = folds.compact_cues(make([(0, 1000, "Run!"), (1050, 2000, "Run!")])).collect()
    assert [(r.text, r.merges) for r in twice] == [("Run!", 0)]
    assert folds.compact_cues(make([(0, 1000, "I think"), (1600, 2600, "we should go.")])).count() == 2


def test_compaction_budget_spans_cuts(make):
    rows = []
    for i in range(40):  # forty pairs far apart, each able to merge; the budget is 20
        rows += [(i * 10_000, i * 10_000 + 1000, "I think"), (i * 10_000 + 1050, i * 10_000 + 2000, f"we should go {chr(97 + i % 26)}")]
    got = folds.compact_cues(make(rows)).orderBy("pos").collect()
    assert len(got) == 60 and [r.merges for r in got[:20]] == [1] * 20 and sum(r.merges for r in got) == 20


def test_empty_cue_survives_only_in_front(make):
    got = folds.compact_cues(make([(0, 100, ""), (2000, 2100, "One."), (2110, 2200, " "), (9000, 9100, "Two.")])).orderBy("pos").collect()
    assert [r.text for r in got] == ["", "One.", "Two."]


def compact_loop(rows):
    """The rule itself, row by row."""
    norm = [(s, e, " ".join(t.split())) for s, e, t in rows]
    budget, used, out, i = max(20, len(rows) // 16), 0, [], 0
    words = frozenset(__import__("cuestrata.rules", fromlist=["x"]).FUNCTION_WORDS)
    while i < len(norm):
        start, end, text = norm[i]
        j = i + 1
        while j < len(norm):
            s, e, t = norm[j]
            if t == "":
                j += 1
                continue
            gap = max(0, s - end)
            if gap > 80:
                break
            if text.lower() == t.lower() and gap <= 120 and len(text) <= 48:
                end, j = max(end, e), j + 1
                continue
            if not folds._joinable(text, t) or used >= budget:
                break
            merged = f"{text} {t}"
            took = max(1, e - start)
            if took > 6500 or len(merged) / (took / 1000) > 21 or len(merged) > 72 or folds._spoils(merged, words):
                break
            text, end, used, j = merged, max(end, e), used + 1, j + 1
        out.append((i, start, end, text))
        i = j
    return out


def test_compaction_against_a_loop(make):
    random.seed(9)
    pieces = ["", "I think", "we should go", "Stop", "stop", "wait.", "the red one", "of it", "no", "[music]", "and then he was there with us"]
    rows, t = [], 0
    for _ in range(500):
        t += random.choice([0, 20, 60, 200, -100])
        d = random.randint(200, 1500)
        rows.append((t, t + d, random.choice(pieces)))
        t += d
    got = folds.compact_cues(make(rows)).orderBy("pos").collect()
    assert [(r.pos, r.start_ms, r.end_ms, r.text) for r in got] == compact_loop(rows)


def test_splice_renumbers(spark, make):
    cues = make([(i * 10, i * 10 + 5, str(i)) for i in range(5)])
    spans = spark.createDataFrame([(1, 1, 3)], "recording_id bigint, span_start int, span_end int")
    new = spark.createDataFrame([(1, 1, k, 10 + k, 11 + k, f"n{k}") for k in range(3)],
                                "recording_id bigint, span_start int, ord int, start_ms bigint, end_ms bigint, text string")
    got = selection.splice(cues, spans, new).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == list(enumerate(["0", "n0", "n1", "n2", "3", "4"]))


def test_better_source_scene_is_taken(spark, make):
    cues = make([(0, 100, "hey"), (110, 200, "hey"), (210, 300, "hey"), (9_000, 10_500, "fine words"), (10_600, 12_000, "more words")])
    # two different lines are half repetition, so the second scene is low as well
    spans = selection.source_retry_spans(cues).orderBy("scene_id").collect()
    assert [(s.scene_id, s.span_start, s.span_end, s.redo_from_ms, s.redo_to_ms) for s in spans] == [(1, 0, 3, 0, 650), (2, 3, 5, 8750, 12350)]
    cols = "recording_id bigint, scene_id bigint, ord int, start_ms bigint, end_ms bigint, text string"
    retry = spark.createDataFrame([(1, 1, k, k * 600, k * 600 + 500, t) for k, t in enumerate(["hello you", "come in", "sit down", "thanks"])], cols)
    got = selection.accept_better_source(cues, retry).orderBy("pos").collect()
    assert [r.text for r in got] == ["hello you", "come in", "sit down", "thanks", "fine words", "more words"]
    worse = retry.withColumn("text", F.lit(""))
    assert selection.accept_better_source(cues, worse).count() == 5


def test_better_span_needs_confidence_and_structure(spark, make):
    cues = make([(0, 100, "uh"), (110, 200, "uh"), (5_000, 6_500, "fine words")])
    spans = spark.createDataFrame([(1, 0, 2, 0.1, 0.56)], "recording_id bigint, span_start int, span_end int, score double, floor double")
    cols = "recording_id bigint, span_start int, ord int, start_ms bigint, end_ms bigint, text string, score double, compression_ratio double, low_word_prob_ratio double"
    good = spark.createDataFrame([(1, 0, 0, 0, 900, "oh hello", .9, 1., 0.), (1, 0, 1, 950, 2_000, "come in", .9, 1., 0.), (1, 0, 2, 2_000, 3_000, "sit down", .9, 1., 0.)], cols)
    got = selection.accept_better_spans(cues, spans, good).orderBy("pos").collect()
    assert [r.text for r in got] == ["oh hello", "come in", "sit down", "fine words"]
    weak = good.withColumn("score", F.lit(0.12))
    assert selection.accept_better_spans(cues, spans, weak).count() == 3


def test_compaction_kept_only_if_not_worse(make):
    # with few cues the most frequent line gains too large a share, so take many
    rows = [(9000 + i * 3000, 11_000 + i * 3000, f"The {chr(97 + i)} is in {chr(98 + i)}.") for i in range(20)]
    got = selection.compact_if_not_worse(make([(0, 1000, "I think"), (1050, 2000, "we should go."), *rows])).orderBy("pos").collect()
    assert (got[0].text, got[0].compacted, len(got)) == ("I think we should go.", True, 21)
    few = selection.compact_if_not_worse(make([(0, 1000, "I think"), (1050, 2000, "we should go."), *rows[:2]]))
    assert few.where("compacted").count() == 0
    same = selection.compact_if_not_worse(make([(0, 1000, "One."), (5000, 6000, "Two.")])).collect()
    assert {r.compacted for r in same} == {False} and len(same) == 2


def test_gate_status(spark):
    df = spark.createDataFrame([(1,), (2,)], "recording_id bigint")
    gate = spark.createDataFrame([(1, True), (2, False)], "recording_id bigint, pathological boolean")
    assert {r.recording_id: r.status for r in selection.enforce_gate(df, gate).collect()} == {1: "rejected", 2: "passed"}
    kept, out = selection.split_by_status(selection.enforce_gate(df, gate))
    assert [r.recording_id for r in kept.collect()] == [2] and out.count() == 1


def run_rows(spark, rows):
    cols = ("run_id bigint, ts timestamp_ntz, gpu_backend string, gpu_vram_mb bigint, cpu_cores int, total_ram_mb bigint, source_lang string, target_lang string, input_kind string, "
            "success boolean, elapsed_secs double, audio_duration_secs double, avg_difficulty double, scene_count int, plan string, device_fingerprint string, quality_profile string, "
            "content_profile_hash string, output_cues int, output_non_empty_ratio double, output_top_line_ratio double")
    from datetime import datetime
    base = dict(ts=datetime(2024, 1, 1), gpu_backend="cuda", gpu_vram_mb=12_000, cpu_cores=8, total_ram_mb=32_000, source_lang="ja", target_lang="en", input_kind="srt",
                success=True, elapsed_secs=20.0, audio_duration_secs=600.0, avg_difficulty=0.5, scene_count=10, plan="p", device_fingerprint="d", quality_profile="strict",
                content_profile_hash="h", output_cues=10, output_non_empty_ratio=1.0, output_top_line_ratio=0.1)
    names = [c.split()[0] for c in cols.split(", ")]
    return spark.createDataFrame([tuple({**base, "run_id": i, **r}[n] for n in names) for i, r in enumerate(rows)], cols)


def ask(spark, **over):
    q = dict(query_id=1, source_lang="JA", target_lang="en", input_kind="srt", quality_profile="strict", content_profile_hash="h", device_fingerprint="d",
             backend="cuda", vram_mb=12_288, avg_difficulty=0.5, scene_count=10, **{})
    q.update(over)
    cols = ("query_id bigint, source_lang string, target_lang string, input_kind string, quality_profile string, content_profile_hash string, device_fingerprint string, "
            "backend string, vram_mb bigint, avg_difficulty double, scene_count int")
    return spark.createDataFrame([tuple(q[c.split()[0]] for c in cols.split(", "))], cols)


def test_run_lookups(spark):
    log = run_rows(spark, [{"plan": "slow", "elapsed_secs": 20.0}, {"plan": "fast", "elapsed_secs": 8.0}])
    assert runs.best_run_exact(ask(spark), log).first().plan == "fast"
    log = run_rows(spark, [{"plan": "gpu"}, {"plan": "cpu", "gpu_backend": "none", "gpu_vram_mb": None, "elapsed_secs": 1.0}])
    other = ask(spark, device_fingerprint="elsewhere")
    got = runs.best_run(other, log).first()
    assert (got.plan, got.matched) == ("gpu", "similar")
    assert runs.best_run_similar(ask(spark, backend=None, vram_mb=None), log).first().plan == "cpu"


def test_knowledge(spark):
    log = run_rows(spark, [{}, {"success": False}])
    got = {(r.kind, r.key): (r.runs, r.success_rate) for r in runs.knowledge_snapshot(log).collect()}
    assert got[("device", "cpu8-ram32768-gpucuda-vram12288")] == (2, 0.5) and got[("language_pair", "ja->en")] == (2, 0.5)
    print_only = run_rows(spark, [{"gpu_backend": None, "gpu_vram_mb": None, "cpu_cores": None, "total_ram_mb": None, "device_fingerprint": "cpu6-ram3000-gpuROCM-vram900"}])
    assert runs.run_keys(print_only).first().device_key == "cpu8-ram4096-gpurocm-vram1024"


def test_policy_against_a_loop(spark):
    random.seed(1)
    rows = []
    for i in range(300):
        rows.append((i % 3, i, i, random.random() > 0.2, random.choice([10.0, 150.0]), 50.0, random.random(), False, random.choice(["Timed out", "x"])))
    df = spark.createDataFrame(rows, "run_id bigint, event_id bigint, t bigint, success boolean, actual_secs double, predicted_secs double, quality_score double, from_cache boolean, reason string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 700))
    got = {r.run_id: r for r in monitor.adaptive_policy(df).collect()}
    for run in range(3):
        scale, extra, strict = 1.0, 0, False
        for r in [x for x in rows if x[0] == run]:
            ok, slow = r[3], r[3] and r[4] > 2 * r[5]
            low, late = (not ok) or r[6] < 0.65, (not ok) and "timed out" in r[8].lower()
            scale = min(3.0, max(1.0, scale * (1.2 if slow else 0.98)))
            extra = min(extra + 1, 2) if slow else extra
            strict, extra = low, (max(extra, 1) if low else extra)
            if late:
                scale, extra = min(4.0, max(1.0, scale * 1.35)), min(extra + 1, 3)
        assert abs(got[run].timeout_scale - scale) < 1e-9
        assert (got[run].extra_retry_budget, got[run].strict_first_pass) == (extra, strict)
