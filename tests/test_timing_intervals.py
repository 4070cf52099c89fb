import random

from pyspark.sql import functions as F

from cuestrata.operators import folds, intervals, joins, timing
from cuestrata.operators.ordered import number_rows, scan


def iv(spark, rows):
    return spark.createDataFrame([(1, s, e) for s, e in rows], "recording_id bigint, start_ms bigint, end_ms bigint")


def rec(spark, *durations):
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(durations)], "recording_id bigint, duration_ms bigint")


def test_parse_modes(spark):
    rows = ["01:23:45,678 --> 01:23:46,000", "1:2:3,4-->1:2:3,9", "00:00:02,000 --> 00:00:01,000", "00:00:01.5 --> x", "no arrow", "0:0:1:9,0 --> 0:0:2,0"]
    df = spark.createDataFrame([(t,) for t in rows], "timing string")
    got = [(r.start_ms, r.end_ms) for r in timing.parse_timing(df).collect()]
    assert got == [(5025678, 5026000), (3723004, 3723009), (None, None), (None, None), (None, None), (1000, 2000)]
    swap = timing.parse_timing(df, "swap").collect()
    assert (swap[2].start_ms, swap[2].end_ms) == (1000, 2000) and swap[5].start_ms is None
    dec = timing.parse_timing(df, "decimal").collect()
    assert (dec[2].start_ms, dec[2].end_ms) == (2000, 1000)


def test_format_and_shift(spark):
    df = iv(spark, [(1250, 2500), (-5, 400_000_000)])
    got = [r.timing for r in timing.format_timing(df).collect()]
    assert got == ["00:00:01,250 --> 00:00:02,500", "00:00:00,000 --> 111:06:40,000"]
    assert timing.format_timing(timing.shift_cues(df, 10_000)).first().timing == "00:00:11,250 --> 00:00:12,500"


def test_scan_matches_a_loop_across_blocks(spark):
    random.seed(3)
    data = [(k, p, random.choice([None, random.randint(0, 99)])) for k in range(3) for p in random.sample(range(500), 120)]
    df = spark.createDataFrame(data, "k int, p int, v int")
    specs = {
        "mx": ("max_before", F.col("v")), "sm": ("sum_before", F.col("v")), "la": ("last_before", F.col("v")), "nx": ("next_after", F.col("v"))}
    got = {(r.k, r.p): (r.mx, r.sm, r.la, r.nx) for r in scan(df, ["k"], ["p"], specs, F.floor(F.col("p") / 16)).collect()}
    for k in range(3):
        rows = sorted((p, v) for kk, p, v in data if kk == k)
        for i, (p, _) in enumerate(rows):
            past = [v for _, v in rows[:i] if v is not None]
            ahead = [v for _, v in rows[i + 1:] if v is not None]
            assert got[(k, p)] == (max(past, default=None), sum(past), past[-1] if past else None, ahead[0] if ahead else None)


def test_numbering_is_dense(spark):
    df = spark.range(0, 1000, 7).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    out = number_rows(df, ["k"], ["p"], "n", F.floor(F.col("p") / 50)).orderBy("p").collect()
    assert [r.n for r in out] == list(range(len(out)))


def test_merge_and_complement_against_loops(spark):
    random.seed(5)
    rows = [(s, s + random.randint(1, 40_000)) for s in (random.randint(0, 3_000_000) for _ in range(200))]
    rows += rows[:20]
    want = []
    for s, e in sorted(rows):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    got = sorted((r.start_ms, r.end_ms) for r in intervals.merge_intervals(iv(spark, rows)).collect())
    assert got == [tuple(w) for w in want]
    gaps, cursor = [], 0
    for s, e in want + [[3_500_000, 3_500_000]]:
        if s > cursor and s - cursor >= 400:
            gaps.append((cursor, s))
        cursor = max(cursor, e)
    out = intervals.complement(iv(spark, rows), rec(spark, 3_500_000), min_ms=400)
    assert sorted((r.start_ms, r.end_ms) for r in out.collect()) == gaps


def test_gap_facts(spark):
    gaps = intervals.complement(iv(spark, [(0, 100_000), (102_000, 200_000)]), rec(spark, 200_000), min_ms=1000).collect()
    assert [(g.start_ms, g.end_ms) for g in gaps] == [(100_000, 102_000)]


def pick_loop(centroids, duration, step):
    if not centroids:
        n = -(-duration // step)
        return [float(i * step) for i in range(1, n)]
    out, cursor = [], step
    while cursor < duration - step * 0.3:
        low = (out[-1] if out else 0.0) + step * 0.3
        ok = [c for c in sorted(centroids) if low <= c < duration - step * 0.2]
        if not ok:
            break
        out.append(min(ok, key=lambda c: abs(c - cursor)))
        cursor = out[-1] + step
    return out


def test_boundaries_against_a_loop(spark):
    random.seed(11)
    gaps, recs, want = [], [], {}
    for r in range(1, 9):
        duration = random.randint(500, 90_000)
        cs = sorted(random.sample(range(1, duration), min(duration - 1, random.choice([0, 3, 40, 300]))))
        recs.append((r, duration))
        gaps += [(r, float(c)) for c in cs]
        want[r] = pick_loop([float(c) for c in cs], duration, 1000)
    g = spark.createDataFrame(gaps, "recording_id bigint, centroid_ms double")
    out = folds.pick_boundaries(g, spark.createDataFrame(recs, "recording_id bigint, duration_ms bigint"), 1000, stretch=4)
    got = {r: [] for r in want}
    for row in out.orderBy("recording_id", "boundary_ms").collect():
        got[row.recording_id].append(row.boundary_ms)
    assert got == want


def test_chunk_plan(spark):
    r = rec(spark, 240_000, 900_000)
    cuts = spark.createDataFrame([(1, 100_000.0), (2, 292_500.0), (2, 585_000.0)], "recording_id bigint, boundary_ms double")
    got = [(c.recording_id, c.chunk_index, c.start_ms, c.end_ms) for c in intervals.plan_chunks(cuts, r).orderBy("recording_id", "chunk_index").collect()]
    assert got == [(1, 0, 0.0, 240_000.0), (2, 0, 0.0, 294_500.0), (2, 1, 290_500.0, 587_000.0), (2, 2, 583_000.0, 900_000.0)]


def test_chunk_targets(spark):
    rows = [(900.0, None), (2500.0, None), (4000.0, None), (9000.0, None), (None, None), (4000.0, .8), (4000.0, .2)]
    df = spark.createDataFrame(rows, "duration_secs double, avg_difficulty double")
    assert [round(r.chunk_target_secs, 6) for r in intervals.chunk_target_secs(df).collect()] == [180, 240, 300, 360, 300, 225, 345]


def test_alignment_against_a_loop(spark):
    random.seed(7)

    def cues(n):
        return sorted((s, s + random.randint(1, 3000)) for s in (random.randint(0, 200_000) for _ in range(n)))

    ref, hyp = cues(40), cues(120)
    mk = lambda rows: spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(rows)], "recording_id bigint, pos int, start_ms bigint, end_ms bigint")
    got = {r.pos: (r.ref_pos, r.overlap_ms) for r in joins.align_by_time(mk(ref), mk(hyp)).collect()}
    for i, (s, e) in enumerate(hyp):
        ovs = [max(0, min(e, re) - max(s, rs)) for rs, re in ref]
        best = max(ovs)
        want = ovs.index(best) if best else min(range(len(ref)), key=lambda k: (abs(sum(ref[k]) - s - e), k))
        assert got[i] == (want, best)
