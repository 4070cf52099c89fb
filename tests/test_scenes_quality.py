from pyspark.sql import functions as F

from cuestrata.operators import confidence, consistency, content, context, names, quality, scenes
from cuestrata.operators import ordered
from cuestrata.operators.ordered import ROWS_PER_BLOCK


def test_gap_rule(make):
    got = scenes.scene_split(make([(0, 1000, "a"), (1050, 2000, "b"), (4000, 5000, "c")])).orderBy("pos").collect()
    assert [r.scene_id for r in got] == [1, 1, 2]


def test_jump_rule_and_overlap_rule(make):
    jump = scenes.scene_split(make([(0, 1000, "a"), (1000, 500_000, "b")])).orderBy("pos").collect()
    assert [r.scene_id for r in jump] == [1, 2]
    over = scenes.scene_split(make([(0, 1000, "a"), (900, 2000, "b"), (1950, 3000, "c")]), "overlap").orderBy("pos").collect()
    assert [r.scene_id for r in over] == [1, 2, 2]


def test_unreadable_times_belong_to_a_scene_only_inside_it(make):
    rows = [(None, None, "x"), (0, 1000, "a"), (None, None, "y"), (1200, 2000, "b"), (None, None, "z"), (9000, 9500, "c"), (None, None, "w")]
    got = scenes.scene_split(make(rows), bad_timing=True).orderBy("pos").collect()
    assert [r.scene_id for r in got] == [None, 1, 1, 1, None, 2, None]


def test_repeated_lines_are_pathological(make):
    rows = [(i * 2000, i * 2000 + 1000, "Same line") for i in range(240)]
    gate = quality.structural_gate(quality.structural_health(make(rows)), "balanced").first()
    assert gate.pathological and gate.top_line_ratio > 0.7 and gate.overlap_ratio == 0


def test_bad_timing_voids_the_ratios(make):
    h = quality.structural_health(make([(0, 1, "a"), (None, None, "b")])).first()
    assert not h.timing_ok and h.top_line_ratio is None and h.cue_count == 2


def test_semantics(make):
    bad = make([(0, 1000, "I'm's going to go"), (1000, 2000, "I'm let you go now"), (2000, 3000, "Wait wait wait wait.")])
    assert quality.semantic_gate(quality.semantic_health(bad), "strict").first().pathological
    other = quality.semantic_health(bad, "fr").first()
    assert (other.anomaly_ratio, other.scene_low_ratio, other.cue_count) == (0.0, 0.0, 3)


def test_names(make):
    rows = [(0, 1, "Sakura came"), (1, 2, "Sakra left"), (2, 3, "Sakura saw"), (3, 4, "Sakra sat")]
    assert names.name_inconsistency(make(rows)).first().name_inconsistency == 0.5
    few = names.name_inconsistency(make(rows[:2])).first()
    assert few.name_inconsistency == 0.0


def test_near_pairs_equal_all_pairs(spark):
    import random

    random.seed(2)
    words = sorted({"S" + "".join(random.choice("ab") for _ in range(random.randint(0, 7))) for _ in range(150)})
    df = spark.createDataFrame([(1, w, 1) for w in words], "recording_id bigint, word string, freq int")

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if a < b and dist(a, b) <= 2}
    near = names.near_pairs(df, ["recording_id"], "word", lambda n: F.when(n > 0, 2)).select("a", "b")
    short = names._short_pairs(df, ["recording_id"]).select("a", "b")
    assert {tuple(r) for r in near.union(short).collect()} == want


def test_canonical_names(make):
    rows = [(0, 1, "Sakura! (Sakra's) Sakura"), (1, 2, "x Sakra, y  Sakrb Sakura")]
    got = [r.text for r in names.canonical_names(make(rows)).orderBy("pos").collect()]
    assert got == ["Sakura! (Sakura's) Sakura", "x Sakura, y  Sakura Sakura"]


def test_clean_source_beats_noisy(make):
    noisy = scenes.source_scene_quality(make([(0, 120, "hey"), (130, 250, "hey")])).first()
    clean = scenes.source_scene_quality(make([(0, 1500, "hello there"), (1600, 3000, "come in")])).first()
    assert clean.score > noisy.score


def test_translation_quality_facts(make):
    loop = make([(i, i + 1, "What's the matter?") for i in range(160)])
    words = [f"{a}{b}" for a in ("ka", "ro", "mi", "tel", "sun", "dor") for b in ("ben", "lis", "mor", "tan", "vex", "wil", "zed", "fir")]
    varied = make([(i, i + 1, " ".join(words[(i * 7 + k * 5) % 48] for k in range(5))) for i in range(120)])
    stock = make([(i, i + 1, "Oh my God!" if i % 10 else f"line {words[i % 48]}") for i in range(180)])
    score = lambda d: quality.translation_quality(d).first().quality
    assert score(loop) < 0.35 and score(varied) > 0.80 and score(stock) < 0.45


def conf(spark, scores):
    cols = "recording_id bigint, pos int, score double, avg_logprob double, no_speech_prob double, compression_ratio double, word_prob_mean double, low_word_prob_ratio double, suspicious boolean"
    return spark.createDataFrame([(1, i, s, -0.2, 0.0, 1.0, 0.9, 0.0, False) for i, s in enumerate(scores)], cols)


def test_low_spans_bridge_one(spark):
    spans = lambda s: [(r.span_start, r.span_end) for r in confidence.low_confidence_spans(conf(spark, s), "strict").orderBy("span_start").collect()]
    assert spans([.9, .1, .1, .9]) == [(1, 3)]
    assert spans([.1, .9, .1, .9, .9, .1]) == [(0, 3), (5, 6)]
    assert spans([.9, None, .9]) == []


def test_segment_confidence_prefers_likely_text(spark):
    cols = "avg_logprob double, no_speech_prob double, compression_ratio double, word_prob_mean double, low_word_prob_ratio double"
    df = spark.createDataFrame([(-0.2, 0.0, 1.0, 0.0, 0.0), (-1.5, 0.0, 1.0, 0.0, 0.0)], cols)
    a, b = confidence.segment_confidence(df).collect()
    assert a.score > b.score


def test_scene_types(spark):
    df = spark.createDataFrame([(30_000.0, .95), (120_000.0, .1)], "duration_ms double, speech_density double")
    assert [r.scene_type for r in content.classify_scenes(df).collect()] == ["rapid-dialogue", "ambient"]


def test_consistency(spark):
    rows = [(1, i, "どこ", t) for i, t in enumerate(["Where is Sakura?"] * 3 + ["Where is Sakra?"])]
    df = spark.createDataFrame(rows, "recording_id bigint, pos int, src string, tgt string")
    got = consistency.phrase_consistency(df).orderBy("pos").collect()
    assert got[3].new_tgt == "Where is Sakura?" and [r.rewritten for r in got] == [False] * 3 + [True]


def test_context(make):
    w = context.context_windows(make([(i, i + 1, t) for i, t in enumerate(["AAA", "BBB", "CCC", "DDD"])]), 1).orderBy("pos").collect()
    assert (w[1].prev_lines, w[1].next_lines) == (["AAA"], ["CCC"]) and w[0].prev_lines == []


def test_context_crosses_blocks(spark):
    n = 40
    df = spark.range(n).select(F.lit(1).alias("recording_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("text"))
    got = context.context_windows(df, 3, rows=8).collect()
    assert len(got) == n
    for r in got:
        assert r.prev_lines == [str(i) for i in range(max(0, r.pos - 3), r.pos)]
        assert r.next_lines == [str(i) for i in range(r.pos + 1, min(n, r.pos + 4))]


def test_batches_keep_rows_and_group_hard_ones(spark):
    rows = [(i, f"t{i}", [], [], ["scene_hard"] if i < 9 else []) for i in range(20)]
    df = spark.createDataFrame(rows, "pos int, text string, prev_lines array<string>, next_lines array<string>, context_tags array<string>").coalesce(1)
    got = context.map_text_batches(df, lambda t, p, n, g: ["" if x == "t3" else f"{x}/{len(t)}" for x in t]).orderBy("pos").collect()
    assert [r.text for r in got][:4] == ["t0/9", "t1/9", "t2/9", "t3"] and got[15].text == "t15/11"


def test_one_recording_over_many_blocks(spark, monkeypatch):
    """A recording longer than several blocks scores like a plain window."""
    monkeypatch.setattr(ordered, "WHOLE_ROWS", ROWS_PER_BLOCK)
    n = ROWS_PER_BLOCK * 3 + 17
    df = spark.range(n).selectExpr("1L AS recording_id", "CAST(id AS INT) AS pos", "id * 900 + (id % 13) * 400 AS start_ms", "id * 900 + (id % 13) * 400 + 800 AS end_ms", "'x' AS text")
    got = scenes.scene_split(df).select("pos", "scene_id")
    want = df.selectExpr("pos", "start_ms", "end_ms", "max(end_ms) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe").selectExpr(
        "pos", "sum(CASE WHEN pe IS NULL OR start_ms - pe >= 1500 OR end_ms - pe >= 420000 THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS scene_id")
    assert got.exceptAll(want).count() == 0 and got.count() == n
