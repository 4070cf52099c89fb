"""Registered queries: each operator over whole driver tables, with its SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions import repair as R
from cuestrata.functions import text as T
from cuestrata.operators import (
    confidence, consistency, content, context, evaluate as ev, folds, intervals, joins, monitor, names, process, quality, runs, scenes, selection, timing)
from cuestrata.plans import oracle as o
from cuestrata.plans import views as v
from cuestrata.session import scratch
from cuestrata.sources import asr, files, report, silence, srt
from cuestrata.sources.run_log import RunLog
from cuestrata.sources.text_store import TextStore
from cuestrata.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def s6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


ID = ["recording_id", "pos"]


# ================================================================ scenes, health
@query("scene_quality", o.ctes("scored") + f" SELECT recording_id, scene_id, n, {s6('difficulty', 'score', 'floor')}, score >= floor AS passed FROM scored")
def _(spark, sf):
    out = scenes.scene_quality(v.cues(spark, sf))
    return out.select("recording_id", "scene_id", "n", *r6("difficulty", "score", "floor"), "passed")


@query("scene_low_ratio", o.ctes("scored") + " SELECT recording_id, count(*) AS scene_count, round(avg((score < floor)::INT), 6) AS scene_low_ratio FROM scored GROUP BY 1")
def _(spark, sf):
    out = scenes.scene_low_ratio(scenes.scene_quality(v.cues(spark, sf)))
    return out.select("recording_id", "scene_count", *r6("scene_low_ratio"))


@query("prev_end", o.ctes("ends") + " SELECT recording_id, pos, CAST(coalesce(pe, 0) AS BIGINT) AS prev_end FROM ends")
def _(spark, sf):
    return scenes.prev_end(v.cues(spark, sf)).select(*ID, "prev_end")


@query("scene_split_gap", o.ctes("scenes") + " SELECT recording_id, pos, scene_id FROM scenes")
def _(spark, sf):
    return scenes.scene_split(v.cues(spark, sf), "gap").select(*ID, "scene_id")


@query("scene_split_overlap", o.ctes("scenes_o") + " SELECT recording_id, pos, scene_id FROM scenes_o")
def _(spark, sf):
    return scenes.scene_split(v.cues(spark, sf), "overlap").select(*ID, "scene_id")


@query("adjacent_duplicate", o.ctes("cues") + f""" SELECT recording_id, pos, k <> '' AND k = coalesce(lag(k) OVER (PARTITION BY recording_id ORDER BY pos), '') AS adjacent_duplicate
FROM (SELECT *, lower({o.collapse('text')}) AS k FROM cues)""")
def _(spark, sf):
    return scenes.adjacent_duplicate(v.cues(spark, sf)).select(*ID, "adjacent_duplicate")


@query("structural_health", o.ctes("health") + f" SELECT recording_id, cue_count, {s6('top_line_ratio', 'overlap_ratio', 'non_empty_ratio')} FROM health")
def _(spark, sf):
    out = quality.structural_health(v.cues(spark, sf))
    return out.select("recording_id", "cue_count", *r6("top_line_ratio", "overlap_ratio", "non_empty_ratio"))


def _health_sql(base: str, keys: str) -> str:
    return f"""e AS (SELECT *, max(end_ms) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  lower({o.collapse('text')}) AS k FROM {base}),
h AS (SELECT *, coalesce(top, 0)::DOUBLE / cue_count AS top_line_ratio, CASE WHEN cue_count > 1 THEN overs::DOUBLE / (cue_count - 1) ELSE 0.0e0 END AS overlap_ratio,
  filled::DOUBLE / cue_count AS non_empty_ratio FROM (
  SELECT {keys}, count(*) AS cue_count, sum((start_ms < coalesce(pe, start_ms))::INT) AS overs, sum((k <> '')::INT) AS filled FROM e GROUP BY ALL)
  LEFT JOIN (SELECT {keys}, max(c) AS top FROM (SELECT {keys}, k, count(*) AS c FROM e WHERE k <> '' GROUP BY ALL) GROUP BY ALL) USING ({keys}))"""


@query("structural_gate", o.ctes("source_cues") + "," + _health_sql("source_cues", "recording_id") + """
SELECT recording_id, p AS profile, cue_count >= n AND (top_line_ratio >= t OR overlap_ratio >= v OR non_empty_ratio < f) AS pathological FROM h,
 (VALUES ('fast', 240, 0.35, 0.40, 0.65), ('balanced', 200, 0.30, 0.35, 0.70), ('strict', 80, 0.20, 0.25, 0.90)) x(p, n, t, v, f)""")
def _(spark, sf):
    """A source's documents as one long recording, under all three profiles."""
    health = quality.structural_health(v.source_cues(spark, sf))
    each = health.withColumn("p", F.explode(F.array(*[F.lit(p) for p in rules.PROFILES])))
    return quality.structural_gate(each, F.col("p")).select("recording_id", "profile", "pathological")


@query("chunk_gate", o.ctes("chunk_cues") + "," + _health_sql("chunk_cues", "recording_id, chunk_index") + """
SELECT recording_id, chunk_index, cue_count >= 30 AND (top_line_ratio >= 0.45 OR overlap_ratio >= 0.35 OR non_empty_ratio < 0.80) AS pathological FROM h""")
def _(spark, sf):
    keys = ["recording_id", "chunk_index"]
    out = quality.structural_gate(quality.structural_health(v.chunk_cues(spark, sf), keys), "strict", "chunk")
    return out.select(*keys, "pathological")


@query("chunk_health_score", o.ctes("source_cues") + "," + _health_sql("source_cues", "recording_id") + f"""
SELECT recording_id, round(CASE WHEN cue_count < 30 THEN 1.0e0 ELSE ({o.clamp('1 - top_line_ratio / 0.45')} + {o.clamp('1 - overlap_ratio / 0.35')} + {o.clamp('non_empty_ratio / 0.80')}) / 3 END, 6) AS quality_score FROM h""")
def _(spark, sf):
    out = quality.chunk_health_score(quality.structural_health(v.source_cues(spark, sf)), "strict")
    return out.select("recording_id", *r6("quality_score"))


@query("semantic_health", o.ctes("semantic") + f" SELECT recording_id, cue_count, scene_count, {s6(*quality.SEMANTIC)} FROM semantic")
def _(spark, sf):
    out = quality.semantic_health(v.cues(spark, sf))
    return out.select("recording_id", "cue_count", "scene_count", *r6(*quality.SEMANTIC))


@query("semantic_gate", o.ctes("semantic") + """ SELECT recording_id, anomaly_ratio >= 0.35 OR malformed_ratio >= 0.25 OR low_function_ratio >= 0.35
  OR adjacent_repeat_ratio >= 0.30 OR scene_low_ratio >= 0.45 OR name_inconsistency >= 0.20 AS pathological FROM semantic""")
def _(spark, sf):
    return quality.semantic_gate(quality.semantic_health(v.cues(spark, sf)), "fast").select("recording_id", "pathological")


@query("semantic_penalty", o.ctes("feats") + """ SELECT recording_id, round(avg((malformed OR low_function OR repeats)::INT) * 1.3e0 + avg(malformed::INT) * 1.5e0
  + avg(low_function::INT) + avg(repeats::INT) * 1.2e0, 6) AS penalty FROM feats GROUP BY 1""")
def _(spark, sf):
    m = quality.defect_ratios(T.text_features(v.cues(spark, sf)), ["recording_id"])
    return m.select("recording_id", F.round(quality.semantic_penalty(), 6).alias("penalty"))


@query("source_scene_quality", o.ctes("source_scored") + f" SELECT recording_id, scene_id, n, {s6('score', 'floor')} FROM source_scored")
def _(spark, sf):
    return scenes.source_scene_quality(v.cues(spark, sf)).select("recording_id", "scene_id", "n", *r6("score", "floor"))


@query("name_inconsistency", o.ctes("incons") + f" SELECT recording_id, mentions, {s6('name_inconsistency')} FROM incons")
def _(spark, sf):
    return names.name_inconsistency(v.cues(spark, sf)).select("recording_id", "mentions", *r6("name_inconsistency"))


def _excess(r, start, width, weight):
    return f"CASE WHEN {r} > {start}e0 THEN least(({r} - {start}e0) / {width}e0, 1.0e0) * {weight}e0 ELSE 0.0e0 END"


def _tq_sql(base: str, min_tokens: int, min_cues: int, keys: str = "recording_id") -> str:
    return f"""b AS (SELECT *, {o.ascii_tokens('text')} AS tok, {o.ascii_lower(o.collapse('text'))} AS k FROM {base}),
f AS (SELECT *, k <> '' AND k = coalesce(lag(k) OVER (PARTITION BY {keys} ORDER BY pos), '') AS dup FROM b),
base AS (SELECT {keys}, count(*) AS cues, avg({o.malformed('text')}::INT) * 1.5e0 + avg({o.repeats('tok')}::INT) * 1.1e0
  + avg((len(tok) >= 8 AND len(list_distinct(tok)) / len(tok) < 0.45)::INT)
  + avg(CASE WHEN NOT dup THEN 0.0e0 WHEN {o.interjection('k')} THEN 0.25e0 ELSE 1.0e0 END) * 1.2e0 AS base FROM f GROUP BY ALL),
tk AS (SELECT {keys}, t, count(*) AS c FROM (SELECT {keys}, unnest(tok) AS t FROM b) WHERE length(t) >= 2 GROUP BY ALL),
lex AS (SELECT {keys}, sum(c) AS tok, count(*) / sum(c) AS u, max(c) / sum(c) AS d,
  coalesce(sum(c) FILTER (t IN ('what''s', 'what', 'matter', 'mean')), 0) / sum(c) AS ql FROM tk GROUP BY ALL),
ln AS (SELECT {keys}, k, count(*) AS c FROM b GROUP BY ALL),
topl AS (SELECT {keys}, arg_min(k, (-c, k)) AS k, max(c) AS c FROM ln WHERE k <> '' GROUP BY ALL),
pen AS (SELECT {keys}, base, CASE WHEN coalesce(tok, 0) < {min_tokens} OR cues < {min_cues} THEN 0.0e0 ELSE {o.clamp(
    'CASE WHEN u < 0.030e0 THEN least((0.030e0 - u) / 0.030e0, 1.0e0) * 0.8e0 ELSE 0.0e0 END + ' + _excess('d', 0.12, 0.18, 0.7) + ' + ' + _excess('ql', 0.15, 0.25, 0.5), '0.0e0', '1.4e0')} END AS lexical_collapse,
  CASE WHEN cues < {min_cues} OR topl.c IS NULL THEN 0.0e0 ELSE {o.clamp(
    _excess('(topl.c / cues)', 0.04, 0.12, 1.0) + f" + CASE WHEN {o.interjection('topl.k')} THEN " + _excess('(topl.c / cues)', 0.025, 0.12, 0.5) + ' ELSE 0.0e0 END', '0.0e0', '1.6e0')} END AS line_repetition
  FROM base LEFT JOIN lex USING ({keys}) LEFT JOIN topl USING ({keys})),
tq AS (SELECT *, {o.clamp('1.0e0 - (base + lexical_collapse + line_repetition)', '0.0e0', '1.0e0')} AS quality FROM pen)"""


@query("translation_quality", o.ctes("cues") + "," + _tq_sql("cues", 20, 4) + f" SELECT recording_id, {s6('quality')} FROM tq")
def _(spark, sf):
    """Per document, with the minimum sizes lowered so that the penalties take part."""
    return quality.translation_quality(v.cues(spark, sf), min_tokens=20, min_cues=4).select("recording_id", *r6("quality"))


@query("translation_quality_source", o.ctes("source_cues") + "," + _tq_sql("source_cues", 200, 80) + f" SELECT recording_id, {s6('quality')} FROM tq")
def _(spark, sf):
    return quality.translation_quality(v.source_cues(spark, sf)).select("recording_id", *r6("quality"))


@query("lexical_collapse", o.ctes("source_cues") + "," + _tq_sql("source_cues", 200, 80) + f" SELECT recording_id, {s6('lexical_collapse')} FROM tq")
def _(spark, sf):
    return quality.lexical_collapse(v.source_cues(spark, sf)).select("recording_id", *r6("lexical_collapse"))


@query("line_repetition", o.ctes("cues") + "," + _tq_sql("cues", 20, 4) + f" SELECT recording_id, {s6('line_repetition')} FROM tq")
def _(spark, sf):
    return quality.line_repetition(v.cues(spark, sf), min_cues=4).select("recording_id", *r6("line_repetition"))


TAGS = """t AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, scene_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spe,
  (contains(text, '?') OR contains(text, '？')) AS ask, (contains(text, '!') OR contains(text, '！')) AS cry FROM scenes_o),
d AS (SELECT recording_id, scene_id, greatest(0.1e0, least(0.95e0, 0.32e0 + avg((greatest(1, end_ms - start_ms) < 1000)::INT) * 0.28e0
  + avg((spe IS NOT NULL AND greatest(0, start_ms - spe) < 120)::INT) * 0.22e0 + avg(cry::INT) * 0.12e0 + avg(ask::INT) * 0.10e0 + 0.0e0)) AS difficulty FROM t GROUP BY 1, 2)"""


@query("scene_tag_difficulty", o.ctes("scenes_o") + "," + TAGS + f" SELECT recording_id, scene_id, {s6('difficulty')} FROM d")
def _(spark, sf):
    out = scenes.tag_difficulty(v.cues(spark, sf), "balanced")
    return out.groupBy("recording_id", "scene_id").agg(F.round(F.first("difficulty"), 6).alias("difficulty"))


@query("context_tags", o.ctes("scenes_o") + "," + TAGS + """ SELECT recording_id, pos, concat_ws(' ', CASE WHEN difficulty >= 0.72 THEN 'scene_hard' WHEN difficulty >= 0.46 THEN 'scene_medium' ELSE 'scene_easy' END,
  CASE WHEN ask THEN 'cue_question' END, CASE WHEN cry THEN 'cue_exclaim' END,
  CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) / (greatest(1, end_ms - start_ms) / 1000.0e0) >= 9.5 THEN 'cue_fast' END) AS tags FROM t JOIN d USING (recording_id, scene_id)""")
def _(spark, sf):
    return context.context_tags(v.cues(spark, sf)).select(*ID, F.array_join("context_tags", " ").alias("tags"))


# ======================================================================== timing


@query("parse_timing", o.ctes("cues") + f""" SELECT recording_id, pos, CASE WHEN pos % 7 = 6 OR pos % 5 = 4 THEN NULL ELSE start_ms END AS start_ms,
 CASE WHEN pos % 7 = 6 OR pos % 5 = 4 THEN NULL ELSE end_ms END AS end_ms, NOT (pos % 7 = 6 OR pos % 5 = 4) AS timing_ok FROM cues""")
def _(spark, sf):
    """Printed times parsed back, some spoilt and some reversed."""
    df = timing.format_timing(v.cues(spark, sf)).drop("start_ms", "end_ms")
    arrow = F.split("timing", " --> ")
    bad = F.when(F.col("pos") % 7 == 6, F.replace("timing", F.lit(","), F.lit("."))).when(
        F.col("pos") % 5 == 4, F.concat(arrow[1], F.lit(" --> "), arrow[0])).otherwise(F.col("timing"))
    return timing.parse_timing(df.withColumn("timing", bad)).select(*ID, "start_ms", "end_ms", "timing_ok")


@query("parse_timing_swap", o.ctes("cues") + " SELECT recording_id, pos, start_ms, end_ms FROM cues")
def _(spark, sf):
    df = timing.format_timing(v.cues(spark, sf)).drop("start_ms", "end_ms")
    arrow = F.split("timing", " --> ")
    turned = F.when(F.col("pos") % 5 == 4, F.concat(arrow[1], F.lit("-->"), arrow[0])).otherwise(F.col("timing"))
    return timing.parse_timing(df.withColumn("timing", turned), "swap").select(*ID, "start_ms", "end_ms")


@query("parse_timing_decimal", o.ctes("cues") + " SELECT recording_id, pos, start_ms, end_ms FROM cues")
def _(spark, sf):
    df = timing.format_timing(v.cues(spark, sf)).drop("start_ms", "end_ms")
    return timing.parse_timing(df, "decimal").select(*ID, "start_ms", "end_ms")


@query("format_timing", o.ctes("cues") + f" SELECT recording_id, pos, {o.clock('start_ms')} || ' --> ' || {o.clock('end_ms')} AS timing FROM cues")
def _(spark, sf):
    return timing.format_timing(v.cues(spark, sf)).select(*ID, "timing")


@query("shift_cues", o.ctes("cues") + " SELECT recording_id, pos, start_ms + 10000 AS start_ms, end_ms + 10000 AS end_ms FROM cues")
def _(spark, sf):
    return timing.shift_cues(v.cues(spark, sf), 10_000).select(*ID, "start_ms", "end_ms")


@query("reindex", o.ctes("hyp_cues") + " SELECT recording_id, pos, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS INT) AS idx FROM hyp_cues")
def _(spark, sf):
    return timing.reindex(v.hyp_cues(spark, sf)).select(*ID, "idx")


@query("duration", o.ctes("cues") + " SELECT recording_id, max(end_ms) AS duration_ms FROM cues GROUP BY 1")
def _(spark, sf):
    return timing.duration(v.cues(spark, sf), strict=True)


@query("span", o.ctes("scenes") + " SELECT recording_id, scene_id, min(start_ms) AS span_start_ms, max(end_ms) AS span_end_ms FROM scenes GROUP BY 1, 2")
def _(spark, sf):
    return timing.span(scenes.scene_split(v.cues(spark, sf)), ["recording_id", "scene_id"])


# ===================================================================== intervals
@query("merge_intervals", o.ctes("merged") + " SELECT * FROM merged")
def _(spark, sf):
    return intervals.merge_intervals(v.event_intervals(spark, sf))


@query("complement", o.ctes("gaps") + " SELECT recording_id, start_ms, end_ms, (start_ms + end_ms) / 2.0e0 AS centroid_ms FROM gaps WHERE end_ms - start_ms >= 400")
def _(spark, sf):
    return intervals.complement(v.speech(spark, sf), v.recordings(spark, sf), min_ms=400)


_PAD = """p AS (SELECT s.recording_id, greatest(0, start_ms - 200) AS start_ms, least(duration_ms, end_ms + 200) AS end_ms FROM {base} s JOIN recordings USING (recording_id)),
m AS (SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS g FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS brk FROM p)) GROUP BY recording_id, g)"""


@query("pad_and_merge", o.ctes("speech", "recordings") + "," + _PAD.format(base="speech") + " SELECT recording_id, start_ms, end_ms FROM m")
def _(spark, sf):
    return intervals.pad_and_merge(v.speech(spark, sf), v.recordings(spark, sf), 200)


@query("speech_from_silence", o.ctes("gaps") + "," + _PAD.format(base="gaps") + " SELECT recording_id, start_ms, end_ms FROM m")
def _(spark, sf):
    return intervals.speech_from_silence(v.speech(spark, sf), v.recordings(spark, sf), 200)


@query("silence_islands", o.ctes("cues") + """, f AS (SELECT recording_id, pos, -20.0e0 - (recording_id * 31 + (pos // 5) * 17) % 40 < -35.0 AS quiet FROM cues)
SELECT recording_id, CAST(min(pos) AS BIGINT) * 100 AS start_ms, (CAST(max(pos) AS BIGINT) + 1) * 100 AS end_ms, count(*) AS frames FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM f WHERE quiet) GROUP BY recording_id, g HAVING count(*) * 100 >= 350""")
def _(spark, sf):
    return intervals.silence_islands(v.frames(spark, sf))


@query("overlap_ms", o.ctes("cues") + " SELECT recording_id, pos, greatest(0, least(end_ms, n_end) - greatest(start_ms, n_start)) AS ov FROM (SELECT *, lead(start_ms) OVER w AS n_start, lead(end_ms) OVER w AS n_end FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY pos)) WHERE n_start IS NOT NULL")
def _(spark, sf):
    """What each cue shares with the next one."""
    c = v.cues(spark, sf)
    nxt = c.selectExpr("recording_id", "pos - 1 AS pos", "start_ms AS n_start", "end_ms AS n_end")
    return c.join(nxt, ID).select(*ID, intervals.overlap_ms("start_ms", "end_ms", "n_start", "n_end").alias("ov"))


@query("silence_boundaries", o.ctes("gaps") + """ SELECT g.recording_id, (start_ms + end_ms) / 2.0e0 AS boundary_ms FROM gaps g JOIN recordings r USING (recording_id)
WHERE end_ms - start_ms >= 1500 AND (start_ms + end_ms) / 2.0e0 < duration_ms""")
def _(spark, sf):
    return intervals.silence_boundaries(v.speech(spark, sf), v.recordings(spark, sf))


_PICK = """c AS (SELECT g.recording_id, (start_ms + end_ms) / 2.0e0 AS c, r.duration_ms AS d FROM gaps g JOIN recordings r USING (recording_id) WHERE end_ms - start_ms >= 400),
p AS (SELECT DISTINCT recording_id, 0.0e0 AS b, d FROM c
 UNION ALL SELECT recording_id, b, d FROM (
  SELECT p.recording_id, p.d, (SELECT arg_min(c.c, (abs(c.c - p.b - 30000), c.c)) FROM c WHERE c.recording_id = p.recording_id AND c.c >= p.b + 9000 AND c.c < p.d - 6000) AS b
  FROM p WHERE p.b + 30000 < p.d - 9000) WHERE b IS NOT NULL)
SELECT recording_id, b AS boundary_ms FROM p WHERE b > 0
UNION ALL SELECT recording_id, CAST(unnest(range(30000, duration_ms, 30000)) AS DOUBLE) FROM recordings WHERE recording_id NOT IN (SELECT recording_id FROM c)"""


@query("pick_boundaries", o.ctes("gaps", "recordings") + "," + _PICK)
def _(spark, sf):
    gaps = intervals.complement(v.speech(spark, sf), v.recordings(spark, sf), min_ms=400)
    return folds.pick_boundaries(gaps, v.recordings(spark, sf), 30_000)


@query("plan_chunks", o.ctes("recordings") + """, b AS (SELECT recording_id, duration_ms, CAST(unnest(range(30000, duration_ms, 30000)) AS DOUBLE) AS t FROM recordings WHERE duration_ms > 39000),
r AS (SELECT recording_id, duration_ms, t, false AS fin FROM b UNION ALL SELECT recording_id, duration_ms, CAST(duration_ms AS DOUBLE), true FROM recordings)
SELECT recording_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_index,
  CASE WHEN lag(t) OVER w IS NULL THEN 0.0e0 ELSE greatest(0.0e0, lag(t) OVER w - 2000) END AS start_ms,
  CASE WHEN fin THEN duration_ms::DOUBLE ELSE least(duration_ms::DOUBLE, t + 2000) END AS end_ms,
  CASE WHEN lag(t) OVER w IS NULL THEN 0.0e0 ELSE lag(t) OVER w - greatest(0.0e0, lag(t) OVER w - 2000) END AS overlap_before_ms,
  CASE WHEN fin THEN 0.0e0 ELSE least(duration_ms::DOUBLE, t + 2000) - t END AS overlap_after_ms
FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY t, fin)""")
def _(spark, sf):
    """Even boundaries every 30 s."""
    rec = v.recordings(spark, sf)
    cuts = rec.where("duration_ms > 30000").select(
        "recording_id", F.explode(F.expr("sequence(30000L, duration_ms - 1, 30000L)")).alias("boundary_ms"))
    return intervals.plan_chunks(cuts, rec, 30_000)


@query("chunk_target_secs", o.ctes("run_log") + """ SELECT run_id, round(CASE WHEN h >= 0.7 THEN greatest(b * 0.75e0, 120) WHEN h <= 0.3 THEN least(b * 1.15e0, 420) ELSE b END, 6) AS chunk_target_secs
FROM (SELECT run_id, avg_difficulty AS h, CASE WHEN d >= 7200 THEN 360.0e0 WHEN d >= 3600 THEN 300.0e0 WHEN d >= 1800 THEN 240.0e0 WHEN d IS NOT NULL THEN 180.0e0 ELSE 300.0e0 END AS b
 FROM (SELECT *, audio_duration_secs * 3 AS d FROM run_log))""")
def _(spark, sf):
    df = v.run_log(spark, sf).withColumn("duration_secs", F.col("audio_duration_secs") * 3)
    return intervals.chunk_target_secs(df).select("run_id", *r6("chunk_target_secs"))


# ========================================================================= joins
@query("align_by_time", o.ctes("aligned") + f" SELECT recording_id, pos, ref_pos, overlap_ms, {s6('iou')} FROM aligned")
def _(spark, sf):
    return joins.align_by_time(v.ref_cues(spark, sf), v.hyp_cues(spark, sf)).select(*ID, "ref_pos", "overlap_ms", *r6("iou"))


@query("zip_by_position", o.ctes("cues") + """, b AS (SELECT * FROM cues WHERE pos % 11 <> 10)
SELECT recording_id, pos, a.text AS text_a, lower(b.text) AS text_b FROM cues a JOIN b USING (recording_id, pos)
WHERE recording_id IN (SELECT recording_id FROM cues GROUP BY 1 HAVING max(pos) < 10)""")
def _(spark, sf):
    """Documents that lost a line on one side drop out."""
    c = v.cues(spark, sf)
    return joins.zip_by_position(c, c.where("pos % 11 <> 10").withColumn("text", F.lower("text")))


@query("attach_by_index", o.ctes("cues") + """ SELECT recording_id, pos, CASE WHEN pos % 4 = 3 OR pos % 5 = 2 THEN text WHEN pos % 2 = 0 THEN 'late ' || text ELSE 'early ' || text END AS text FROM cues""")
def _(spark, sf):
    """Answers are missing, empty, single or repeated by rule."""
    c = timing.reindex(v.cues(spark, sf), dense=True)
    first = c.where("pos % 4 <> 3").select(
        "recording_id", "idx", F.when(F.col("pos") % 5 == 2, "").otherwise(F.concat(F.lit("early "), F.col("text"))).alias("text"), F.lit(1).alias("ord"))
    late = c.where("pos % 4 <> 3 AND pos % 2 = 0").select(
        "recording_id", "idx", F.when(F.col("pos") % 5 == 2, "").otherwise(F.concat(F.lit("late "), F.col("text"))).alias("text"), F.lit(2).alias("ord"))
    return joins.attach_by_index(c, first.unionByName(late)).select(*ID, "text")


@query("speech_ratio", o.ctes("cues", "speech_m") + """ SELECT c.recording_id, c.pos, round(coalesce(sum(CASE WHEN s.start_ms IS NOT NULL THEN least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms) END), 0)::DOUBLE
 / greatest(1, c.end_ms - c.start_ms), 6) AS speech_ratio FROM cues c LEFT JOIN speech_m s ON s.recording_id = c.recording_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms GROUP BY c.recording_id, c.pos, c.start_ms, c.end_ms""")
def _(spark, sf):
    return joins.speech_ratio(v.cues(spark, sf), v.speech(spark, sf)).select(*ID, *r6("speech_ratio"))


@query("verify_against_speech", o.ctes("cues", "speech_m") + """, c AS (SELECT *, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY pos) AS p FROM cues),
r AS (SELECT c.recording_id, c.pos, coalesce(sum(CASE WHEN s.start_ms IS NOT NULL THEN least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms) END), 0)::DOUBLE / greatest(1, c.end_ms - c.start_ms) AS m
 FROM cues c LEFT JOIN speech_m s ON s.recording_id = c.recording_id AND s.start_ms < c.end_ms AND s.end_ms > c.start_ms GROUP BY c.recording_id, c.pos, c.start_ms, c.end_ms)
SELECT recording_id, pos, 'non-monotonic' AS issue, p::DOUBLE AS measure FROM c WHERE start_ms < coalesce(p, 0)
UNION ALL SELECT recording_id, pos, 'low speech overlap', round(m, 6) FROM r WHERE m < 0.35""")
def _(spark, sf):
    return joins.verify_against_speech(v.cues(spark, sf), v.speech(spark, sf)).select(*ID, "issue", *r6("measure"))


# ==================================================================== confidence
@query("segment_confidence", o.ctes("seg_conf") + f" SELECT recording_id, pos, {s6('score')}, suspicious FROM seg_conf")
def _(spark, sf):
    return confidence.segment_confidence(v.asr_segments(spark, sf)).select(*ID, *r6("score"), "suspicious")


CONF = ["score", *confidence.SIGNALS]


@query("cue_confidence", o.ctes("cue_conf") + f" SELECT recording_id, pos, {s6(*CONF)}, suspicious FROM cue_conf")
def _(spark, sf):
    return confidence.cue_confidence(v.cues(spark, sf), v.asr_segments(spark, sf)).select(*ID, *r6(*CONF), "suspicious")


@query("mean_confidence", o.ctes("low_rows") + " SELECT recording_id, round(avg(CASE WHEN score IS NOT NULL THEN v END), 6) AS mean_confidence FROM low_rows GROUP BY 1")
def _(spark, sf):
    out = confidence.mean_confidence(confidence.cue_confidence(v.cues(spark, sf), v.asr_segments(spark, sf)))
    return out.select("recording_id", *r6("mean_confidence"))


@query("low_confidence_spans", o.ctes("low_spans") + f" SELECT recording_id, span_start, span_end, {s6('score', 'floor')} FROM low_spans")
def _(spark, sf):
    scored = confidence.cue_confidence(v.cues(spark, sf), v.asr_segments(spark, sf))
    return confidence.low_confidence_spans(scored).select("recording_id", "span_start", "span_end", *r6("score", "floor"))


# ======================================================================= content
@query("scene_speech_coverage", o.ctes("cscenes") + f" SELECT recording_id, scene_start_ms, scene_end_ms, {s6('speech_density')} FROM cscenes")
def _(spark, sf):
    return content.content_scenes(v.recordings(spark, sf), v.speech(spark, sf)).select(
        "recording_id", "scene_start_ms", "scene_end_ms", *r6("speech_density"))


@query("scene_classes", o.ctes("classed") + f" SELECT recording_id, scene_start_ms, {s6('difficulty')}, scene_type, speakers, energy, emotion FROM classed")
def _(spark, sf):
    return content.content_scenes(v.recordings(spark, sf), v.speech(spark, sf)).select(
        "recording_id", "scene_start_ms", *r6("difficulty"), "scene_type", "speakers", "energy", "emotion")


CMAP = ["total_secs", "speech_secs", "silence_secs", "avg_difficulty", "speaker_complexity", "energy_variance", "overlap_risk"]


_CMAP = o.ctes("classed", "speech", "recordings") + """, a AS (SELECT recording_id, count(*) AS scene_count, avg(difficulty) AS avg_difficulty,
  (avg(speakers) - 1) / 3 AS speaker_complexity, sum(chg::INT) AS chg, avg((speakers >= 3 AND speech_density >= 0.75)::INT) AS overlap_risk FROM (
  SELECT *, energy <> lag(energy) OVER (PARTITION BY recording_id ORDER BY scene_start_ms) AS chg FROM classed) GROUP BY 1),
s AS (SELECT r.recording_id, r.duration_ms, least(r.duration_ms, coalesce(sum(s.end_ms - s.start_ms), 0)) AS sp FROM recordings r LEFT JOIN speech s USING (recording_id) GROUP BY 1, 2),
cm AS (SELECT recording_id, scene_count, round(duration_ms / 1000.0e0, 6) AS total_secs, round(sp / 1000.0e0, 6) AS speech_secs, round((duration_ms - sp) / 1000.0e0, 6) AS silence_secs,
  round(avg_difficulty, 6) AS avg_difficulty, round(speaker_complexity, 6) AS speaker_complexity,
  round(CASE WHEN scene_count > 1 THEN coalesce(chg, 0)::DOUBLE / (scene_count - 1) ELSE 0.0e0 END, 6) AS energy_variance, round(overlap_risk, 6) AS overlap_risk,
  CAST(floor(greatest(1.0e0, round(sp / 1000.0e0 / 2.8e0) * (1.0e0 + (avg_difficulty - 0.35e0) * 0.35e0))) AS BIGINT) AS estimated_cues FROM a JOIN s USING (recording_id))"""


@query("content_map", _CMAP + " SELECT * FROM cm")
def _(spark, sf):
    out = content.content_map(v.recordings(spark, sf), v.speech(spark, sf))
    return out.select("recording_id", "scene_count", *r6(*CMAP), "estimated_cues")


@query("content_map_from_cues", o.ctes("cues") + """ SELECT recording_id, round(max(end_ms) / 1000.0e0, 6) AS total_secs, count(*) AS estimated_cues,
  CASE WHEN max(end_ms) / 1000.0e0 / count(*) >= 4 THEN 0.20e0 WHEN max(end_ms) / 1000.0e0 / count(*) >= 2.5 THEN 0.35e0 ELSE 0.55e0 END AS avg_difficulty FROM cues GROUP BY 1""")
def _(spark, sf):
    return content.content_map_from_cues(v.cues(spark, sf)).select("recording_id", *r6("total_secs"), "estimated_cues", "avg_difficulty")


def _scaled(c: str, by: str) -> str:
    return f"CAST(round(round({c}::DOUBLE, 6) * {by}) AS BIGINT)"


@query("content_hash", _CMAP + f""", sh AS (SELECT recording_id, sum(('0x' || substr(md5(concat_ws(':', {_scaled('scene_start_ms', '10')}, {_scaled('duration_ms', '0.01e0')}, {_scaled('speech_density', '100')}, {_scaled('difficulty', '100')})), 1, 15))::BIGINT) AS s
 FROM classed GROUP BY 1) SELECT recording_id, md5(concat_ws(':', {_scaled('total_secs', '10')}, {_scaled('speech_secs', '10')}, {', '.join(_scaled(c, '100') for c in ('avg_difficulty', 'speaker_complexity', 'energy_variance', 'overlap_risk'))}, scene_count, coalesce(s, 0))) AS content_hash
FROM cm LEFT JOIN sh USING (recording_id)""")
def _(spark, sf):
    rec, sp = v.recordings(spark, sf), v.speech(spark, sf)
    return content.content_hash(content.content_map(rec, sp), content.content_scenes(rec, sp))


# ==================================================================== evaluation
_F1 = """CASE WHEN {l} = 0 AND {r} = 0 THEN 1.0e0 WHEN {c} = 0 THEN 0.0e0 ELSE 2.0e0 * ({c}::DOUBLE / greatest(1, {r})) * ({c}::DOUBLE / greatest(1, {l}))
  / ({c}::DOUBLE / greatest(1, {r}) + {c}::DOUBLE / greatest(1, {l})) END"""
_PAIR_F1 = """tr AS (SELECT recording_id, pos, t, count(*) AS n FROM (SELECT recording_id, pos, unnest(regexp_extract_all(lower(ref_text), '[a-z0-9'']+')) AS t FROM aligned) GROUP BY ALL),
th AS (SELECT recording_id, pos, t, count(*) AS n FROM (SELECT recording_id, pos, unnest(regexp_extract_all(lower(hyp_text), '[a-z0-9'']+')) AS t FROM aligned) GROUP BY ALL),
tc AS (SELECT recording_id, pos, sum(least(tr.n, th.n)) AS c FROM tr JOIN th USING (recording_id, pos, t) GROUP BY 1, 2),
pf AS (SELECT a.*, """ + _F1.format(l="len(regexp_extract_all(lower(ref_text), '[a-z0-9'']+'))", r="len(regexp_extract_all(lower(hyp_text), '[a-z0-9'']+'))", c="coalesce(tc.c, 0)") + """ AS f1
 FROM aligned a LEFT JOIN tc USING (recording_id, pos))"""


@query("token_f1", o.ctes("aligned") + "," + _PAIR_F1 + " SELECT recording_id, pos, round(f1, 6) AS token_f1 FROM pf")
def _(spark, sf):
    pairs = ev.aligned_texts(v.ref_cues(spark, sf), v.hyp_cues(spark, sf))
    return T.add_token_f1(pairs, "ref_text", "hyp_text").select(*ID, *r6("token_f1"))


_CORPUS = """wr AS (SELECT recording_id, t, count(*) AS n FROM (SELECT recording_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM ref_cues) GROUP BY ALL),
wh AS (SELECT recording_id, t, count(*) AS n FROM (SELECT recording_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM hyp_cues) GROUP BY ALL),
cf AS (SELECT recording_id, """ + _F1.format(l="coalesce(nr, 0)", r="coalesce(nh, 0)", c="coalesce(c, 0)") + """ AS token_overlap_f1 FROM
 (SELECT DISTINCT recording_id FROM hyp_cues UNION SELECT DISTINCT recording_id FROM ref_cues) d
 LEFT JOIN (SELECT recording_id, sum(n) AS nr FROM wr GROUP BY 1) a USING (recording_id) LEFT JOIN (SELECT recording_id, sum(n) AS nh FROM wh GROUP BY 1) b USING (recording_id)
 LEFT JOIN (SELECT recording_id, sum(least(wr.n, wh.n)) AS c FROM wr JOIN wh USING (recording_id, t) GROUP BY 1) x USING (recording_id))"""


@query("corpus_token_f1", o.ctes("ref_cues", "hyp_cues") + "," + _CORPUS + f" SELECT recording_id, {s6('token_overlap_f1')} FROM cf")
def _(spark, sf):
    return ev.corpus_token_f1(v.ref_cues(spark, sf), v.hyp_cues(spark, sf)).select("recording_id", *r6("token_overlap_f1"))


_CHARS = "(SELECT recording_id, ch, count(*) AS n FROM (SELECT recording_id, unnest(string_split(lower(text), '')) AS ch FROM {t}) WHERE ch <> '' GROUP BY ALL)"


@query("char_overlap_ratio", o.ctes("ref_cues", "hyp_cues") + f", a AS {_CHARS.format(t='ref_cues')}, b AS {_CHARS.format(t='hyp_cues')}" + """
SELECT recording_id, round(2.0e0 * sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(coalesce(a.n, 0) + coalesce(b.n, 0)), 6) AS char_overlap_ratio
FROM a FULL JOIN b USING (recording_id, ch) GROUP BY 1""")
def _(spark, sf):
    return ev.char_overlap_ratio(v.ref_cues(spark, sf), v.hyp_cues(spark, sf)).select("recording_id", *r6("char_overlap_ratio"))


EVAL = ["time_coverage_ratio", "weighted_timing_iou", "non_empty_rate", "token_overlap_f1", "weighted_token_f1", "cue_density_ratio", "japanese_char_ratio", "line_char_similarity"]
_EVAL = o.ctes("aligned", "ref_cues", "hyp_cues") + "," + _PAIR_F1 + "," + _CORPUS + f""",
ls AS (SELECT recording_id, sum(weight * CASE WHEN a = b THEN 1.0e0 ELSE 1.0e0 - levenshtein({o.one_byte('a')}, {o.one_byte('b')})::DOUBLE / greatest(length(a), length(b)) END) / greatest(0.001e0, sum(weight)) AS line_char_similarity
 FROM (SELECT recording_id, weight, lower(ref_text) AS a, lower(hyp_text) AS b FROM aligned) GROUP BY 1),
""" + """w AS (SELECT recording_id, count(*) AS aligned_pairs, sum(overlap_ms) AS ov, sum(iou * weight) / greatest(0.001, sum(weight)) AS weighted_timing_iou,
  sum(f1 * weight) / greatest(0.001, sum(weight)) AS weighted_token_f1 FROM pf GROUP BY 1),
h AS (SELECT recording_id, count(*) AS hyp_cues, arg_max(end_ms, pos) AS last, sum(greatest(1, end_ms - start_ms)) AS dur, avg((trim(text) <> '')::INT) AS non_empty_rate,
  sum(length(regexp_replace(text, '[^\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]', '', 'g'))) AS jp, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS solid FROM hyp_cues GROUP BY 1),
r AS (SELECT recording_id, count(*) AS ref_cues, arg_max(end_ms, pos) AS last FROM ref_cues GROUP BY 1),
ev AS (SELECT h.recording_id, coalesce(ref_cues, 0) AS ref_cues, hyp_cues, coalesce(aligned_pairs, 0) AS aligned_pairs, coalesce(ref_cues, 0) = hyp_cues AS cue_count_match,
  coalesce(ov, 0)::DOUBLE / dur AS time_coverage_ratio, coalesce(weighted_timing_iou, 0) AS weighted_timing_iou, non_empty_rate,
  token_overlap_f1, coalesce(weighted_token_f1, 0) AS weighted_token_f1,
  (hyp_cues / greatest(1.0e0, h.last / 3600000.0e0)) / greatest(1.0e0, coalesce(ref_cues, 0) / greatest(1.0e0, coalesce(r.last, 0) / 3600000.0e0)) AS cue_density_ratio,
  CASE WHEN solid = 0 THEN 0.0e0 ELSE jp::DOUBLE / solid END AS japanese_char_ratio, coalesce(line_char_similarity, 0) AS line_char_similarity
FROM h LEFT JOIN r USING (recording_id) LEFT JOIN w USING (recording_id) LEFT JOIN cf USING (recording_id) LEFT JOIN ls USING (recording_id))"""


# Length of the common beginning of a[e:] and b[f:], at most ``most``, by halving steps.
_COMMON = """list_reduce([0, 524288, 262144, 131072, 65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1],
   lambda n, p: CASE WHEN n + p <= {most} AND substr({a}, {e} + n + 1, p) = substr({b}, {f} + n + 1, p) THEN n + p ELSE n END)"""
# Matching blocks: of a region of both texts the longest run of equal letters (the first in a, then in b) is taken, then the
# regions to its left and right.  In texts of 200 letters and more those over one percent of b only extend a run.
_BLOCKS = """whole AS (SELECT recording_id, coalesce(lower(r.t), '') AS a, coalesce(lower(h.t), '') AS b FROM (SELECT recording_id, string_agg(text, ' ' ORDER BY pos) AS t FROM ref_cues GROUP BY 1) r
 FULL JOIN (SELECT recording_id, string_agg(text, ' ' ORDER BY pos) AS t FROM hyp_cues GROUP BY 1) h USING (recording_id)),
bt AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS id, a, b, length(a) AS la, length(b) AS lb, reverse(a) AS ra, reverse(b) AS rb
 FROM (SELECT lower(ref_text) AS a, lower(hyp_text) AS b FROM aligned UNION SELECT a, b FROM whole) WHERE a <> b),
ca AS (SELECT id, unnest(string_split(a, '')) AS ch, unnest(range(la)) AS i FROM bt), cb AS (SELECT id, lb, unnest(string_split(b, '')) AS ch, unnest(range(lb)) AS j FROM bt),
kept AS (SELECT id, ch FROM cb GROUP BY id, ch, lb HAVING count(*) <= CASE WHEN lb >= 200 THEN lb // 100 + 1 ELSE lb END),
eq AS (SELECT id, i, j - i AS d FROM ca JOIN kept USING (id, ch) JOIN cb USING (id, ch)),
runs AS (SELECT id, d, min(i) AS i, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS g FROM eq) GROUP BY id, d, g),
w AS (SELECT id, 0::BIGINT AS alo, la AS ahi, 0::BIGINT AS blo, lb AS bhi, r.i, r.e, r.d, NULL::BIGINT AS got FROM bt JOIN runs r USING (id)
 UNION ALL SELECT id, 0, la, 0, lb, NULL, NULL, NULL, NULL FROM bt
 UNION ALL (WITH best AS MATERIALIZED (SELECT id, alo, ahi, blo, bhi, max((e - i) * 1099511627776 + (1048575 - i) * 1048576 + (1048575 - i - d)) AS m FROM w WHERE got IS NULL GROUP BY ALL),
  won AS (SELECT id, alo, ahi, blo, bhi, m, coalesce(m >> 40, 0) AS k, coalesce(1048575 - ((m >> 20) & 1048575), alo) AS i, coalesce(1048575 - (m & 1048575), blo) AS j FROM best),
  blk AS MATERIALIZED (SELECT won.*, j - i AS d, i - CASE WHEN m IS NULL THEN 0 ELSE """ + _COMMON.format(most="least(i - alo, j - blo)", a="ra", e="la - i", b="rb", f="lb - j") + """ END AS s,
    i + k + """ + _COMMON.format(most="least(ahi - i - k, bhi - j - k)", a="a", e="i + k", b="b", f="j + k") + """ AS t FROM won JOIN bt USING (id)),
  side AS (SELECT id, alo AS was, alo, s AS ahi, blo, s + d AS bhi FROM blk WHERE m IS NOT NULL AND s > alo AND s + d > blo
   UNION ALL SELECT id, alo, t, ahi, t + d, bhi FROM blk WHERE m IS NOT NULL AND t < ahi AND t + d < bhi)
  SELECT id, 0, 0, 0, 0, NULL, NULL, NULL, t - s FROM blk
  UNION ALL SELECT id, alo, ahi, blo, bhi, NULL, NULL, NULL, NULL FROM side
  UNION ALL SELECT * FROM (SELECT x.id, x.alo, x.ahi, x.blo, x.bhi, greatest(w.i, x.alo, x.blo - w.d) AS i, least(w.e, x.ahi, x.bhi - w.d) AS e, w.d, NULL::BIGINT FROM w JOIN side x ON x.id = w.id AND x.was = w.alo WHERE w.i IS NOT NULL) WHERE e > i)),
br AS (SELECT a, b, 2.0e0 * sum(got) / (la + lb) AS ratio FROM w JOIN bt USING (id) WHERE got IS NOT NULL GROUP BY a, b, la, lb),
rs AS (SELECT recording_id, coalesce(ratio, 1.0e0) AS reference_char_similarity FROM whole LEFT JOIN br USING (a, b)),
ls AS (SELECT recording_id, sum(weight * coalesce(ratio, 1.0e0)) / greatest(0.001e0, sum(weight)) AS line_char_similarity
 FROM (SELECT recording_id, weight, lower(ref_text) AS a, lower(hyp_text) AS b FROM aligned) LEFT JOIN br USING (a, b) GROUP BY 1),
"""
_EVAL_BLOCKS = (_EVAL[:_EVAL.index("ls AS")] + _BLOCKS + _EVAL[_EVAL.index("w AS (SELECT recording_id, count(*) AS aligned_pairs"):]).replace(
    "w AS (SELECT recording_id, count(*) AS aligned_pairs", "pw AS (SELECT recording_id, count(*) AS aligned_pairs").replace("LEFT JOIN w USING", "LEFT JOIN rs USING (recording_id) LEFT JOIN pw USING").replace(
    "coalesce(line_char_similarity, 0) AS line_char_similarity", "coalesce(line_char_similarity, 0) AS line_char_similarity, reference_char_similarity")
EVAL_BLOCKS = [*EVAL, "reference_char_similarity"]


@query("evaluate", _EVAL_BLOCKS + " SELECT recording_id, ref_cues, hyp_cues, aligned_pairs, cue_count_match, " + ", ".join(map(s6, EVAL_BLOCKS)) + " FROM ev")
def _(spark, sf):
    out = ev.evaluate(v.ref_cues(spark, sf), v.hyp_cues(spark, sf))
    return out.select("recording_id", "ref_cues", "hyp_cues", "aligned_pairs", "cue_count_match", *r6(*EVAL_BLOCKS))


@query("evaluate_whole")
def _(spark, sf):
    """All metrics, lines and whole texts compared by matching blocks."""
    out = ev.evaluate(v.ref_cues(spark, sf), v.hyp_cues(spark, sf), blocks=True)
    return out.select("recording_id", "ref_cues", "hyp_cues", "aligned_pairs", "cue_count_match", *r6(*EVAL_BLOCKS))


@query("char_similarity")
def _(spark, sf):
    pairs = ev.aligned_texts(v.ref_cues(spark, sf), v.hyp_cues(spark, sf))
    return T.add_char_similarity(pairs, "ref_text", "hyp_text").select(*ID, *r6("char_similarity"))


@query("evaluation_gate", _EVAL + f""" SELECT recording_id, {s6('line_char_similarity')}, {s6('weighted_token_f1')}, non_empty_rate >= 0.999e0 AND time_coverage_ratio >= 0.75e0
  AND line_char_similarity >= 0.20e0 AND weighted_token_f1 >= 0.35e0 AND japanese_char_ratio <= 0.20e0 AS passed FROM ev""")
def _(spark, sf):
    out = ev.evaluation_gate(ev.evaluate(v.ref_cues(spark, sf), v.hyp_cues(spark, sf), blocks=False))
    return out.select("recording_id", *r6("line_char_similarity", "weighted_token_f1"), "passed")


@query("rank_candidates", o.ctes("cues") + """, m AS (SELECT recording_id, c AS candidate, round(avg((length(text) % c) / 10.0e0), 6) AS weighted_token_f1,
  round(avg((length(text) % 3) / 10.0e0), 6) AS line_char_similarity FROM cues, (VALUES (2), (5), (7)) x(c) GROUP BY 1, 2)
SELECT recording_id, candidate, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY weighted_token_f1 DESC, line_char_similarity DESC, candidate) AS INT) AS rank FROM m""")
def _(spark, sf):
    """Three invented candidates per document, measured by rule."""
    c = v.cues(spark, sf).withColumn("candidate", F.explode(F.array(F.lit(2), F.lit(5), F.lit(7))))
    m = c.groupBy("recording_id", "candidate").agg(
        F.round(F.avg(F.length("text") % F.col("candidate") / 10.0), 6).alias("weighted_token_f1"),
        F.round(F.avg(F.length("text") % 3 / 10.0), 6).alias("line_char_similarity"))
    return ev.rank_candidates(m).select("recording_id", "candidate", "rank")


# ======================================================================= context
_WIN = """SELECT recording_id, pos, concat_ws('|', lag(text, 2) OVER w, lag(text, 1) OVER w) AS prev_lines, concat_ws('|', lead(text, 1) OVER w, lead(text, 2) OVER w) AS next_lines,
 text FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY pos)"""


@query("context_windows", o.ctes("cues") + f" SELECT recording_id, pos, prev_lines, next_lines FROM ({_WIN})")
def _(spark, sf):
    w = context.context_windows(v.cues(spark, sf), 2)
    return w.select(*ID, F.array_join("prev_lines", "|").alias("prev_lines"), F.array_join("next_lines", "|").alias("next_lines"))


@query("context_prompt", o.ctes("cues") + """ SELECT recording_id, pos, concat(coalesce('[PREV] ' || lag(text, 2) OVER w || chr(10), ''), coalesce('[PREV] ' || lag(text, 1) OVER w || chr(10), ''),
 '[CUR] ', text, chr(10), coalesce('[NEXT] ' || lead(text, 1) OVER w || chr(10), ''), coalesce('[NEXT] ' || lead(text, 2) OVER w || chr(10), '')) AS prompt
FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY pos)""")
def _(spark, sf):
    return context.context_prompt(context.context_windows(v.cues(spark, sf), 2)).select(*ID, "prompt")


@query("hinted_text", o.ctes("cues") + """ SELECT recording_id, pos, concat_ws(' ', nullif(trim(lag(text, 1) OVER w), ''), CASE WHEN trim(text) = '' THEN ' ' ELSE trim(text) END) AS hinted
FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY pos)""")
def _(spark, sf):
    return context.hinted_text(context.context_windows(v.cues(spark, sf), 1)).select(*ID, "hinted")


@query("map_text_batches", o.ctes("cues") + """ SELECT recording_id, pos, CASE WHEN pos % 5 = 3 THEN text ELSE concat('<', coalesce(lag(text, 1) OVER w, ''), '> ', text) END AS text
FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY pos)""")
def _(spark, sf):
    """A stand-in model that quotes the previous line and gives no answer for some cues."""
    c = context.context_tags(v.cues(spark, sf), "balanced")
    w = context.context_windows(c, 1).select(*ID, "text", "prev_lines", "next_lines", "context_tags")
    w = w.withColumn("context_tags", F.array_append("context_tags", F.concat(F.lit("pos:"), F.col("pos").cast("string"))))

    def model(texts, prev, nxt, tags):
        skip = [int(t[-1].split(":")[1]) % 5 == 3 for t in tags]
        return ["" if s else f"<{p[-1] if len(p) else ''}> {t}" for t, p, s in zip(texts, prev, skip)]

    return context.map_text_batches(w, model).select(*ID, "text")


# =================================================================== consistency
_CONS = f"""k AS (SELECT *, regexp_replace(src, '[^A-Za-z0-9]', '', 'g') AS s, trim(regexp_replace({o.ascii_lower('tgt')}, '[^a-z0-9'']+', ' ', 'g')) AS t, {o.collapse('tgt')} AS d FROM pairs),
g AS (SELECT recording_id, s, t, count(*) AS n, arg_min(d, (doc_id, pos)) AS d FROM k WHERE length(s) BETWEEN 2 AND 64 AND t <> '' AND len(string_split(t, ' ')) <= 10 GROUP BY 1, 2, 3),
p AS (SELECT recording_id, s, sum(n) AS total, count(*) AS vars, arg_min(t, (-n, t)) AS ct, arg_min(d, (-n, t)) AS cd, max(n) AS top FROM g GROUP BY 1, 2),
c AS (SELECT recording_id, s, ct, cd FROM p WHERE total >= 3 AND vars >= 2 AND top / total >= 0.5),
x AS (SELECT k.*, c.cd, c.ct IS NOT NULL AND k.t <> '' AND k.t <> c.ct AND (1.0e0 - levenshtein(k.t, c.ct)::DOUBLE / greatest(length(k.t), length(c.ct)) >= 0.6
  OR (len(string_split(k.t, ' ')) <= 4 AND len(string_split(c.ct, ' ')) <= 4 AND (starts_with(k.t, c.ct) OR starts_with(c.ct, k.t)))) AS ch FROM k LEFT JOIN c USING (recording_id, s))
SELECT recording_id, doc_id, pos, coalesce(ch, false) AS rewritten, CASE WHEN NOT coalesce(ch, false) THEN tgt
  WHEN ends_with(cap, regexp_extract(trim(tgt), '[.!?]*$')) THEN cap ELSE cap || regexp_extract(trim(tgt), '[.!?]*$') END AS new_tgt FROM (
  SELECT *, CASE WHEN regexp_matches(trim(tgt), '^[A-Z]') THEN upper(cd[1]) || cd[2:] ELSE cd END AS cap FROM x)"""


@query("phrase_consistency", o.ctes("pairs") + "," + _CONS)
def _(spark, sf):
    out = consistency.phrase_consistency(v.pairs(spark, sf), order=["doc_id", "pos"])
    return out.select("recording_id", "doc_id", "pos", "new_tgt", "rewritten")


_OUTER = r"""regexp_replace({w}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"""
def _leaders_sql(base: str) -> str:
    return f"""w AS (SELECT recording_id, word, count(*) AS freq FROM (SELECT recording_id, {_OUTER.format(w='raw')} AS word FROM (
  SELECT recording_id, unnest(string_split({o.collapse('text')}, ' ')) AS raw FROM {base})) WHERE strlen(word) >= 2 AND regexp_matches(word, '^\\p{{Lu}}') GROUP BY 1, 2),
ord AS (SELECT recording_id, word, freq, row_number() OVER (PARTITION BY recording_id, word[1] ORDER BY freq DESC, word) AS r, {o.one_byte('word')} AS b FROM w),
near AS (SELECT a.recording_id, a.word[1] AS ini, a.word AS up, a.r AS ur, z.word AS lo, z.r AS lr FROM ord a JOIN ord z ON a.recording_id = z.recording_id AND a.word[1] = z.word[1] AND a.r < z.r
  AND abs(length(a.word) - length(z.word)) <= 2 AND levenshtein(a.b, z.b) <= 2),
lst AS (SELECT o.recording_id, o.word[1] AS ini, list({{'r': o.r, 'u': coalesce(n.u, [])}} ORDER BY o.r) AS ws FROM ord o
  LEFT JOIN (SELECT recording_id, lo, list(ur) AS u FROM near GROUP BY 1, 2) n ON n.recording_id = o.recording_id AND n.lo = o.word GROUP BY 1, 2),
lead AS (SELECT recording_id, ini, list_reduce(ws, lambda acc, x: CASE WHEN len(list_intersect(acc, x.u)) > 0 THEN acc ELSE list_append(acc, x.r) END, CAST([] AS BIGINT[])) AS leads
  FROM (SELECT recording_id, ini, list_transform(ws, lambda x: {{'r': x.r, 'u': x.u}}) AS ws FROM lst)),
fol AS (SELECT n.recording_id, n.lo AS word, arg_min(n.up, (-f.freq, n.up)) AS canonical FROM near n JOIN lead l USING (recording_id, ini) JOIN ord f ON f.recording_id = n.recording_id AND f.word = n.up
  WHERE list_contains(l.leads, n.ur) AND NOT list_contains(l.leads, n.lr) GROUP BY 1, 2)"""


_LEADERS = _leaders_sql("cues")


@query("name_leaders", o.ctes("cues") + "," + _LEADERS + " SELECT recording_id, word, canonical FROM fol")
def _(spark, sf):
    return names.name_leaders(v.cues(spark, sf)).select("recording_id", "word", "canonical")


@query("similar_names", o.ctes("title") + """ SELECT a.recording_id, lower(a.name) AS a, lower(b.name) AS b, CAST(levenshtein(lower(a.name), lower(b.name)) AS INT) AS edit_distance FROM title a JOIN title b
 ON a.recording_id = b.recording_id AND a.name < b.name AND a.name[1] = b.name[1] AND abs(length(a.name) - length(b.name)) <= 2
 AND 100 * levenshtein(lower(a.name), lower(b.name)) <= 22 * greatest(length(a.name), length(b.name))""")
def _(spark, sf):
    found = v.cues(spark, sf).select("recording_id", F.explode(T.titlecase_tokens("text")).alias("w"))
    words = found.select("recording_id", T.ascii_lower("w").alias("w")).distinct()
    return names.near_pairs(words, ["recording_id"], "w", lambda n: F.floor(n - F.ceil(n * 78 / 100))).select("recording_id", "a", "b", "edit_distance")


_CANON = r"""t AS (SELECT recording_id, pos, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw FROM (SELECT recording_id, pos, regexp_extract_all(text, '\s+|\S+') AS p FROM @BASE)),
tt AS (SELECT *, """ + _OUTER.format(w='raw') + r""" AS core FROM t),
u AS (SELECT recording_id, pos, i, unnest(generate_series(1, len(p))) AS j, unnest(p) AS piece FROM (SELECT *, regexp_extract_all(raw, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p FROM tt)),
uu AS (SELECT u.recording_id, u.pos, u.i, string_agg(coalesce(f.canonical, u.piece), '' ORDER BY j) AS inner_new FROM u LEFT JOIN fol f ON f.recording_id = u.recording_id AND f.word = u.piece GROUP BY 1, 2, 3)
SELECT tt.recording_id, tt.pos, string_agg(CASE WHEN f.canonical IS NOT NULL THEN regexp_extract(raw, '^[^\p{L}\p{N}]*') || f.canonical || regexp_extract(raw, '[^\p{L}\p{N}]*$') ELSE inner_new END, '' ORDER BY tt.i) AS text
FROM tt JOIN uu USING (recording_id, pos, i) LEFT JOIN fol f ON f.recording_id = tt.recording_id AND f.word = tt.core GROUP BY 1, 2"""


@query("canonical_names", o.ctes("cues") + "," + _LEADERS + "," + _CANON.replace("@BASE", "cues"))
def _(spark, sf):
    return names.canonical_names(v.cues(spark, sf).select(*ID, "text")).select(*ID, "text")


# ========================================================================== text
def _text_query(name, fn, col, sql_expr, base="cues", view=None):
    @query(name, o.ctes(base) + f" SELECT recording_id, pos, {sql_expr} AS {col} FROM {base}")
    def _(spark, sf):
        return fn((view or v.cues)(spark, sf)).select(*ID, col)


_text_query("tokens", lambda d: T.add_tokens(d).withColumn("tokens", F.array_join("tokens", " ")), "tokens", "array_to_string(regexp_extract_all(text, '[A-Za-z'']+'), ' ')")
_text_query("double_apostrophe", T.add_double_apostrophe, "double_apostrophe", "regexp_matches(text, '''[A-Za-z]*''')", "messy", v.messy)
_text_query("malformed_contraction", T.add_malformed_contraction, "malformed_contraction",
            "(" + " OR ".join(f"contains({o.ascii_lower('text')}, {o.q(m)})" for m in rules.MALFORMED) + ")", "messy", v.messy)


@query("low_function_words", o.ctes("feats") + " SELECT recording_id, pos, low_function AS low_function_words FROM feats")
def _(spark, sf):
    return T.add_low_function_words(v.cues(spark, sf)).select(*ID, "low_function_words")


@query("adjacent_repeat", o.ctes("feats") + " SELECT recording_id, pos, repeats AS adjacent_repeat FROM feats")
def _(spark, sf):
    return T.add_adjacent_repeat(v.cues(spark, sf)).select(*ID, "adjacent_repeat")


_text_query("titlecase_tokens", lambda d: T.add_titlecase_tokens(d).withColumn("titlecase_tokens", F.array_join("titlecase_tokens", " ")), "titlecase_tokens",
            "array_to_string(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')), ' ')")
_text_query("has_japanese", T.add_has_japanese, "has_japanese", r"regexp_matches(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')", "japanese", v.japanese)
_text_query("jp_ratio", lambda d: T.add_jp_ratio(d).withColumn("jp_ratio", F.round("jp_ratio", 6)), "jp_ratio",
            r"round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 0.0e0 ELSE length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '\s', '', 'g')) END, 6)",
            "japanese", v.japanese)


@query("generic_interjection", f"SELECT conv_id, turn, {o.interjection(o.ascii_lower(o.collapse('t')))} AS generic_interjection FROM (SELECT *, CASE turn % 4 WHEN 0 THEN 'Oh my  God!!' WHEN 1 THEN ' Wait, a minute...' ELSE text END AS t FROM conversations)")
def _(spark, sf):
    c = v.table(spark, sf, "conversations").withColumn(
        "t", F.expr("CASE turn % 4 WHEN 0 THEN 'Oh my  God!!' WHEN 1 THEN ' Wait, a minute...' ELSE text END"))
    return T.add_generic_interjection(c, "t").select("conv_id", "turn", "generic_interjection")


@query("repeated_ngram", o.ctes("cues") + """, t AS (SELECT recording_id, pos, regexp_extract_all(text, '[A-Za-z'']+') AS k FROM cues),
g AS (SELECT recording_id, pos, k[i] || ' ' || k[i + 1] || ' ' || k[i + 2] AS g, min(i) AS a, max(i) AS b FROM (SELECT *, unnest(range(1, len(k) - 1)) AS i FROM t WHERE len(k) >= 6) GROUP BY 1, 2, 3)
SELECT recording_id, pos, coalesce(r, false) AS repeated_ngram FROM cues LEFT JOIN (SELECT recording_id, pos, bool_or(b - a >= 3) AS r FROM g GROUP BY 1, 2) USING (recording_id, pos)""")
def _(spark, sf):
    return T.repeated_ngram(v.cues(spark, sf), ID).select(*ID, "repeated_ngram")


_FORMS = ["health_key", "compact_text", "line_key", "source_key", "target_key", "short_cue_key", "exact_key"]


@query("normalisers", o.ctes("japanese") + f""" SELECT recording_id, pos, lower({o.collapse('text')}) AS health_key, {o.collapse('text')} AS compact_text, {o.ascii_lower(o.collapse('text'))} AS line_key,
 regexp_replace(text, '[^A-Za-z0-9\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g') AS source_key, trim(regexp_replace({o.ascii_lower('text')}, '[^a-z0-9'']+', ' ', 'g')) AS target_key,
 regexp_replace(text, '[\\s。、！？!?….,，・ー～~「」『』（）()　-]', '', 'g') AS short_cue_key, regexp_replace(text, '[ \\t\\n\\f\\r。！？]', '', 'g') AS exact_key FROM japanese""")
def _(spark, sf):
    return T.add_normal_forms(v.japanese(spark, sf)).select(*ID, *_FORMS)


def _neighbours(spark, sf):
    """Cues with their whole text ``a`` and that of the next cue, ``b``."""
    c = v.cues(spark, sf).select(*ID, F.col("text").alias("a"))
    return c.join(c.select("recording_id", (F.col("pos") - 1).alias("pos"), F.col("a").alias("b")), ID)


_SIMILAR = o.ctes("cues") + f""" SELECT recording_id, pos, round(CASE WHEN a = b THEN 1.0e0 ELSE 1.0e0 - levenshtein({o.one_byte('a')}, {o.one_byte('b')})::DOUBLE / greatest(length(a), length(b)) END, 6) AS similarity FROM (
 SELECT recording_id, pos, text AS a, lead(text) OVER (PARTITION BY recording_id ORDER BY pos) AS b FROM cues) WHERE b IS NOT NULL"""


@query("similarity", _SIMILAR)
def _(spark, sf):
    """Whole texts of neighbouring cues."""
    return T.add_similarity(_neighbours(spark, sf), "a", "b").select(*ID, *r6("similarity"))


QUERIES["similarity_whole"], SQL["similarity_whole"] = QUERIES["similarity"], _SIMILAR


# ======================================================================== repair
def _rules_sql(expr: str, pairs) -> str:
    for a, b in pairs:
        pattern = "".join("\\" + ch if not ch.isalnum() and ch not in " '" else ch for ch in a)
        expr = f"regexp_replace({expr}, {o.q('(?i)' + pattern)}, {o.q(b)}, 'g')"
    return expr


def _contractions_sql(expr: str) -> str:
    expr = _rules_sql(_rules_sql(expr, rules.CONTRACTION_RULES), rules.PHRASE_RULES)
    for a, b in rules.LINE_START_RULES:
        expr = f"regexp_replace({expr}, {o.q('^' + a)}, {o.q(b)})"
    return _rules_sql(expr, rules.POSSESSIVE_RULES)


_SENT = r"""(SELECT *, list_filter(list_transform(regexp_split_to_array({t}, '[.!?]'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM {b})"""
_REP = """CASE WHEN len(parts) < 3 OR len(kept) = len(parts) THEN text ELSE array_to_string(kept, '. ') END"""


def _repeat_sql(base: str) -> str:
    return f"""(SELECT * EXCLUDE (parts, kept, text), {_REP} AS text FROM (SELECT *, list_transform(list_filter(list_zip(parts, range(1, len(parts) + 1)),
  lambda x: len(list_filter(list_transform(parts[1:x[2]], lambda s: lower(s)), lambda s: s = lower(x[1]))) <= 2), lambda x: x[1]) AS kept FROM {_SENT.format(t='text', b=base)}))"""


_TIDY = "trim(replace(replace({e}, '()', ''), '( )', ''))"


def _capital_sql(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '^[a-z]') THEN upper({e}[1]) || {e}[2:] ELSE {e} END"


_text_query("repair_contractions", R.repair_contractions, "text", _contractions_sql("text"), "messy", v.messy)
_text_query("repair_grammar", R.repair_grammar, "text", _rules_sql("text", rules.GRAMMAR_RULES), "messy", v.messy)


@query("collapse_repetitions", o.ctes("messy") + f" SELECT recording_id, pos, text FROM {_repeat_sql('messy')}")
def _(spark, sf):
    return R.collapse_repetitions(v.messy(spark, sf)).select(*ID, "text")


_KEY = "regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^a-z0-9'']+|[^a-z0-9'']+$', '', 'g')"


def _loops_sql(base: str) -> str:
    key = lambda x: _KEY.replace("(t,", f"({x},")
    low = o.ascii_lower("x")
    return f"""(SELECT recording_id, pos, CASE WHEN len(tk) < 2 THEN text ELSE array_to_string(list_reduce(range(1, len(ot) + 1), lambda acc, i:
   CASE WHEN i < acc.skip THEN acc
        WHEN i + 3 <= len(ot) AND ok[i] = ok[i + 2] AND ok[i + 1] = ok[i + 3] THEN {{'skip': i + 4, 'out': acc.out || [ot[i], ot[i + 1]]}}
        ELSE {{'skip': i + 1, 'out': list_append(acc.out, ot[i])}} END, {{'skip': CAST(1 AS BIGINT), 'out': CAST([] AS VARCHAR[])}}).out, ' ') END AS text
  FROM (SELECT *, list_filter(tk, lambda x, i: i = 1 OR ks[i - 1] <> ks[i]) AS ot, list_filter(ks, lambda x, i: i = 1 OR ks[i - 1] <> ks[i]) AS ok
   FROM (SELECT *, list_transform(tk, lambda x: CASE WHEN {key('x')} = '' THEN {low} ELSE {key('x')} END) AS ks
    FROM (SELECT *, string_split({o.collapse('text')}, ' ') AS tk FROM {base}))))"""


@query("collapse_token_loops", o.ctes("messy") + f" SELECT recording_id, pos, text FROM {_loops_sql('messy')}")
def _(spark, sf):
    return R.collapse_token_loops(v.messy(spark, sf)).select(*ID, "text")


_text_query("tidy", R.tidy, "text", _TIDY.format(e=o.collapse("text")), "messy", v.messy)


@query("capitalise_lines", "WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: CASE WHEN regexp_matches(s, '^\\s*[a-z]') THEN regexp_extract(s, '^\\s*') || upper(ltrim(s)[1]) || ltrim(s)[2:] ELSE s END) AS p FROM documents) SELECT doc_id, array_to_string(p, chr(10)) AS text FROM d")
def _(spark, sf):
    return R.capitalise_lines(v.table(spark, sf, "documents")).select("doc_id", "text")


_MERGE = o.ctes("cues") + r""", n AS (SELECT recording_id, pos, text AS a, lead(text) OVER (PARTITION BY recording_id ORDER BY pos) AS b FROM cues),
m AS (SELECT *, regexp_replace(a, '^\s+|\s+$', '', 'g') AS sa, regexp_replace(b, '^\s+|\s+$', '', 'g') AS sb, regexp_replace(a, '\s+$', '') AS ra, regexp_replace(b, '^\s+', '') AS lb FROM n WHERE b IS NOT NULL)
SELECT recording_id, pos, a <> '' AND b <> '' AND NOT (regexp_matches(sa || sb, '[\[\]]') OR len(regexp_extract_all(a, '\S+')) > 8 OR len(regexp_extract_all(b, '\S+')) > 8
 OR regexp_matches(sb, '^[A-Z]') OR regexp_matches(sa, '[.?!:]$')) AS can_merge, CASE WHEN ra = '' THEN lb WHEN lb = '' THEN ra ELSE ra || ' ' || lb END AS merged FROM m"""


@query("can_merge", _MERGE)
def _(spark, sf):
    """Neighbouring cues as they are."""
    return _neighbours(spark, sf).select(*ID, R.can_merge_expr("a", "b").alias("can_merge"), R.merge_expr("a", "b").alias("merged"))


QUERIES["can_merge_whole"], SQL["can_merge_whole"] = QUERIES["can_merge"], _MERGE


def _dict_sql() -> str:
    expr = "text"
    for a, b in rules.INLINE_PHRASES:
        expr = f"replace({expr}, {o.q(a)}, {o.q(b)})"
    exact = " ".join(f"WHEN {o.q(a)} THEN {o.q(b)}" for a, b in rules.EXACT_PHRASES)
    return f"""CASE WHEN NOT regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]') THEN text
  ELSE coalesce(CASE regexp_replace(text, '[ \\t\\n\\f\\r。！？]', '', 'g') {exact} END, CASE WHEN {expr} = text THEN text ELSE {o.collapse(expr)} END) END"""


@query("dictionary_translate", o.ctes("japanese") + f" SELECT recording_id, pos, {_dict_sql()} AS text FROM japanese")
def _(spark, sf):
    return R.dictionary_translate(v.japanese(spark, sf), F.col("lang")).select(*ID, "text")


@query("repair_short_cues", o.ctes("japanese") + " SELECT recording_id, pos, CASE k " + " ".join(f"WHEN {o.q(a)} THEN {o.q(b)}" for a, b in rules.SHORT_CUES)
       + " ELSE lang END AS tgt FROM (SELECT *, regexp_replace(text, '[\\s。、！？!?….,，・ー～~「」『』（）()　-]', '', 'g') AS k FROM japanese)")
def _(spark, sf):
    c = v.japanese(spark, sf).select(*ID, F.col("text").alias("src"), F.col("lang").alias("tgt"))
    return R.repair_short_cues(c).select(*ID, "tgt")


@query("normalise_lang", "SELECT doc_id, CASE lang " + " ".join(f"WHEN {o.q(a)} THEN {o.q(b)}" for a, b in rules.LANG_CODES) + " ELSE lang END AS lang_tag FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM documents)")
def _(spark, sf):
    d = v.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    return R.normalise_lang(d).select("doc_id", "lang_tag")


def _clean_sql() -> str:
    named = "(" + "WITH " + _CANON.replace("@BASE", "messy") + ")"
    fixed = f"(SELECT recording_id, pos, {_rules_sql(_contractions_sql('text'), rules.GRAMMAR_RULES)} AS text FROM {named})"
    tidied = f"(SELECT recording_id, pos, {_TIDY.format(e=o.collapse('text'))} AS text FROM {_loops_sql(_repeat_sql(fixed))})"
    return o.ctes("messy") + "," + _leaders_sql("messy") + f" SELECT recording_id, pos, {_capital_sql('text')} AS text FROM {tidied}"


@query("clean_translation", _clean_sql())
def _(spark, sf):
    return R.clean_translation(v.messy(spark, sf)).select(*ID, "text")


# ========================================================================= folds
_STITCH = f"""o AS (SELECT recording_id, chunk_index, pos, start_ms + chunk_index * 30000 AS start_ms, end_ms + chunk_index * 30000 AS end_ms, text FROM chunk_cues
  WHERE recording_id IN (SELECT recording_id FROM chunk_cues GROUP BY 1 HAVING count(DISTINCT chunk_index) > 1)),
n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, chunk_index, pos) AS i FROM o),
f AS (SELECT recording_id, i, true AS kept, start_ms AS ls, chunk_index AS lc, text AS lt FROM n WHERE i = 1
 UNION ALL SELECT recording_id, i, NOT dup, CASE WHEN dup THEN ls ELSE start_ms END, CASE WHEN dup THEN lc ELSE chunk_index END, CASE WHEN dup THEN lt ELSE text END FROM (
  SELECT n.*, f.ls, f.lc, f.lt, CASE WHEN n.start_ms - f.ls < 2000 AND n.text = f.lt THEN true WHEN n.chunk_index = f.lc OR n.start_ms - f.ls >= 3000 THEN false
    WHEN least(length(n.text), length(f.lt)) < 0.6 * greatest(length(n.text), length(f.lt)) THEN false
    ELSE 1.0e0 - levenshtein({o.one_byte('n.text')}, {o.one_byte('f.lt')})::DOUBLE / greatest(1, length(n.text), length(f.lt)) >= 0.6 END AS dup
  FROM f JOIN n ON n.recording_id = f.recording_id AND n.i = f.i + 1)),
st AS (SELECT recording_id, chunk_index, pos, start_ms, end_ms FROM f JOIN n USING (recording_id, i) WHERE kept
 UNION ALL SELECT recording_id, chunk_index, pos, start_ms, end_ms FROM chunk_cues WHERE recording_id IN (SELECT recording_id FROM chunk_cues GROUP BY 1 HAVING count(DISTINCT chunk_index) = 1))"""


@query("stitch_chunks", o.ctes("chunk_cues") + "," + _STITCH + " SELECT recording_id, chunk_index, pos, start_ms, end_ms FROM st")
def _(spark, sf):
    c = v.chunk_cues(spark, sf)
    return folds.stitch_chunks(c, v.chunk_offsets(c)).select("recording_id", "chunk_index", "pos", "start_ms", "end_ms")


@query("renumber_stitched", o.ctes("chunk_cues") + "," + _STITCH + f""" SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, chunk_index, pos) AS INT) AS idx,
 {o.clock('start_ms')} || ' --> ' || {o.clock('end_ms')} AS timing FROM st""")
def _(spark, sf):
    c = v.chunk_cues(spark, sf)
    out = folds.renumber_stitched(folds.stitch_chunks(c, v.chunk_offsets(c)))
    return timing.format_timing(out).select("recording_id", "idx", "timing")


def _compact_sql() -> str:
    toks, raw = "lk", "rk"
    grams = f"""len(list_filter(range(1, len({raw}) - 4), lambda i: len(list_filter(range(i + 3, len({raw}) - 1), lambda j: {raw}[i] = {raw}[j] AND {raw}[i + 1] = {raw}[j + 1] AND {raw}[i + 2] = {raw}[j + 2])) > 0)) > 0"""
    words = lambda c: f"len(regexp_extract_all({c}, '\\S+'))"
    # what happens to row n after the current text: 0 skip, 1 extend, 2 merge, 3 new
    return f"""n AS (SELECT recording_id, pos, start_ms, end_ms, {o.collapse('text')} AS t FROM cues),
lim AS (SELECT recording_id, greatest(20, count(*) // 16) AS budget FROM cues GROUP BY 1),
f AS (SELECT recording_id, pos, pos AS head, start_ms AS cs, end_ms AS ce, t AS ct, 0 AS used, 0 AS mine FROM n WHERE pos = 0
 UNION ALL SELECT recording_id, pos, CASE WHEN act = 3 THEN pos ELSE head END, CASE WHEN act = 3 THEN start_ms ELSE cs END,
  CASE act WHEN 0 THEN ce WHEN 3 THEN end_ms ELSE greatest(ce, end_ms) END, CASE act WHEN 2 THEN mt WHEN 3 THEN t ELSE ct END,
  used + (act = 2)::INT, CASE act WHEN 2 THEN mine + 1 WHEN 3 THEN 0 ELSE mine END FROM (
  SELECT *, CASE WHEN t = '' THEN 0 WHEN greatest(0, start_ms - ce) > 80 THEN 3
   WHEN {o.ascii_lower('ct')} = {o.ascii_lower('t')} AND greatest(0, start_ms - ce) <= 120 AND length(ct) <= 48 THEN 1
   WHEN ct = '' OR regexp_matches(ct || t, '[\\[\\]]') OR {words('ct')} > 8 OR {words('t')} > 8 OR regexp_matches(t, '^[A-Z]') OR regexp_matches(ct, '[.?!:]$') OR used >= budget THEN 3
   WHEN greatest(1, end_ms - cs) > 6500 OR length(mt) / (greatest(1, end_ms - cs) / 1000.0e0) > 21.0 OR length(mt) > 72 THEN 3
   WHEN {o.repeats(toks)} OR {o.low_function(toks)} OR {grams} THEN 3 ELSE 2 END AS act
  FROM (SELECT *, {o.ascii_tokens('mt')} AS lk, regexp_extract_all(mt, '[A-Za-z'']+') AS rk FROM (SELECT n.recording_id, n.pos, n.start_ms, n.end_ms, n.t, f.head, f.cs, f.ce, f.ct, f.used, f.mine, lim.budget, f.ct || ' ' || n.t AS mt
   FROM f JOIN n ON n.recording_id = f.recording_id AND n.pos = f.pos + 1 JOIN lim ON lim.recording_id = n.recording_id))))
SELECT recording_id, head AS pos, arg_max(cs, f.pos) AS start_ms, arg_max(ce, f.pos) AS end_ms, arg_max(ct, f.pos) AS text, CAST(max(mine) AS BIGINT) AS merges FROM f GROUP BY recording_id, head"""


@query("compact_cues", o.ctes("snippets") + "," + _compact_sql().replace("FROM cues", "FROM snippets"))
def _(spark, sf):
    """Cues cut into pieces of three words, so that many may be joined."""
    return folds.compact_cues(v.snippets(spark, sf)).select(*ID, "start_ms", "end_ms", "text", "merges")


def _variant(suffix: str) -> str:
    """The blocks that lead to ``semantic`` and ``health`` once more, over the table ``cues`` + suffix."""
    names = ["ends", "scenes", "feats", "scored", "title", "incons", "semantic", "health"]
    again = lambda body: re.sub(r"\b(cues|" + "|".join(names) + r")\b", lambda m: m.group(1) + suffix, body)
    return ", ".join(f"{n}{suffix} AS ({again(o.BLOCKS[n][1])})" for n in names)


_NOT_WORSE = o.ctes("cues", "semantic", "health") + "," + _compact_sql().replace("\nSELECT recording_id, head", ",\ncues_c AS (SELECT recording_id, head") + "), " + _variant("_c") + """,
take AS (SELECT s.recording_id FROM semantic s JOIN health h USING (recording_id) JOIN semantic_c t USING (recording_id) JOIN health_c g USING (recording_id)
 WHERE s.cue_count >= 2 AND t.cue_count < s.cue_count AND NOT (t.malformed_ratio > s.malformed_ratio + 2.2e-16 OR t.anomaly_ratio > s.anomaly_ratio + 0.001e0 OR t.adjacent_repeat_ratio > s.adjacent_repeat_ratio + 0.001e0
  OR t.scene_low_ratio > s.scene_low_ratio + 0.002e0 OR g.overlap_ratio > h.overlap_ratio OR g.top_line_ratio > h.top_line_ratio + 0.003e0))
SELECT recording_id, pos, start_ms, end_ms, text, false AS compacted FROM cues WHERE recording_id NOT IN (SELECT recording_id FROM take)
UNION ALL SELECT recording_id, pos, start_ms, end_ms, text, true FROM cues_c WHERE recording_id IN (SELECT recording_id FROM take)"""


@query("compact_if_not_worse", _NOT_WORSE)
def _(spark, sf):
    return selection.compact_if_not_worse(v.cues(spark, sf)).select(*ID, "start_ms", "end_ms", "text", "compacted")


# ===================================================================== selection
@query("worst_scenes", o.ctes("scored") + f""" SELECT recording_id, scene_id, CAST(rank AS INT) AS rank, {s6('score', 'floor')} FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, scene_id) AS rank FROM scored WHERE score < floor) WHERE rank <= 6""")
def _(spark, sf):
    return selection.worst_scenes(scenes.scene_quality(v.cues(spark, sf)), 6).select("recording_id", "scene_id", "rank", *r6("score", "floor"))


@query("worst_source_scenes", o.ctes("source_scored") + f""" SELECT recording_id, scene_id, CAST(rank AS INT) AS rank, {s6('score', 'floor')} FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, scene_id) AS rank FROM source_scored WHERE score < floor) WHERE rank <= 4""")
def _(spark, sf):
    return selection.worst_scenes(scenes.source_scene_quality(v.cues(spark, sf)), 4).select("recording_id", "scene_id", "rank", *r6("score", "floor"))


@query("worst_spans", o.ctes("low_spans") + f""" SELECT recording_id, span_start, span_end, CAST(rank AS INT) AS rank, {s6('score')} FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, span_start) AS rank FROM low_spans WHERE score < floor) WHERE rank <= 8""")
def _(spark, sf):
    spans = confidence.low_confidence_spans(confidence.cue_confidence(v.cues(spark, sf), v.asr_segments(spark, sf)))
    return selection.worst_scenes(spans, 8, tie="span_start").select("recording_id", "span_start", "span_end", "rank", *r6("score"))


@query("order_cues", o.ctes("chunk_cues") + " SELECT recording_id, chunk_index, pos, start_ms FROM chunk_cues")
def _(spark, sf):
    return selection.order_cues(v.chunk_cues(spark, sf)).select("recording_id", "chunk_index", "pos", "start_ms")


@query("arg_min", o.ctes("run_log") + " SELECT input_kind, min(elapsed_secs) AS elapsed_secs, arg_min(plan, (elapsed_secs, run_id)) AS plan FROM run_log GROUP BY 1")
def _(spark, sf):
    return selection.arg_min(v.run_log(spark, sf), ["input_kind"], "elapsed_secs", "run_id", "plan")


@query("arg_max", o.ctes("run_log") + " SELECT input_kind, source_lang, max(elapsed_secs) AS elapsed_secs, arg_min(plan, (-elapsed_secs, run_id)) AS plan FROM run_log GROUP BY 1, 2")
def _(spark, sf):
    return selection.arg_max(v.run_log(spark, sf), ["input_kind", "source_lang"], "elapsed_secs", "run_id", "plan")


@query("splice", o.ctes("cues", "scenes") + """, sp AS (SELECT recording_id, min(pos) AS a, max(pos) + 1 AS b FROM scenes WHERE scene_id % 3 = 2 GROUP BY recording_id, scene_id),
x AS (SELECT c.recording_id, c.pos AS a, 0 AS b, c.start_ms, c.text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.recording_id = c.recording_id AND c.pos >= sp.a AND c.pos < sp.b)
 UNION ALL SELECT recording_id, a, k, CAST(a * 10 + k AS BIGINT), 'new ' || k FROM sp, range(0, 2) t(k))
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a, b) - 1 AS INT) AS pos, start_ms, text FROM x""")
def _(spark, sf):
    """Every third scene is replaced by two rows."""
    c = v.cues(spark, sf)
    spans = scenes.scene_split(c).where("scene_id % 3 = 2").groupBy("recording_id", "scene_id").agg(
        F.min("pos").alias("span_start"), (F.max("pos") + 1).alias("span_end")).drop("scene_id")
    new = spans.select("recording_id", "span_start", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select(
        "recording_id", "span_start", "ord", (F.col("span_start") * 10 + F.col("ord")).cast("bigint").alias("start_ms"),
        F.concat(F.lit("new "), F.col("ord").cast("string")).alias("text"))
    return selection.splice(c.select(*ID, "start_ms", "text"), spans, new)


def _stages(c):
    worse = c.withColumns({"stage": F.lit(1), "text": F.concat("text", F.lit(" wait wait wait wait"))})
    return worse.unionByName(c.withColumn("stage", F.lit(2))).unionByName(
        c.where("recording_id % 4 = 0").withColumns({"stage": F.lit(3), "text": F.lit("the sky is blue")}))


@query("first_passing", o.ctes("cues") + """, cand AS (SELECT recording_id, pos, 1 AS stage, text || ' wait wait wait wait' AS text FROM cues UNION ALL SELECT recording_id, pos, 2, text FROM cues
 UNION ALL SELECT recording_id, pos, 3, 'the sky is blue' FROM cues WHERE recording_id % 4 = 0),""" + _tq_sql("cand", 20, 4, "recording_id, stage") + """
SELECT recording_id, stage, round(coalesce(q, last), 6) AS quality, CASE WHEN stage IS NOT NULL THEN 'accepted' ELSE 'failed' END AS status FROM (
 SELECT recording_id, min(stage) FILTER (ok) AS stage, arg_min(quality, stage) FILTER (ok) AS q, arg_max(quality, stage) AS last FROM (
  SELECT *, quality >= 0.84 OR 0.84 - quality <= 0.015 AS ok FROM tq) GROUP BY 1)""")
def _(spark, sf):
    """Three versions of each document: spoilt, as it is, and for some a flat one."""
    c = v.cues(spark, sf).select(*ID, "text")
    out = selection.first_passing(_stages(c), "strict", min_tokens=20, min_cues=4)
    return out.select("recording_id", "stage", *r6("quality"), "status")


_BETTER = f"""rt AS (SELECT recording_id, pos, CASE WHEN (recording_id + pos) % 3 = 0 THEN 'the cat is on the mat' ELSE text END AS text FROM cues),
ws AS (SELECT recording_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, scene_id) AS rank FROM scored WHERE score < floor) WHERE rank <= 6),
pk AS (SELECT s.recording_id, s.scene_id, s.pos FROM scenes s JOIN ws USING (recording_id, scene_id)),
ft AS (SELECT recording_id, pos, ver, {o.malformed('text')} AS m, {o.low_function('tok')} AS l, {o.repeats('tok')} AS r FROM (SELECT *, {o.ascii_tokens('text')} AS tok FROM (
  SELECT recording_id, pos, 0 AS ver, text FROM cues UNION ALL SELECT recording_id, pos, 1, text FROM rt))),
mm AS (SELECT recording_id, scene_id, ver, count(*) AS n, {o.clamp('1.0e0 - ((avg(m::INT) + avg((r OR l)::INT)) * 1.35e0 + avg(m::INT) * 1.55e0)', '0.0e0', '1.0e0')} AS score,
  avg((m OR l OR r)::INT) * 1.3e0 + avg(m::INT) * 1.5e0 + avg(l::INT) + avg(r::INT) * 1.2e0 AS pen, avg(m::INT) AS mal FROM pk JOIN ft USING (recording_id, pos) GROUP BY 1, 2, 3),
ok AS (SELECT a.recording_id, a.scene_id FROM mm a JOIN mm b USING (recording_id, scene_id) WHERE a.ver = 0 AND b.ver = 1 AND a.n = b.n AND b.score > a.score + 0.01 AND b.pen <= a.pen - 0.01 AND b.mal <= a.mal + 2.2e-16)
SELECT c.recording_id, c.pos, k.recording_id IS NOT NULL AS accepted, CASE WHEN k.recording_id IS NOT NULL THEN rt.text ELSE c.text END AS text FROM cues c JOIN rt USING (recording_id, pos)
LEFT JOIN (SELECT pk.recording_id, pk.pos FROM pk JOIN ok USING (recording_id, scene_id)) k ON k.recording_id = c.recording_id AND k.pos = c.pos"""


@query("accept_better_scenes", o.ctes("cues", "scored", "scenes") + "," + _BETTER)
def _(spark, sf):
    c = v.cues(spark, sf)
    retry = c.select(*ID, F.when((F.col("recording_id") + F.col("pos")) % 3 == 0, "the cat is on the mat").otherwise(F.col("text")).alias("text"))
    return selection.accept_better_scenes(c, retry, 6).select(*ID, "accepted", "text")


def _retry_rows(windows, key):
    """A stand-in retry: two clean cues over the time to be redone."""
    return windows.select(
        "recording_id", key, "redo_from_ms", "redo_to_ms", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select(
        "recording_id", key, "ord",
        (F.col("redo_from_ms") + F.floor((F.col("redo_to_ms") - F.col("redo_from_ms")) * F.col("ord") / 2)).cast("bigint").alias("start_ms"),
        (F.col("redo_from_ms") + F.floor((F.col("redo_to_ms") - F.col("redo_from_ms")) * (F.col("ord") + 1) / 2)).cast("bigint").alias("end_ms"),
        F.concat(F.lit("retry "), F.col("ord").cast("string")).alias("text"))


def _slices_scored(base: str, name: str) -> str:
    """Source scores of the groups (recording_id, g) of a table of cues."""
    return f"""{name} AS (SELECT recording_id, g, n, {o.clamp("""1.0e0 - (coalesce(top, 0)::DOUBLE / n * 1.45e0 + CASE WHEN n > 1 THEN overs::DOUBLE / (n - 1) ELSE 0.0e0 END * 1.35e0
  + (1.0e0 - filled::DOUBLE / n) * 1.6e0 + short::DOUBLE / n * 0.55e0 + tiny::DOUBLE / n * 0.8e0 + dup::DOUBLE / n * 0.95e0)""", '0.0e0', '1.0e0')} AS score FROM (
 SELECT recording_id, g, count(*) AS n, sum((start_ms < coalesce(spe, start_ms))::INT) AS overs, sum((k <> '')::INT) AS filled, sum((end_ms - start_ms < 450)::INT) AS short,
   sum((end_ms - start_ms < 200)::INT) AS tiny, sum((k <> '' AND k = coalesce(pk, ''))::INT) AS dup FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spe, lag(k) OVER (PARTITION BY recording_id, g ORDER BY pos) AS pk
  FROM (SELECT *, lower({o.collapse('text')}) AS k FROM {base})) GROUP BY 1, 2)
 LEFT JOIN (SELECT recording_id, g, max(c) AS top FROM (SELECT recording_id, g, lower({o.collapse('text')}) AS k, count(*) AS c FROM {base} GROUP BY 1, 2, 3) WHERE k <> '' GROUP BY 1, 2) USING (recording_id, g))"""


def _retried(windows: str, before: int, after: int) -> str:
    return f"""rt AS (SELECT recording_id, g, CAST(k AS INT) AS pos, CAST(f + (t - f) * k // 2 AS BIGINT) AS start_ms, CAST(f + (t - f) * (k + 1) // 2 AS BIGINT) AS end_ms, 'retry ' || k AS text
 FROM (SELECT *, greatest(0, s - {before}) AS f, e + {after} AS t FROM {windows}), range(0, 2) r(k))"""


#: Cues with the rows of ``rt`` in place of the spans of ``ok`` (recording_id, g, a, b).
_SPLICED = """x AS (SELECT c.recording_id, c.pos AS a, 0 AS b, c.start_ms, c.end_ms, c.text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.recording_id = c.recording_id AND c.pos >= ok.a AND c.pos < ok.b)
 UNION ALL SELECT ok.recording_id, ok.a, rt.pos, rt.start_ms, rt.end_ms, rt.text FROM ok JOIN rt USING (recording_id, g))
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a, b) - 1 AS INT) AS pos, start_ms, end_ms, text FROM x"""


@query("accept_better_source", o.ctes("cues", "scenes", "source_scored") + """, ws AS (SELECT recording_id, scene_id AS g, score FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, scene_id) AS rank FROM source_scored WHERE score < floor) WHERE rank <= 4),
w AS (SELECT s.recording_id, ws.g, ws.score, min(s.pos) AS a, max(s.pos) + 1 AS b, min(s.start_ms) AS s, max(s.end_ms) AS e FROM scenes s JOIN ws ON ws.recording_id = s.recording_id AND ws.g = s.scene_id GROUP BY 1, 2, 3 HAVING max(s.end_ms) > min(s.start_ms) + 150),
""" + _retried("w", 250, 350) + "," + _slices_scored("rt", "ns") + ", ok AS (SELECT w.* FROM w JOIN ns USING (recording_id, g) WHERE ns.score > w.score + 0.03)," + _SPLICED)
def _(spark, sf):
    c = v.cues(spark, sf)
    retry = _retry_rows(selection.source_retry_spans(c, 4), "scene_id")
    return selection.accept_better_source(c, retry, 4)


def _strict_spans() -> str:
    floor = rules.CONFIDENCE_FLOOR["strict"]
    rows = o.BLOCKS["low_rows"][1].replace("score < 0.50", f"score < {floor}e0").replace("score < 0.58", f"score < {floor}e0 + 0.08e0")
    spans = o.BLOCKS["low_spans"][1].replace("low_rows", "strict_rows").replace("0.5e0 AS floor", f"{floor}e0 AS floor")
    return f"strict_rows AS ({rows}), strict_spans AS ({spans})"


@query("accept_better_spans", o.ctes("cues", "cue_conf") + "," + _strict_spans() + """, ws AS (SELECT recording_id, span_start AS g, span_end, score FROM (
 SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY floor - score DESC, span_start) AS rank FROM strict_spans WHERE score < floor) WHERE rank <= 8),
hr AS (SELECT c.*, ws.g FROM cues c JOIN ws ON ws.recording_id = c.recording_id AND c.pos >= ws.g AND c.pos < ws.span_end),
w AS (SELECT ws.recording_id, ws.g, ws.score, ws.g AS a, ws.span_end AS b, min(start_ms) AS s, max(end_ms) AS e FROM ws JOIN hr USING (recording_id, g) GROUP BY 1, 2, 3, 4, 5 HAVING max(end_ms) > min(start_ms) + 100),
""" + _retried("w", 300, 400) + "," + _slices_scored("rt", "ns") + "," + _slices_scored("hr", "os") + """,
ok AS (SELECT w.* FROM w JOIN ns USING (recording_id, g) JOIN os USING (recording_id, g) WHERE 0.9e0 - w.score > 0.06e0 AND ns.score - os.score > 0),""" + _SPLICED)
def _(spark, sf):
    c = v.cues(spark, sf)
    scored = confidence.cue_confidence(c, v.asr_segments(spark, sf))
    spans = confidence.low_confidence_spans(scored, "strict")
    retry = _retry_rows(selection.confidence_retry_windows(c, spans), "span_start").withColumns({
        "score": F.lit(0.9), "compression_ratio": F.lit(1.0), "low_word_prob_ratio": F.lit(0.0)})
    return selection.accept_better_spans(c, spans, retry, 8)


@query("enforce_gate", o.ctes("semantic") + """ SELECT recording_id, CASE WHEN anomaly_ratio >= 0.35 OR malformed_ratio >= 0.25 OR low_function_ratio >= 0.35 OR adjacent_repeat_ratio >= 0.30
 OR scene_low_ratio >= 0.45 OR name_inconsistency >= 0.20 THEN 'warned' ELSE 'passed' END AS status FROM semantic""")
def _(spark, sf):
    c = v.cues(spark, sf)
    gate = quality.semantic_gate(quality.semantic_health(c), "fast")
    return selection.enforce_gate(c.select("recording_id").distinct(), gate, "fast")


# =================================================================== whole paths
def _echo(texts, before, after, tags):
    """Stands for a model: the text, spaced out and closed with a stop."""
    return [f"  {t} ." for t in texts]


@query("process")
def _(spark, sf):
    return process.process(v.cues(spark, sf), _echo)[0].select(*ID, "text", "status")


@query("plan_recordings")
def _(spark, sf):
    rec = v.recordings(spark, sf)
    return process.plan_recordings(intervals.complement(v.speech(spark, sf), rec, min_ms=400), rec)


# ======================================================================= run log
@query("knowledge_snapshot", o.ctes("run_log") + """, k AS (SELECT *, concat('cpu', CASE WHEN cpu_cores <= 4 THEN 4 WHEN cpu_cores <= 8 THEN 8 WHEN cpu_cores <= 12 THEN 12 WHEN cpu_cores <= 16 THEN 16 WHEN cpu_cores <= 24 THEN 24 ELSE 32 END,
  '-ram', CAST(ceil(total_ram_mb / 2048) * 2048 AS BIGINT), '-gpu', gpu_backend, '-vram', CAST(ceil(gpu_vram_mb / 1024) * 1024 AS BIGINT)) AS device FROM run_log),
u AS (SELECT 'device' AS kind, device AS key, * FROM k UNION ALL SELECT 'language_pair', lower(source_lang) || '->' || lower(target_lang), * FROM k UNION ALL SELECT 'content_kind', input_kind, * FROM k)
SELECT kind, key, count(*) AS runs, round(avg(success::INT), 6) AS success_rate, round(avg(elapsed_secs), 6) AS avg_elapsed_secs, round(min(elapsed_secs) FILTER (success), 6) AS best_elapsed_secs,
 arg_min(plan, (elapsed_secs, ts, run_id)) FILTER (success) AS best_plan, round(coalesce(avg(audio_duration_secs), 0), 6) AS avg_duration_secs,
 round(avg(elapsed_secs) / avg(audio_duration_secs) * 3600, 6) AS avg_elapsed_per_audio_hour, round(avg(avg_difficulty), 6) AS avg_difficulty, round(avg(scene_count), 6) AS avg_scene_count FROM u GROUP BY 1, 2""")
def _(spark, sf):
    out = runs.knowledge_snapshot(v.run_log(spark, sf))
    nums = ["success_rate", "avg_elapsed_secs", "best_elapsed_secs", "avg_duration_secs", "avg_elapsed_per_audio_hour", "avg_difficulty", "avg_scene_count"]
    return out.select("kind", "key", "runs", "best_plan", *r6(*nums))


@query("run_keys", o.ctes("run_log") + """ SELECT run_id, concat('cpu', CASE WHEN cpu_cores <= 4 THEN 4 WHEN cpu_cores <= 8 THEN 8 WHEN cpu_cores <= 12 THEN 12 WHEN cpu_cores <= 16 THEN 16 WHEN cpu_cores <= 24 THEN 24 ELSE 32 END,
  '-ram', CAST(ceil(total_ram_mb / 2048) * 2048 AS BIGINT), '-gpu', gpu_backend, '-vram', CAST(ceil(gpu_vram_mb / 1024) * 1024 AS BIGINT)) AS device_key FROM run_log""")
def _(spark, sf):
    """Half of the records carry their figures only in the fingerprint."""
    log = v.run_log(spark, sf)
    fp = F.concat(F.lit("cpu"), F.col("cpu_cores").cast("string"), F.lit("-ram"), F.col("total_ram_mb").cast("string"), F.lit("-gpu"),
                  F.col("gpu_backend"), F.lit("-vram"), F.col("gpu_vram_mb").cast("string"))
    half = F.col("run_id") % 2 == 0
    log = log.withColumn("device_fingerprint", fp)
    log = log.withColumns({c: F.when(half, F.col(c)) for c in ("cpu_cores", "total_ram_mb", "gpu_backend", "gpu_vram_mb")})
    return runs.run_keys(log).select("run_id", "device_key")


@query("latest_runs", o.ctes("history") + " SELECT run_id, ts FROM history")
def _(spark, sf):
    return runs.latest_runs(v.run_log(spark, sf)).select("run_id", "ts")


@query("append_run", o.ctes("run_log") + " SELECT run_id FROM (SELECT run_id, ts FROM run_log UNION ALL SELECT run_id + 1000000000, ts FROM run_log WHERE run_id % 5 = 0) ORDER BY ts DESC, run_id DESC LIMIT 400")
def _(spark, sf):
    log = v.run_log(spark, sf)
    new = log.where("run_id % 5 = 0").withColumn("run_id", F.col("run_id") + 1_000_000_000)
    return runs.append_run(log, new).select("run_id")


@query("stored_run_log", o.ctes("run_log") + " SELECT run_id, plan, round(elapsed_secs, 6) AS elapsed_secs FROM (SELECT * FROM run_log WHERE run_id % 3 = 0 ORDER BY ts DESC, run_id DESC LIMIT 1000) UNION ALL SELECT run_id, plan, round(elapsed_secs, 6) FROM run_log WHERE run_id % 3 <> 0")
def _(spark, sf):
    """A third of the log is appended and compacted, the rest appended later, in two commits, one of them twice."""
    log, rows = RunLog(spark, scratch(spark, "run_log")), v.run_log(spark, sf)
    log.append(rows.where("run_id % 3 = 0"), "first")
    log.compact(1000)
    for k, token in ((1, "second"), (2, "third"), (1, "second")):
        log.append(rows.where(f"run_id % 3 = {k}"), token)
    return log.read().select("run_id", "plan", *r6("elapsed_secs"))


@query("run_quality_gate", o.ctes("run_log") + " SELECT run_id FROM run_log WHERE output_non_empty_ratio >= 0.80 AND (output_cues < 80 OR output_top_line_ratio <= 0.30)")
def _(spark, sf):
    return runs.run_quality_gate(v.run_log(spark, sf)).select("run_id")


_EXACT = """ex AS (SELECT q.query_id, arg_min(u.run_id, (u.elapsed_secs, u.ts, u.run_id)) AS run_id, arg_min(u.plan, (u.elapsed_secs, u.ts, u.run_id)) AS plan, min(u.elapsed_secs) AS elapsed_secs
 FROM run_queries q JOIN usable u ON q.device_fingerprint = u.device_fingerprint AND q.source_lang = u.source_lang AND q.target_lang = u.target_lang AND q.input_kind = u.input_kind
 AND q.quality_profile = u.quality_profile AND q.content_profile_hash = u.content_profile_hash GROUP BY 1)"""
_NEAR = """pr AS (SELECT q.query_id, u.run_id, u.plan, u.ts, CASE WHEN u.audio_duration_secs > 0 THEN u.elapsed_secs / (u.audio_duration_secs / 3600) ELSE u.elapsed_secs END
  + CASE WHEN u.content_profile_hash <> q.content_profile_hash THEN 45.0e0 ELSE 0.0e0 END + coalesce(abs(u.avg_difficulty - q.avg_difficulty) * 320, 25.0e0)
  + coalesce(abs(u.scene_count - q.scene_count)::DOUBLE / (CASE WHEN q.scene_count IS NULL THEN NULL ELSE greatest(u.scene_count, q.scene_count, 1) END) * 180, 20.0e0)
  + coalesce(CASE WHEN u.gpu_vram_mb > q.vram_mb THEN (u.gpu_vram_mb - q.vram_mb) / 256.0e0 * 8 ELSE -(CASE WHEN q.vram_mb IS NULL THEN NULL ELSE least(20.0e0, (q.vram_mb - u.gpu_vram_mb) / 1024.0e0) END) END, 0.0e0) AS score
 FROM run_queries q JOIN usable u ON q.source_lang = u.source_lang AND q.target_lang = u.target_lang AND q.input_kind = u.input_kind AND q.quality_profile = u.quality_profile
 AND coalesce(q.backend, 'none') = u.gpu_backend AND coalesce(u.gpu_vram_mb <= (q.vram_mb * 6) // 5, true)),
nr AS (SELECT query_id, arg_min(run_id, (score, ts, run_id)) AS run_id, arg_min(plan, (score, ts, run_id)) AS plan, min(score) AS score FROM pr GROUP BY 1)"""


@query("best_run_exact", o.ctes("usable", "run_queries") + "," + _EXACT + " SELECT query_id, run_id, plan, round(elapsed_secs, 6) AS elapsed_secs FROM ex")
def _(spark, sf):
    return runs.best_run_exact(v.run_queries(spark, sf), v.run_log(spark, sf)).select("query_id", "run_id", "plan", *r6("elapsed_secs"))


@query("best_run_similar", o.ctes("usable", "run_queries") + "," + _NEAR + " SELECT query_id, run_id, plan, round(score, 6) AS score FROM nr")
def _(spark, sf):
    return runs.best_run_similar(v.run_queries(spark, sf), v.run_log(spark, sf)).select("query_id", "run_id", "plan", *r6("score"))


@query("best_run", o.ctes("usable", "run_queries") + "," + _EXACT + "," + _NEAR + """ SELECT query_id, run_id, plan, 'exact' AS matched FROM ex
UNION ALL SELECT query_id, run_id, plan, 'similar' FROM nr WHERE query_id NOT IN (SELECT query_id FROM ex)""")
def _(spark, sf):
    return runs.best_run(v.run_queries(spark, sf), v.run_log(spark, sf))


@query("predicted_secs", o.ctes("cues") + " SELECT recording_id, pos, round(greatest(8.0e0, greatest(1.0e0, (end_ms - start_ms) / 1000.0e0) / 0.8e0), 6) AS predicted_secs FROM cues")
def _(spark, sf):
    return runs.predicted_secs(v.cues(spark, sf), "strict", gpu=False).select(*ID, *r6("predicted_secs"))


# ================================================================== chunk events
_STATE = """d AS (SELECT run_id, chunk_index, max((ts, event_id)) FILTER (success) AS da, max((ts, event_id)) FILTER (NOT success) AS fa,
 arg_max(event_id, (ts, event_id)) FILTER (success) AS de, arg_max(event_id, (ts, event_id)) FILTER (NOT success) AS fe FROM chunk_events GROUP BY 1, 2),
st AS (SELECT run_id, chunk_index, coalesce(de, fe) AS event_id, de IS NOT NULL AS success, fa IS NOT NULL AND (da IS NULL OR fa > da) AS also_failed, fe FROM d)"""


@query("upsert_latest", o.ctes("chunk_events") + "," + _STATE + " SELECT run_id, chunk_index, event_id, success, also_failed FROM st")
def _(spark, sf):
    return runs.upsert_latest(v.chunk_events(spark, sf)).select("run_id", "chunk_index", "event_id", "success", "also_failed")


@query("checkpoint_summary", o.ctes("chunk_events") + "," + _STATE + " SELECT run_id, CAST(sum(success::INT) AS BIGINT) AS completed_chunks, CAST(sum(also_failed::INT) AS BIGINT) AS failed_chunks FROM st GROUP BY 1")
def _(spark, sf):
    return runs.checkpoint_summary(v.chunk_events(spark, sf))


@query("recovery_events", o.ctes("chunk_events") + "," + _STATE + " SELECT st.run_id, st.chunk_index, e.reason, 'chunk_failure' AS event FROM st JOIN chunk_events e ON e.event_id = st.fe WHERE also_failed")
def _(spark, sf):
    return runs.recovery_events(v.chunk_events(spark, sf))


_MONITOR = o.ctes("chunk_events") + """, s AS (SELECT *, actual_secs - coalesce(lag(actual_secs) OVER c, 0) AS da, predicted_secs - coalesce(lag(predicted_secs) OVER c, 0) AS dp,
  (row_number() OVER c = 1)::INT AS dn FROM chunk_events WHERE success WINDOW c AS (PARTITION BY run_id, chunk_index ORDER BY ts, event_id)),
m AS (SELECT *, sum(da) OVER r AS a, sum(dp) OVER r AS p, sum(dn) OVER r AS n FROM s WINDOW r AS (PARTITION BY run_id ORDER BY ts, event_id))
SELECT run_id, chunk_index, event_id, CAST(n AS BIGINT) AS completed, round(greatest(0.0e0, 1000 - p) * greatest(0.05e0, a / p), 4) AS eta_secs,
 NOT from_cache AND actual_secs > predicted_secs * 2 AS slow, quality_score < 0.65 AS low_quality FROM m"""


@query("chunk_monitor", _MONITOR)
def _(spark, sf):
    e = v.chunk_events(spark, sf)
    totals = e.select("run_id").distinct().withColumn("total_predicted_secs", F.lit(1000.0))
    out = monitor.chunk_monitor(e, totals)
    return out.select("run_id", "chunk_index", "event_id", "completed", F.round("eta_secs", 4).alias("eta_secs"), "slow", "low_quality")


@query("adaptive_policy", o.ctes("chunk_events") + """, ev AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS i, success AND NOT from_cache AND actual_secs > predicted_secs * 2 AS slow,
  NOT success OR quality_score < 0.65 AS low, NOT success AND contains(lower(reason), 'timed out') AS late FROM chunk_events),
r AS (SELECT run_id, 0 AS i, 1.0e0 AS scale, 0 AS extra, false AS strict FROM (SELECT DISTINCT run_id FROM ev)
 UNION ALL SELECT run_id, i, CASE WHEN late THEN greatest(1.0e0, least(4.0e0, s1 * 1.35e0)) ELSE s1 END, CASE WHEN late THEN least(e2 + 1, 3) ELSE e2 END, low FROM (
  SELECT r.run_id, ev.i, ev.late, ev.low, greatest(1.0e0, least(3.0e0, r.scale * CASE WHEN ev.slow THEN 1.20e0 ELSE 0.98e0 END)) AS s1,
   CASE WHEN ev.low THEN greatest(CASE WHEN ev.slow THEN least(r.extra + 1, 2) ELSE r.extra END, 1) ELSE CASE WHEN ev.slow THEN least(r.extra + 1, 2) ELSE r.extra END END AS e2
  FROM r JOIN ev ON ev.run_id = r.run_id AND ev.i = r.i + 1))
SELECT run_id, round(arg_max(scale, i), 6) AS timeout_scale, arg_max(extra, i) AS extra_retry_budget, arg_max(strict, i) AS strict_first_pass FROM r GROUP BY 1""")
def _(spark, sf):
    return monitor.adaptive_policy(v.chunk_events(spark, sf)).select("run_id", *r6("timeout_scale"), "extra_retry_budget", "strict_first_pass")


# ============================================================= sources and sinks
_SRT = """WITH b AS (SELECT doc_id, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INT) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT *, '00:' || lpad(CAST(i * 2 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i * 2 % 60 AS VARCHAR), 2, '0') || ',250' AS a,
 CASE WHEN i % 9 = 8 THEN i * 2 - 1 ELSE i * 2 + 1 END AS e FROM b),
s AS (SELECT doc_id, i, line, a || ' --> 00:' || lpad(CAST(e // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') || ',250' AS timing, e FROM c)"""


@query("read_srt", _SRT + " SELECT doc_id, i AS pos, i + 1 AS idx, timing, rtrim(line) AS text FROM s")
def _(spark, sf):
    """Every document printed as a subtitle file, some blocks without an index line."""
    return srt.srt_text_to_cues(v.srt_texts(spark, sf), ["doc_id"], "srt").select("doc_id", "pos", "idx", "timing", "text")


@query("read_srt_lenient", _SRT + """ SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, CAST(least(i * 2, e) * 1000 + 250 AS BIGINT) AS start_ms,
 CAST(greatest(i * 2, e) * 1000 + 250 AS BIGINT) AS end_ms, trim(line) AS text FROM s WHERE i % 5 <> 4""")
def _(spark, sf):
    """Blocks without an index line have too few lines for this reader."""
    out = srt.srt_text_to_cues(v.srt_texts(spark, sf, whole=True), ["doc_id"], "srt", "lenient")
    return out.select("doc_id", "pos", "start_ms", "end_ms", "text")


@query("srt_rejects", "SELECT doc_id, 'missing timing line' AS reason FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'no cues' FROM documents WHERE doc_id % 3 = 1")
def _(spark, sf):
    broken = v.srt_texts(spark, sf).withColumn("srt", F.expr("CASE doc_id % 3 WHEN 0 THEN concat(srt, '\\n\\n17\\n\\n') WHEN 1 THEN '\\n \\n\\n' ELSE srt END"))
    return srt.srt_rejects(broken, ["doc_id"], "srt")


@query("srt_blocks", o.ctes("cues") + f" SELECT recording_id, pos, (pos + 1) || chr(10) || {o.clock('start_ms')} || ' --> ' || {o.clock('end_ms')} || chr(10) || rtrim(text) || chr(10) AS block FROM cues")
def _(spark, sf):
    return srt.srt_blocks(v.cues(spark, sf))


@query("write_srt", o.ctes("cues") + " SELECT recording_id, pos, pos + 1 AS idx, start_ms, end_ms, rtrim(text) AS text FROM cues")
def _(spark, sf):
    """Cues written as files and read back."""
    path = scratch(spark, "srt")
    srt.write_srt(v.cues(spark, sf), path)
    back = srt.read_srt(spark, path, folders=True).withColumn(
        "recording_id", F.regexp_extract("recording_id", r"recording_id=(\d+)", 1).cast("bigint"))
    return timing.parse_timing(back).select(*ID, "idx", "start_ms", "end_ms", "text")


@query("store_srt", o.ctes("cues") + " SELECT recording_id, pos, pos + 1 AS idx, start_ms, end_ms, CASE WHEN recording_id % 4 = 0 THEN 'second text' ELSE rtrim(text) END AS text FROM cues")
def _(spark, sf):
    """All recordings in a few bucket files, a quarter of them written anew by a second batch, and read back by the manifest."""
    store, c = TextStore(spark, scratch(spark, "srt_store"), buckets=8), v.cues(spark, sf)
    srt.store_srt(c, store, "first")
    srt.store_srt(c.where("recording_id % 4 = 0").withColumn("text", F.lit("second text")), store, "second")
    srt.store_srt(c, store, "first")
    return timing.parse_timing(srt.stored_srt(store)).select(*ID, "idx", "start_ms", "end_ms", "text")


@query("read_asr_segments", o.ctes("asr_segments") + """ SELECT recording_id, start_ms, end_ms, round(CASE WHEN pos % 5 = 1 THEN -1.5e0 ELSE avg_logprob END, 6) AS avg_logprob, no_speech_prob, compression_ratio,
 round(CASE WHEN pos % 4 = 2 THEN 0.0e0 ELSE (word_prob_mean + low_word_prob_ratio) / 2 END, 6) AS word_prob_mean,
 CASE WHEN pos % 4 = 2 THEN 0.0e0 ELSE ((word_prob_mean < 0.45)::INT + (low_word_prob_ratio < 0.45)::INT) / 2.0e0 END AS low_word_prob_ratio FROM asr_segments WHERE pos % 6 <> 5""")
def _(spark, sf):
    """Segments printed as JSON by chunk of the recording, with missing fields and bad times."""
    s = v.asr_segments(spark, sf)
    words = F.when(F.col("pos") % 4 != 2, F.array(
        F.struct(F.col("word_prob_mean").alias("probability")), F.struct(F.lit(None).cast("double").alias("probability")),
        F.struct(F.col("low_word_prob_ratio").alias("probability"))))
    one = F.struct(
        (F.col("start_ms") / 1000).alias("start"), F.when(F.col("pos") % 6 == 5, F.col("start_ms") / 1000).otherwise(F.col("end_ms") / 1000).alias("end"),
        F.when(F.col("pos") % 5 != 1, F.col("avg_logprob")).alias("avg_logprob"), "no_speech_prob", "compression_ratio", words.alias("words"))
    docs = s.groupBy("recording_id", F.floor(F.col("pos") / 50).alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("segments"))).alias("json"))
    out = asr.asr_text_to_segments(docs, ["recording_id"])
    return out.select("recording_id", "start_ms", "end_ms", *r6("avg_logprob"), "no_speech_prob", "compression_ratio", *r6("word_prob_mean"), "low_word_prob_ratio")


_CHUNKED = """cs AS (SELECT recording_id, CAST(start_ms // 30000 AS INT) AS chunk_index, pos, start_ms % 30000 AS s, end_ms - (start_ms // 30000) * 30000 AS e, avg_logprob, no_speech_prob, compression_ratio,
 start_ms, end_ms FROM asr_segments)"""


def _chunk_segments(spark, sf):
    return v.asr_segments(spark, sf).selectExpr(
        "recording_id", "CAST(floor(start_ms / 30000) AS INT) AS chunk_index", "start_ms % 30000 AS start_ms",
        "end_ms - CAST(floor(start_ms / 30000) AS BIGINT) * 30000 AS end_ms", "avg_logprob", "no_speech_prob", "compression_ratio")


@query("merge_chunk_segments", o.ctes("asr_segments") + " SELECT recording_id, start_ms, end_ms, round(avg_logprob, 6) AS avg_logprob, no_speech_prob, compression_ratio FROM asr_segments")
def _(spark, sf):
    segs = _chunk_segments(spark, sf)
    out = asr.merge_chunk_segments(segs, v.chunk_offsets(segs))
    return out.select("recording_id", "start_ms", "end_ms", *r6("avg_logprob"), "no_speech_prob", "compression_ratio")


@query("segments_json", o.ctes("asr_segments") + """ SELECT recording_id, round(start_ms / 1000.0e0, 6) AS start_s, round(end_ms / 1000.0e0, 6) AS end_s, round(avg_logprob, 6) AS avg_logprob,
 round(no_speech_prob, 6) AS no_speech_prob, round(compression_ratio, 6) AS compression_ratio,
 true AS in_order FROM asr_segments""")
def _(spark, sf):
    """The printed lines, read again; ``in_order``: a line's number is not below the number of segments that start earlier."""
    segs = _chunk_segments(spark, sf)
    lines = asr.segments_json(asr.merge_chunk_segments(segs, v.chunk_offsets(segs)))
    read = lines.select("recording_id", "n", F.from_json("json", asr.SEGMENT).alias("s"))
    earlier = F.rank().over(Window.partitionBy("recording_id").orderBy("s.start")) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy("recording_id", "s.start"))
    return read.withColumn("in_order", (F.col("n") >= earlier) & (F.col("n") < earlier + equal)).select(
        "recording_id", F.round("s.start", 6).alias("start_s"), F.round("s.end", 6).alias("end_s"),
        *[F.round(f"s.{c}", 6).alias(c) for c in ("avg_logprob", "no_speech_prob", "compression_ratio")], "in_order")


@query("read_silence_log", o.ctes("gaps") + ", m AS (SELECT * FROM gaps) SELECT recording_id, start_ms, end_ms FROM m")
def _(spark, sf):
    """Silences printed as a detector's log lines, the last of each recording left open."""
    rec = v.recordings(spark, sf)
    gaps = intervals.complement(v.speech(spark, sf), rec).join(rec, "recording_id")
    start = F.concat(F.lit("[detect] silence_start: "), (F.col("start_ms") / 1000).cast("decimal(20,3)").cast("string"))
    end = F.concat(F.lit("[detect] silence_end: "), (F.col("end_ms") / 1000).cast("decimal(20,3)").cast("string"), F.lit(" | silence_duration: 1"))
    lines = gaps.select("recording_id", "start_ms", F.posexplode(F.array_compact(F.array(
        start, F.lit("frame= 12"), F.when(F.col("end_ms") < F.col("duration_ms"), end)))).alias("k", "line"))
    out = silence.silence_from_lines(lines, rec, order=["start_ms", "k"], block=intervals.time_block())
    return out


@query("quality_report", o.ctes("semantic", "health") + f""", j AS (SELECT s.*, h.top_line_ratio, h.overlap_ratio, h.non_empty_ratio, anomaly_ratio >= 0.25 OR malformed_ratio >= 0.15 OR low_function_ratio >= 0.22
 OR adjacent_repeat_ratio >= 0.18 OR scene_low_ratio >= 0.30 OR name_inconsistency >= 0.12 AS bad FROM semantic s JOIN health h USING (recording_id))
SELECT recording_id, cue_count, scene_count, {s6('top_line_ratio', 'overlap_ratio', 'non_empty_ratio', *quality.SEMANTIC)}, NOT bad AS passed, (scene_low_ratio > 0)::INT + (name_inconsistency > 0)::INT + (malformed_ratio > 0)::INT AS warnings FROM j""")
def _(spark, sf):
    out = report.quality_report(v.cues(spark, sf))
    count = F.when(F.col("warnings") == "", 0).otherwise(F.size(F.split("warnings", ", ")))
    return out.select("recording_id", "cue_count", "scene_count", *r6("top_line_ratio", "overlap_ratio", "non_empty_ratio", *quality.SEMANTIC), "passed", count.alias("warnings"))


@query("report_recovery", o.ctes("cues", "chunk_events") + "," + _STATE + """, dd AS (SELECT DISTINCT recording_id FROM cues)
SELECT recording_id, 0 AS line, coalesce(ok, 0)::BIGINT AS completed, coalesce(bad, 0)::BIGINT AS failed, NULL AS reason FROM dd
 LEFT JOIN (SELECT run_id AS recording_id, sum(success::INT) AS ok, sum(also_failed::INT) AS bad FROM st GROUP BY 1) USING (recording_id)
UNION ALL SELECT st.run_id, -1 - st.chunk_index, NULL, NULL, e.reason FROM st JOIN dd ON dd.recording_id = st.run_id JOIN chunk_events e ON e.event_id = st.fe WHERE also_failed""")
def _(spark, sf):
    """The checkpoint section of each report, and the lines of chunks that stand as failed, read again."""
    out = report.report_json(v.cues(spark, sf), events=v.chunk_events(spark, sf).withColumnRenamed("run_id", "recording_id"))
    read = F.from_json("json", "checkpoint struct<completed_chunks:bigint,failed_chunks:bigint>, chunk int, reason string")
    kept = out.where("line <= 0").select("recording_id", "line", read.alias("r"))
    return kept.select(
        "recording_id", F.col("line").cast("int").alias("line"), F.col("r.checkpoint.completed_chunks").alias("completed"), F.col("r.checkpoint.failed_chunks").alias("failed"),
        F.col("r.reason").alias("reason"))


@query("report_json", o.ctes("scored", "semantic") + f""" SELECT recording_id, scene_id AS line, n AS cues, round(score, 6) AS score, round(floor, 6) AS floor, score >= floor AS passed FROM scored
UNION ALL SELECT recording_id, 0, cue_count, round(anomaly_ratio, 6), round(malformed_ratio, 6), NOT (anomaly_ratio >= 0.25 OR malformed_ratio >= 0.15 OR low_function_ratio >= 0.22
 OR adjacent_repeat_ratio >= 0.18 OR scene_low_ratio >= 0.30 OR name_inconsistency >= 0.12) FROM semantic""")
def _(spark, sf):
    """The printed lines, read again: scenes, and of the report two ratios and the verdict."""
    out = report.report_json(v.cues(spark, sf))
    scene = F.from_json("json", "scene bigint, cue_count bigint, score double, floor double, pass boolean")
    whole = F.from_json("json", "quality struct<cue_count:bigint,semantic:struct<anomaly_ratio:double,malformed_ratio:double>>, verdict struct<pass:boolean>")
    read = out.select("recording_id", "line", scene.alias("s"), whole.alias("w"))
    first = F.col("line") == 0
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return read.select(
        "recording_id", "line", pick("w.quality.cue_count", "s.cue_count").alias("cues"),
        F.round(pick("w.quality.semantic.anomaly_ratio", "s.score"), 6).alias("score"),
        F.round(pick("w.quality.semantic.malformed_ratio", "s.floor"), 6).alias("floor"), pick("w.verdict.pass", "s.pass").alias("passed"))


@query("pending", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def _(spark, sf):
    pages = v.table(spark, sf, "pages")
    inputs = pages.select("page_id", F.concat("url", F.lit(".mkv")).alias("path"))
    done = files.output_name(inputs.where("page_id % 3 = 0"), "en").select("output")
    return files.pending(inputs, done).select("page_id")


@query("resolve_source", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'given' WHEN doc_id % 3 = 0 THEN 'chunked_asr' WHEN doc_id % 5 = 0 THEN 'asr' END AS kind,
 CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'ok' WHEN doc_id % 7 = 0 THEN 'sidecar refused' ELSE 'no source' END AS status FROM documents""")
def _(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id")
    kinds = F.array_compact(F.array(
        F.when(F.col("doc_id") % 7 == 0, "sidecar"), F.when(F.col("doc_id") % 5 == 0, "asr"), F.lit("previous"),
        F.when(F.col("doc_id") % 3 == 0, "chunked_asr"), F.when(F.col("doc_id") % 2 == 0, "given")))
    c = d.select("doc_id", F.explode(kinds).alias("kind")).withColumn("uri", F.concat("kind", F.lit("/x.srt")))
    return files.resolve_source(c, "strict", keys=["doc_id"]).select("doc_id", "kind", "status")


@query("flag_placeholder", "SELECT doc_id, contains(lower(CASE WHEN doc_id % 4 = 0 THEN concat(substr(text, 1, doc_id * 30), 'AI Processing...', text) ELSE text END), 'ai processing...') AS placeholder FROM documents")
def _(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("text", F.expr(
        "CASE WHEN doc_id % 4 = 0 THEN concat(substr(text, 1, CAST(doc_id * 30 AS INT)), 'AI Processing...', text) ELSE text END"))
    return files.flag_placeholder(d).select("doc_id", "placeholder")


# ===================================================================== streaming
@query("live_scenes", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM g GROUP BY user_id, s
HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    """User sessions with a gap of 20 minutes, from the event stream: those that have closed."""
    s = live.live_scenes(v.event_stream(spark, sf), ["user_id"], gap="20 minutes", watermark="1 hour")
    return live.run_to_table(s, spark, "live-scenes").select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("live_dedup", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    """Rows left of each user and event type: the table is one micro-batch, so exactly one."""
    s = live.live_dedup(v.event_stream(spark, sf), ["user_id", "event_type"], watermark="10 minutes")
    out = live.run_to_table(s.select("user_id", "event_type"), spark, "live-dedup")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("live_chunk_monitor", _MONITOR)
def _(spark, sf):
    """The monitor over the events as a stream."""
    totals = v.chunk_events(spark, sf).select("run_id").distinct().withColumn("total_predicted_secs", F.lit(1000.0))
    out = live.run_to_table(live.live_chunk_monitor(v.event_stream(spark, sf).selectExpr(*v.CHUNK_EVENT_COLS), totals), spark, "live-chunks")
    return out.select("run_id", "chunk_index", "event_id", "completed", F.round("eta_secs", 4).alias("eta_secs"), "slow", "low_quality")


@query("live_monitor", o.ctes("chunk_events") + "," + _STATE + """ SELECT s.run_id, e.n AS events, sum(s.success::INT)::BIGINT AS completed FROM st s
 JOIN (SELECT run_id, count(*) AS n FROM chunk_events GROUP BY 1) e USING (run_id) GROUP BY 1, 2""")
def _(spark, sf):
    s = v.event_stream(spark, sf).selectExpr(*v.CHUNK_EVENT_COLS)
    out = live.run_to_table(live.live_monitor(s), spark, "live-monitor", "update")
    last = out.groupBy("run_id").agg(F.max_by(F.struct("events", "completed"), "batch_id").alias("m"))
    return last.select("run_id", "m.events", "m.completed")
