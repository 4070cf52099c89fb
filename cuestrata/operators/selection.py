"""Quality gates, top scenes, and choosing between versions of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions import text as T
from cuestrata.operators.confidence import mean_confidence
from cuestrata.operators.folds import compact_cues
from cuestrata.operators.ordered import number_rows, one_pass
from cuestrata.operators.quality import (
    defect_ratios, feature_table, semantic_health, semantic_penalty, structural_gate, structural_health, translation_quality)
from cuestrata.operators.scenes import clamp, scene_quality, scene_split, score_source, source_scene_quality
from cuestrata.session import stage

KEYS = ["recording_id"]


# ------------------------------------------------------------------ top-k, argmin
def worst_scenes(scored: DataFrame, k: int | None, keys: list[str] = KEYS, tie: str = "scene_id") -> DataFrame:
    """The ``k`` scenes furthest below their floor, per recording; all of them, without ``rank``, if ``k`` is None.

    Spark keeps ``k`` rows per recording and task before it shuffles them.
    """
    order = Window.partitionBy(*keys).orderBy((F.col("floor") - F.col("score")).desc(), tie)
    low = scored.where(F.col("score") < F.col("floor"))
    if k is None:
        return low
    return low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def order_cues(df: DataFrame, keys: list[str] = KEYS, by=("start_ms", "chunk_index", "pos")) -> DataFrame:
    """Global order for writing: recording, then the given columns."""
    return df.orderBy(*keys, *[c for c in by if c in df.columns])


def arg_min(df: DataFrame, keys: list[str], metric: str, tie: str, what: str) -> DataFrame:
    """``what`` at the smallest (metric, tie) of each group."""
    return df.groupBy(*keys).agg(
        F.min(metric).alias(metric), F.min_by(what, F.struct(metric, tie)).alias(what))


def arg_max(df: DataFrame, keys: list[str], metric: str, tie: str, what: str) -> DataFrame:
    """``what`` at the largest metric of each group, smallest tie first."""
    return df.groupBy(*keys).agg(
        F.max(metric).alias(metric), F.min_by(what, F.struct((-F.col(metric)).alias("m"), F.col(tie).alias("t"))).alias(what))


# --------------------------------------------------------------------- splicing
def splice(cues: DataFrame, spans: DataFrame, replacement: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Put ``replacement`` rows in place of the cues in [span_start, span_end).

    Spans of a recording are disjoint.  ``replacement`` has (keys, span_start, ord, ...)
    and may have any number of rows.  Positions are renumbered from 0.
    """
    payload = [c for c in cues.columns if c not in {*keys, "pos"}]
    held = spans.select(*keys, "span_start", F.explode(
        F.sequence(F.col("span_start"), F.col("span_end") - 1)).alias("pos"))
    kept = cues.join(held.select(*keys, "pos"), [*keys, "pos"], "left_anti").select(
        *keys, F.col("pos").alias("__a"), F.lit(0).alias("__b"), *payload)
    new = replacement.join(spans.select(*keys, "span_start"), [*keys, "span_start"], "left_semi").select(
        *keys, F.col("span_start").alias("__a"), F.col("ord").alias("__b"), *payload)
    # several rows may share __a, so blocks follow the old position and stay small
    out = number_rows(kept.unionByName(new), keys, ["__a", "__b"], "pos", F.floor(F.col("__a") / 1024))
    return out.select(*keys, "pos", *payload)


# -------------------------------------------------------------- candidate choice
def first_passing(
    candidates: DataFrame, profile: str, keys: list[str] = KEYS, lang: str = "en",
    min_tokens: int = 200, min_cues: int = 80,
) -> DataFrame:
    """Per recording the first ``stage`` whose translation quality reaches the floor.

    ``strict`` also accepts a shortfall of at most 0.015.  With none passing, ``stage`` is
    null and ``quality`` is that of the last stage.
    """
    floor = rules.TRANSLATION_FLOOR[profile]
    scored = translation_quality(candidates, lang, [*keys, "stage"], min_tokens, min_cues)
    slack = 0.015 if profile == "strict" else 0.0
    good = (F.col("quality") >= floor) | ((floor - F.col("quality") <= slack) if slack else F.lit(False))
    out = scored.groupBy(*keys).agg(
        F.min(F.when(good, F.struct("stage", "quality"))).alias("__g"), F.max_by("quality", "stage").alias("__last"))
    return out.select(
        *keys, F.col("__g.stage").alias("stage"), F.coalesce(F.col("__g.quality"), F.col("__last")).alias("quality"),
        F.when(F.col("__g").isNotNull(), "accepted").otherwise("failed").alias("status"))


def _slice_metrics(feats: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Scene score, penalty and malformed share of a set of cues with their features, prefixed with ``name``."""
    odd = F.avg((F.col("repeats") | F.col("low_function")).cast("double")).alias("__o")
    m = defect_ratios(feats, groups, odd)
    score = clamp(1.0 - ((F.col("malformed_ratio") + F.col("__o")) * 1.35 + F.col("malformed_ratio") * 1.55), 0.0, 1.0)
    return m.select(
        *groups, F.col("cue_count").alias(f"{name}_n"), score.alias(f"{name}_score"),
        semantic_penalty().alias(f"{name}_penalty"), F.col("malformed_ratio").alias(f"{name}_malformed"))


def accept_better_scenes(
    old: DataFrame, retry: DataFrame, k: int | None = None, profile: str = "strict", lang: str = "en", keys: list[str] = KEYS
) -> DataFrame:
    """Take the retried text of low scenes (all, or the ``k`` worst) where it is clearly better.

    ``retry`` has (keys, pos, text).  A scene is taken if it has the same number of cues,
    a score above the old one + 0.01, a penalty at most the old one - 0.01 and no more
    malformed contractions.  Adds ``accepted``.
    """
    if profile != "strict" or lang.lower() != "en":
        return old.withColumn("accepted", F.lit(False))
    split = scene_split(old.select(*keys, "pos", "start_ms", "end_ms"), "gap", keys).select(*keys, "pos", "scene_id")
    featured = stage(feature_table(old, keys), "features")
    scenes = worst_scenes(scene_quality(featured, keys, featured=True), k, keys).select(*keys, "scene_id")
    groups = [*keys, "scene_id"]
    picked = stage(split.join(scenes, groups, "left_semi"), "picked")
    was = _slice_metrics(featured.join(picked, [*keys, "pos"]), groups, "old")
    again = T.text_features(retry.select(*keys, "pos", "text").join(picked, [*keys, "pos"]))
    now = _slice_metrics(again, groups, "new")
    better = was.join(now, groups).where(
        (F.col("old_n") == F.col("new_n")) & (F.col("new_score") > F.col("old_score") + 0.01)
        & (F.col("new_penalty") <= F.col("old_penalty") - 0.01) & (F.col("new_malformed") <= F.col("old_malformed") + 2.2e-16))
    taken = picked.join(better, groups, "left_semi").join(
        retry.select(*keys, "pos", F.col("text").alias("__t")), [*keys, "pos"]).select(*keys, "pos", "__t")
    out = old.join(taken, [*keys, "pos"], "left")
    return out.withColumns({"accepted": F.col("__t").isNotNull(), "text": F.coalesce("__t", "text")}).drop("__t")


def _retry_score(retry: DataFrame, keys: list[str], tag: str) -> DataFrame:
    groups = [*keys, tag]
    rows = retry.withColumnRenamed("ord", "pos")
    score = score_source(rows.select(*groups, "pos", "start_ms", "end_ms", "text"), groups, groups)
    gate = structural_gate(structural_health(rows, groups), "strict").select(*groups, "pathological")
    return score.select(*groups, F.col("score").alias("new_score")).join(gate, groups)


def accept_better_source(
    cues: DataFrame, retry: DataFrame, k: int | None = None, profile: str = "strict", keys: list[str] = KEYS
) -> DataFrame:
    """Splice in retried source scenes that score more than 0.03 better and are sound.

    ``retry`` has (keys, scene_id, ord, start_ms, end_ms, text) with absolute times; the
    caller transcribes ``retry_windows`` to get them.
    """
    payload = ["start_ms", "end_ms", "text"]
    if profile != "strict":
        return cues.select(*keys, "pos", *payload)
    spans = source_retry_spans(cues, k, keys)
    new = _retry_score(retry, keys, "scene_id")
    good = spans.join(new, [*keys, "scene_id"]).where(
        (F.col("new_score") > F.col("score") + 0.03) & ~F.col("pathological"))
    good = stage(good, "accepted")
    taken = retry.join(good.select(*keys, "scene_id", "span_start"), [*keys, "scene_id"]).select(*keys, "span_start", "ord", *payload)
    return splice(cues.select(*keys, "pos", *payload), good.select(*keys, "span_start", "span_end"), taken, keys)


@one_pass
def source_retry_spans(cues: DataFrame, k: int | None = None, keys: list[str] = KEYS, bad_timing: bool = False) -> DataFrame:
    """The low source scenes (all, or the ``k`` worst) longer than 0.15 s, with the padded time to redo."""
    split = scene_split(cues.select(*keys, "pos", "start_ms", "end_ms"), "gap", keys, bad_timing)
    split = split.where(F.col("scene_id").isNotNull())
    where = split.groupBy(*keys, "scene_id").agg(
        F.min("pos").alias("span_start"), (F.max("pos") + 1).cast("int").alias("span_end"),
        F.min("start_ms").alias("__s"), F.max("end_ms").alias("__e"))
    worst = worst_scenes(source_scene_quality(cues, keys, bad_timing), k, keys).select(*keys, "scene_id", "score", "floor")
    df = worst.join(where, [*keys, "scene_id"]).where(F.col("__e") > F.col("__s") + 150)
    return stage(df.select(
        *keys, "scene_id", "span_start", "span_end", "score", "floor",
        F.greatest(F.lit(0), F.col("__s") - 250).cast("bigint").alias("redo_from_ms"), (F.col("__e") + 350).alias("redo_to_ms")), "redo")


def accept_better_spans(
    cues: DataFrame, spans: DataFrame, retry: DataFrame, k: int | None = None, profile: str = "strict", keys: list[str] = KEYS
) -> DataFrame:
    """Splice in retried low-confidence spans that gain in confidence and in structure.

    ``spans`` come from ``low_confidence_spans``.  ``retry`` has (keys, span_start, ord,
    start_ms, end_ms, text) and the confidence columns, null where unknown.
    """
    payload = ["start_ms", "end_ms", "text"]
    base = cues.select(*keys, "pos", *payload)
    if profile != "strict":
        return base
    worst = stage(worst_scenes(spans, k, keys, "span_start"), "worst")
    groups = [*keys, "span_start"]
    held = worst.select(*groups, F.explode(F.sequence(F.col("span_start"), F.col("span_end") - 1)).alias("pos"))
    rows = base.join(held, [*keys, "pos"])
    times = rows.groupBy(*groups).agg(F.min("start_ms").alias("__s"), F.max("end_ms").alias("__e"))
    long = times.where(F.col("__e") > F.col("__s") + 100).select(*groups)
    was = score_source(rows, groups, groups).select(*groups, F.col("score").alias("old_score"))
    now = _retry_score(retry, keys, "span_start")
    sure = mean_confidence(retry, groups)
    good = worst.join(long, groups, "left_semi").join(was, groups).join(now, groups).join(sure, groups).where(
        (F.coalesce("mean_confidence", "new_score") - F.col("score") > 0.06)
        & (F.col("new_score") - F.col("old_score") > 0) & ~F.col("pathological"))
    good = stage(good.select(*groups, "span_end"), "accepted")
    taken = retry.join(good.select(*groups), groups, "left_semi").select(*groups, "ord", *payload)
    return splice(base, good.select(*keys, "span_start", "span_end"), taken, keys)


def confidence_retry_windows(cues: DataFrame, spans: DataFrame, k: int = 8, keys: list[str] = KEYS) -> DataFrame:
    """Padded time to redo for the ``k`` worst low-confidence spans."""
    worst = worst_scenes(spans, k, keys, "span_start")
    held = worst.select(*keys, "span_start", F.explode(F.sequence(F.col("span_start"), F.col("span_end") - 1)).alias("pos"))
    times = cues.join(held, [*keys, "pos"]).groupBy(*keys, "span_start").agg(
        F.min("start_ms").alias("__s"), F.max("end_ms").alias("__e")).where(F.col("__e") > F.col("__s") + 100)
    return times.select(
        *keys, "span_start", F.greatest(F.lit(0), F.col("__s") - 300).cast("bigint").alias("redo_from_ms"),
        (F.col("__e") + 400).alias("redo_to_ms"))


@one_pass
def compact_if_not_worse(cues: DataFrame, profile: str = "strict", lang: str = "en", keys: list[str] = KEYS) -> DataFrame:
    """Compacted cues where that made a recording shorter and no ratio worse, else the original.

    Gives (keys, pos, start_ms, end_ms, text, ``compacted``).
    """
    base = cues.select(*keys, "pos", "start_ms", "end_ms", "text")
    if profile != "strict" or lang.lower() != "en":
        return base.withColumn("compacted", F.lit(False))
    small = stage(compact_cues(base, keys).select(*keys, "pos", "start_ms", "end_ms", "text"), "compacted")
    names = ["malformed_ratio", "anomaly_ratio", "adjacent_repeat_ratio", "scene_low_ratio", "overlap_ratio", "top_line_ratio"]
    count = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    # only a recording that has become shorter can change, so only such ones are measured
    shorter = count(base, "__old").where(F.col("__old") >= 2).join(count(small, "__new"), keys).where(F.col("__new") < F.col("__old"))
    shorter = stage(shorter.select(*keys), "shorter")

    def measure(df, tag):
        df = stage(df.join(shorter, keys, "left_semi"), "measured")
        sem = semantic_health(df, lang, keys)
        struct = structural_health(df, keys).select(*keys, "top_line_ratio", "overlap_ratio")
        return sem.join(struct, keys).select(*keys, F.col("cue_count").alias(f"{tag}_n"), *[F.col(c).alias(f"{tag}_{c}") for c in names])

    slack = [2.2e-16, 0.001, 0.001, 0.002, 0.0, 0.003]
    worse = F.lit(False)
    for c, s in zip(names, slack):
        worse = worse | (F.col(f"new_{c}") > F.col(f"old_{c}") + s)
    both = measure(base, "old").join(measure(small, "new"), keys)
    take = stage(both.where(~worse).select(*keys), "take")
    kept = base.join(take, keys, "left_anti").withColumn("compacted", F.lit(False))
    return kept.unionByName(small.join(take, keys, "left_semi").withColumn("compacted", F.lit(True)))


# ------------------------------------------------------------------------- gates
def enforce_gate(df: DataFrame, gate: DataFrame, profile: str = "strict", keys: list[str] = KEYS) -> DataFrame:
    """Add ``status`` to rows by their recording's ``pathological`` flag.

    ``strict``: passed or rejected.  Other profiles: passed or warned, all kept.  Only a
    sound verdict passes: a null one (unreadable times) and a missing one count as bad.
    """
    bad = "rejected" if profile == "strict" else "warned"
    flags = gate.select(*keys, "pathological")
    status = F.when(F.coalesce("pathological", F.lit(True)), bad).otherwise("passed")
    return df.join(flags, keys, "left").withColumn("status", status).drop("pathological")


def split_by_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) parts of a gated table."""
    return df.where("status <> 'rejected'").drop("status"), df.where("status = 'rejected'").drop("status")


def require(df: DataFrame, message: str = "quality gate failed") -> DataFrame:
    """Fail the job at the first rejected row."""
    ok = F.when(F.col("status") == "rejected", F.raise_error(F.lit(message)).cast("string")).otherwise(F.col("status"))
    return df.withColumn("status", ok)
