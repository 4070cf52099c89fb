"""Content maps: scenes of a recording from its speech, and their difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.operators.intervals import BLOCK_MS, merge_intervals, silence_boundaries
from cuestrata.operators.joins import covered_ms
from cuestrata.operators.ordered import lag_of, one_pass, scan
from cuestrata.operators.scenes import clamp
from cuestrata.session import stage

KEYS = ["recording_id"]


def scene_difficulty(secs: Column, density: Column) -> Column:
    pace = F.when(secs < 25, 0.25).when(secs < 60, 0.15).when(secs > 600, 0.18).otherwise(0.05)
    load = F.when(density >= 0.92, 0.35).when(density >= 0.75, 0.22).when(density <= 0.20, 0.28).otherwise(0.12)
    return clamp(F.lit(0.18) + pace + load, 0.10, 0.95)


def classify_scenes(scenes: DataFrame) -> DataFrame:
    """Add difficulty, type, speakers, energy and emotion from length and speech density."""
    secs, density = F.col("duration_ms") / 1000, F.col("speech_density")
    df = scenes.withColumn("difficulty", scene_difficulty(secs, density))
    hard = F.col("difficulty")
    one = lambda c: F.when(c, 1).otherwise(0)
    return df.withColumns({
        "scene_type": F.when(density <= 0.20, "ambient").when((density >= 0.90) & (secs < 60), "rapid-dialogue")
        .when(density >= 0.90, "dialogue-dense").when(secs >= 420, "long-scene").otherwise("dialogue"),
        "speakers": (1 + one(density >= 0.85) + one((secs <= 45) & (density >= 0.75)) + one(hard >= 0.70)).cast("int"),
        "energy": F.when((density >= 0.90) | (hard >= 0.80), "high")
        .when((density >= 0.55) | (hard >= 0.45), "medium").otherwise("low"),
        "emotion": F.when(hard >= 0.80, "intense").when(density <= 0.25, "calm").when(density >= 0.85, "urgent").otherwise("neutral"),
    })


@one_pass
def content_scenes(recordings: DataFrame, speech: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scenes between long silences: (``scene_start_ms``, ``scene_end_ms``, density, classes)."""
    recordings = stage(recordings.select(*keys, "duration_ms"), "recordings")
    speech = stage(merge_intervals(speech, keys), "speech")
    rec = recordings.select(*keys, F.col("duration_ms").cast("double").alias("__dur"))
    cuts = silence_boundaries(speech, recordings, keys=keys).select(*keys, F.col("boundary_ms").alias("__to"))
    rows = cuts.unionByName(rec.where("__dur > 0").select(*keys, F.col("__dur").alias("__to")))
    df = scan(rows, keys, ["__to"], {"__from": ("last_before", F.col("__to"))}, F.floor(F.col("__to") / (BLOCK_MS * 10)))
    df = df.select(*keys, F.coalesce("__from", F.lit(0.0)).alias("scene_start_ms"), F.col("__to").alias("scene_end_ms"))
    df = stage(df, "scenes")
    # boundaries may fall on half milliseconds: measure overlap on doubled times
    twice = lambda c: (F.col(c) * 2).cast("bigint")
    parts = df.select(*keys, twice("scene_start_ms").alias("start_ms"), twice("scene_end_ms").alias("end_ms"))
    spoken = speech.select(*keys, (F.col("start_ms") * 2).alias("start_ms"), (F.col("end_ms") * 2).alias("end_ms"))
    heard = covered_ms(parts, spoken, keys, merged=True).select(
        *keys, (F.col("start_ms") / 2).alias("scene_start_ms"), (F.col("end_ms") / 2).alias("scene_end_ms"), (F.col("covered") / 2).alias("__cov"))
    df = df.join(heard, [*keys, "scene_start_ms", "scene_end_ms"], "left")
    length = F.col("scene_end_ms") - F.col("scene_start_ms")
    df = df.withColumns({
        "duration_ms": length,
        "speech_density": clamp(F.coalesce("__cov", F.lit(0.0)) / F.greatest(length, F.lit(1.0)), 0.0, 1.0)}).drop("__cov")
    scenes = classify_scenes(df)
    empty = rec.where("not (__dur > 0)").select(
        *keys, F.lit(0.0).alias("scene_start_ms"), F.lit(100.0).alias("scene_end_ms"), F.lit(100.0).alias("duration_ms"),
        F.lit(0.0).alias("speech_density"), F.lit(0.5).alias("difficulty"), F.lit("unknown").alias("scene_type"),
        F.lit(1).alias("speakers"), F.lit("low").alias("energy"), F.lit("unknown").alias("emotion"))
    return scenes.unionByName(empty)


def estimated_cues(speech_secs: Column, difficulty: Column) -> Column:
    scaled = F.round(speech_secs / 2.8) * (1.0 + (difficulty - 0.35) * 0.35)
    return F.floor(F.greatest(F.lit(1.0), scaled)).cast("bigint")


@one_pass
def content_map(recordings: DataFrame, speech: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per recording with speech totals and scores over its scenes."""
    scenes = stage(content_scenes(recordings, speech, keys), "scenes")
    order = F.floor(F.col("scene_start_ms") / (BLOCK_MS * 10))
    flagged = scan(scenes, keys, ["scene_start_ms"], {"__p": lag_of("energy")}, order)
    change = F.coalesce(F.col("__p")["energy"] != F.col("energy"), F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    agg = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scene_count"), F.avg("difficulty").alias("avg_difficulty"),
        clamp((F.avg("speakers") - 1) / 3, 0.0, 1.0).alias("speaker_complexity"),
        F.sum(change.cast("bigint")).alias("__chg"),
        share((F.col("speakers") >= 3) & (F.col("speech_density") >= 0.75)).alias("overlap_risk"))
    total = speech.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("__sp"))
    df = recordings.select(*keys, "duration_ms").join(total, keys, "left").join(agg, keys)
    spoken = F.least(F.coalesce("__sp", F.lit(0)), F.col("duration_ms"))
    return df.select(
        *keys, (F.col("duration_ms") / 1000).alias("total_secs"), (spoken / 1000).alias("speech_secs"),
        (F.greatest(F.lit(0), F.col("duration_ms") - spoken) / 1000).alias("silence_secs"),
        "scene_count", "avg_difficulty", "speaker_complexity",
        F.when(F.col("scene_count") > 1, F.col("__chg") / (F.col("scene_count") - 1)).otherwise(0.0).alias("energy_variance"),
        "overlap_risk", estimated_cues(spoken / 1000, F.col("avg_difficulty")).alias("estimated_cues"))


def content_map_from_cues(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Content map of a recording known only by its cues: one scene, constant scores."""
    good = F.bool_and(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    end = F.when(good, F.greatest(F.max("end_ms"), F.lit(0))).otherwise(0)
    df = cues.groupBy(*keys).agg(end.alias("__end"), F.count(F.lit(1)).alias("estimated_cues"))
    each = F.greatest(F.col("__end") / 1000 / F.col("estimated_cues"), F.lit(0.001))
    return df.select(
        *keys, (F.col("__end") / 1000).alias("total_secs"), (F.col("__end") / 1000).alias("speech_secs"),
        F.lit(0.0).alias("silence_secs"), F.lit(1).cast("bigint").alias("scene_count"),
        F.when(each >= 4, 0.20).when(each >= 2.5, 0.35).otherwise(0.55).alias("avg_difficulty"),
        F.lit(0.1).alias("speaker_complexity"), F.lit(0.1).alias("energy_variance"), F.lit(0.0).alias("overlap_risk"),
        "estimated_cues")


def content_hash(content: DataFrame, scenes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Hash of the rounded content fields and of all scenes.

    Each scene is hashed with its start, and the hashes (60 bits of MD5) are summed, so a recording of
    any length is folded before the shuffle and no scene is left out.  Values are rounded to six digits
    first, so that the order of a sum can't turn a digit.
    """
    scaled = lambda c, by: F.round(F.round(F.col(c).cast("double"), 6) * by).cast("bigint")
    line = lambda *parts: F.concat_ws(":", *parts)
    scene = F.conv(F.substring(F.md5(line(
        scaled("scene_start_ms", 10), scaled("duration_ms", 0.01), scaled("speech_density", 100), scaled("difficulty", 100))), 1, 15), 16, 10)
    every = scenes.groupBy(*keys).agg(F.sum(scene.cast("decimal(38,0)")).alias("__s"))
    fields = line(
        scaled("total_secs", 10), scaled("speech_secs", 10), *(scaled(c, 100) for c in ("avg_difficulty", "speaker_complexity", "energy_variance", "overlap_risk")),
        F.col("scene_count"), F.coalesce("__s", F.lit(0)))
    return content.join(every, keys, "left").select(*keys, F.md5(fields).alias("content_hash"))
