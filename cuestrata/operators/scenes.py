"""Scene splitting and the scores of single scenes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions import text as T
from cuestrata.operators.ordered import lag_of, one_pass, scan, taken_whole
from cuestrata.session import stage

KEYS = ["recording_id"]
GAP_MS = 1500
JUMP_MS = 420_000
BACKSTEP_MS = 100


@one_pass
def prev_end(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add ``prev_end``: latest end among all earlier cues, 0 at the first."""
    out = scan(cues, keys, ["pos"], {"prev_end": ("max_before", F.col("end_ms"))})
    return out.withColumn("prev_end", F.greatest(F.coalesce("prev_end", F.lit(0)), F.lit(0)))


@one_pass
def scene_split(
    cues: DataFrame, rule: str = "gap", keys: list[str] = KEYS, bad_timing: bool = False
) -> DataFrame:
    """Add ``scene_id`` (from 1), ``scene_start`` and ``prev_end``.

    ``gap``: a silence of 1.5 s, or an end 420 s past everything before, opens a scene.
    ``overlap``: the same silence, or a start 0.1 s or more before the earlier end.
    With ``bad_timing`` rows may have null times: such a row belongs to a scene only if
    that scene goes on after it, and has a null ``scene_id`` otherwise.
    """
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    df = scan(cues, keys, ["pos"], {"prev_end": ("max_before", F.when(timed, F.greatest("end_ms", F.lit(0))))})
    first = F.col("prev_end").isNull()
    known = F.coalesce("prev_end", F.lit(0))
    quiet = F.col("start_ms") - known >= GAP_MS
    if rule == "gap":
        other = F.col("end_ms") - known >= JUMP_MS
    elif rule == "overlap":
        other = F.col("start_ms") - known <= -BACKSTEP_MS
    else:
        raise ValueError(f"unknown scene rule {rule!r}")
    opens = timed & (first | quiet | other)
    df = df.withColumns({"scene_start": opens, "prev_end": known})
    specs = {"__s": ("sum_before", F.col("scene_start").cast("bigint"))}
    if bad_timing:
        specs["__next"] = ("next_after", F.when(timed, F.col("scene_start")))
    df = scan(df, keys, ["pos"], specs)
    scene = (F.col("__s") + F.col("scene_start").cast("bigint")).cast("bigint")
    if bad_timing:
        goes_on = F.coalesce(~F.col("__next"), F.lit(False)) & (scene > 0)
        scene = F.when(timed | goes_on, scene)
    df = df.withColumn("scene_id", scene).drop("__s", "__next")
    if bad_timing and rule == "overlap":
        # a recording without one readable time is one scene
        none = df.groupBy(*keys).agg(F.max("scene_id").isNull().alias("__none"))
        df = df.join(none, keys, "left").withColumn(
            "scene_id", F.when(F.col("__none"), F.lit(1).cast("bigint")).otherwise(F.col("scene_id"))).drop("__none")
    return df


@one_pass
def adjacent_duplicate(cues: DataFrame, keys: list[str] = KEYS, key_expr=T.health_key) -> DataFrame:
    """Add ``adjacent_duplicate``: normalised text equals the row before, and is not empty."""
    df = cues.withColumn("__k", key_expr("text"))
    df = scan(df, keys, ["pos"], {"__p": lag_of("__k")})
    same = F.coalesce((F.col("__k") != "") & (F.col("__k") == F.col("__p")["__k"]), F.lit(False))
    return df.withColumn("adjacent_duplicate", same).drop("__k", "__p")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scene_floor(difficulty: Column) -> Column:
    return F.when(difficulty >= 0.70, 0.70).when(difficulty <= 0.30, 0.90).otherwise(0.80)


@one_pass
def fast_turn_flags(scenes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add ``fast_turn``: under 0.15 s after the previous timed cue of the same scene.

    The cue that opens a scene is measured from zero.
    """
    ended = F.when(F.col("end_ms").isNotNull() & F.col("start_ms").isNotNull(), F.struct("scene_id", "end_ms"))
    df = scan(scenes, keys, ["pos"], {"__p": ("last_before", ended)})
    inside = F.col("__p")["scene_id"] == F.col("scene_id")
    since = F.when(inside, F.col("__p")["end_ms"]).otherwise(0)
    gap = F.greatest(F.lit(0), F.col("start_ms") - F.coalesce(since, F.lit(0)))
    return df.withColumn("fast_turn", F.coalesce(gap < 150, F.lit(False))).drop("__p")


@one_pass
def scene_quality(
    cues: DataFrame, keys: list[str] = KEYS, bad_timing: bool = False, featured: bool = False
) -> DataFrame:
    """Difficulty, score, floor and pass per scene.

    ``featured`` says that ``cues`` already has the ``text_features`` columns.
    """
    df = cues if featured else stage(T.text_features(cues.select(*keys, "pos", "start_ms", "end_ms", "text")).drop("text"), "features")
    df = df.select(*keys, "pos", "start_ms", "end_ms", "n_tokens", "malformed", "low_function", "repeats")
    df = fast_turn_flags(scene_split(df, "gap", keys, bad_timing), keys).where(F.col("scene_id").isNotNull())
    return score_scenes(df, [*keys, "scene_id"])


def score_scenes(df: DataFrame, scene_keys: list[str]) -> DataFrame:
    """Aggregate flagged cues to scene rows."""
    hit = lambda c: F.sum(F.col(c).cast("bigint"))
    sums = df.groupBy(*scene_keys).agg(
        F.count(F.lit(1)).alias("n"),
        hit("malformed").alias("__bad"),
        F.sum((F.col("repeats") | F.col("low_function")).cast("bigint")).alias("__odd"),
        F.sum("n_tokens").alias("__tok"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias("__dur"),
        hit("fast_turn").alias("__fast"),
    )
    n = F.col("n")
    difficulty = clamp(
        F.lit(0.20)
        + F.when(F.col("__dur") <= 1800 * n, 0.28).otherwise(0.10)
        + F.when(F.col("__tok") >= 8 * n, 0.22).otherwise(0.08)
        + F.when(F.col("__fast") / n >= 0.35, 0.22).otherwise(0.05),
        0.10, 0.95,
    )
    anomaly, malformed = (F.col("__bad") + F.col("__odd")) / n, F.col("__bad") / n
    score = clamp(1.0 - (anomaly * 1.35 + malformed * 1.55), 0.0, 1.0)
    out = sums.select(*scene_keys, "n", difficulty.alias("difficulty"), score.alias("score"))
    out = out.withColumn("floor", scene_floor(F.col("difficulty")))
    return out.withColumn("passed", F.col("score") >= F.col("floor"))


def scene_low_ratio(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scenes and the share of them below their floor, per recording."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.avg((~F.col("passed")).cast("double")).alias("scene_low_ratio"))


@one_pass
def source_scene_quality(cues: DataFrame, keys: list[str] = KEYS, bad_timing: bool = False) -> DataFrame:
    """Score and floor of untranslated scenes."""
    df = scene_split(cues.select(*keys, "pos", "start_ms", "end_ms", "text"), "gap", keys, bad_timing)
    df = df.where(F.col("scene_id").isNotNull())
    return score_source(df, keys, [*keys, "scene_id"])


def score_source(df: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Source score of each group of cues; groups are runs along ``pos`` within ``keys``.

    Works on the latest earlier end *in the group*: the running maximum of
    (group, end) pairs, which only ever looks at the group the row is in.
    """
    tag = [g for g in groups if g not in keys]
    if tag:
        pair = F.when(F.col("end_ms").isNotNull(), F.struct(*tag, "end_ms"))
        known = ("last_before", F.struct(*tag, "__k"))
        df = df.withColumn("__k", T.health_key("text"))
        df = scan(df, keys, ["pos"], {"__e": ("max_before", pair), "__p": known})
        same_e = F.lit(True)
        same_p = F.lit(True)
        for g in tag:
            same_e = same_e & (F.col("__e")[g] == F.col(g))
            same_p = same_p & (F.col("__p")[g] == F.col(g))
        earlier = F.when(same_e, F.col("__e")["end_ms"])
        before = F.when(same_p, F.col("__p")["__k"])
    else:
        df = df.withColumn("__k", T.health_key("text"))
        df = scan(df, keys, ["pos"], {"__e": ("max_before", F.col("end_ms")), "__p": lag_of("__k")})
        earlier, before = F.col("__e"), F.col("__p")["__k"]
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    flagged = df.select(
        *groups, "__k",
        (F.col("start_ms") < earlier).alias("__over"),
        (length < 450).alias("__short"),
        (length < 200).alias("__tiny"),
        ((F.col("__k") != "") & (F.col("__k") == before)).alias("__dup"),
        F.col("start_ms").isNull().alias("__untimed"),
    )
    hit = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    names = ["__over", "__short", "__tiny", "__dup", "__untimed"]
    by_line = flagged.groupBy(*groups, "__k").agg(F.count(F.lit(1)).alias("__n"), *[hit(c).alias(c) for c in names])
    filled = F.when(F.col("__k") != "", F.col("__n"))
    sums = by_line.groupBy(*groups).agg(
        F.sum("__n").alias("n"),
        F.coalesce(F.max(filled), F.lit(0)).alias("__top"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("__full"),
        *[F.sum(c).alias(c) for c in names],
    )
    n = F.col("n")
    overlap = F.when(n > 1, F.col("__over") / (n - 1)).otherwise(0.0)
    score = clamp(
        1.0 - (
            F.col("__top") / n * 1.45 + overlap * 1.35 + (1.0 - F.col("__full") / n) * 1.6
            + F.col("__short") / n * 0.55 + F.col("__tiny") / n * 0.8 + F.col("__dup") / n * 0.95
        ), 0.0, 1.0)
    floor = F.when(n >= 8, 0.82).when(n >= 4, 0.76).otherwise(0.70)
    out = sums.select(
        *groups, "n",
        (F.col("__top") / n).alias("top_line_ratio"), overlap.alias("overlap_ratio"),
        (F.col("__full") / n).alias("non_empty_ratio"),
        F.when(F.col("__untimed") > 0, 0.0).otherwise(score).alias("score"), floor.alias("floor"),
    )
    return out.withColumn("passed", F.col("score") >= F.col("floor"))


@one_pass
def tag_difficulty(cues: DataFrame, profile: str, keys: list[str] = KEYS) -> DataFrame:
    """Cues with ``scene_id`` by the overlap rule, joined with their scene's ``difficulty``."""
    df = scene_split(cues, "overlap", keys)
    pair = F.when(F.col("end_ms").isNotNull(), F.struct("scene_id", "end_ms"))
    df = scan(df, keys, ["pos"], {"__e": ("max_before", pair)})
    since = F.when(F.col("__e")["scene_id"] == F.col("scene_id"), F.col("__e")["end_ms"])
    close = F.coalesce(F.greatest(F.lit(0), F.col("start_ms") - F.greatest(since, F.lit(0))) < 120, F.lit(False)) & since.isNotNull()
    short = F.coalesce(F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) < 1000, F.lit(False))
    df = df.withColumns({"__close": close, "__short": short, "__ask": T.asks("text"), "__cry": T.exclaims("text")})
    here = Window.partitionBy(*keys, "scene_id")
    share = lambda c: F.avg(F.col(c).cast("double")).over(here) if taken_whole() else F.avg(F.col(c).cast("double"))
    level = clamp(
        F.lit(0.32) + share("__short") * 0.28 + share("__close") * 0.22
        + share("__cry") * 0.12 + share("__ask") * 0.10 + rules.TAG_BIAS[profile],
        0.10, 0.95)
    done = ["__e", "__close", "__short", "__ask", "__cry", "scene_start", "prev_end"]
    if taken_whole():
        # a recording that is in one place needs no join with its scenes
        known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "scene_id"]])
        return df.withColumn("difficulty", level).where(known).drop(*done)
    scored = df.groupBy(*keys, "scene_id").agg(level.alias("difficulty"))
    return df.drop(*done).join(scored, [*keys, "scene_id"])
