"""Interval algebra on (group, start_ms, end_ms) rows.

Equal starts are folded before any ordering, so a block of a given width in time holds a
bounded number of rows however many copies the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.operators.ordered import lag_of, one_pass, scan

KEYS = ["recording_id"]
BLOCK_MS = 600_000


def time_block(order: str = "start_ms", width: int = BLOCK_MS) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    """Shared length of two intervals, zero when apart."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0).cast("bigint"), F.least(c(a_end), c(b_end)) - F.greatest(c(a_start), c(b_start)))


def fold_starts(iv: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per start, with the latest end."""
    return iv.groupBy(*keys, "start_ms").agg(F.max("end_ms").alias("end_ms"))


@one_pass
def merge_intervals(iv: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Union of intervals; touching ones merge."""
    df = scan(fold_starts(iv, keys), keys, ["start_ms"], {"__e": ("max_before", F.col("end_ms"))}, time_block())
    opens = F.col("__e").isNull() | (F.col("start_ms") > F.col("__e"))
    df = df.withColumn("__at", F.when(opens, F.col("start_ms")))
    df = scan(df, keys, ["start_ms"], {"__in": ("last_before", F.col("__at"))}, time_block())
    return df.groupBy(*keys, F.coalesce("__at", "__in").alias("start_ms")).agg(F.max("end_ms").alias("end_ms"))


@one_pass
def complement(
    iv: DataFrame, recordings: DataFrame, keys: list[str] = KEYS, min_ms: int = 0, fixed: bool = False
) -> DataFrame:
    """Gaps of at least ``min_ms`` inside [0, duration_ms], with their centroid in ms.

    As in a left-to-right walk, a gap ends at the next start even past the duration.
    """
    cursor = {"__c": ("max_before", F.greatest("end_ms", F.lit(0)))}
    df = scan(fold_starts(iv, keys), keys, ["start_ms"], cursor, time_block())
    inner = df.join(recordings.select(*keys), keys, "left_semi").select(
        *keys, F.coalesce("__c", F.lit(0)).cast("bigint").alias("__from"), F.col("start_ms").alias("__to"))
    last = iv.groupBy(*keys).agg(F.max("end_ms").alias("__last"))
    tail = recordings.select(*keys, "duration_ms").join(last, keys, "left").select(
        *keys, F.greatest(F.coalesce("__last", F.lit(0)), F.lit(0)).cast("bigint").alias("__from"),
        F.col("duration_ms").alias("__to"))
    gaps = inner.unionByName(tail).where((F.col("__to") > F.col("__from")) & (F.col("__to") - F.col("__from") >= min_ms))
    return gaps.select(
        *keys, F.col("__from").alias("start_ms"), F.col("__to").alias("end_ms"),
        ((F.col("__from") + F.col("__to")) / 2).alias("centroid_ms"))


@one_pass
def pad_and_merge(iv: DataFrame, recordings: DataFrame, pad_ms: int, keys: list[str] = KEYS) -> DataFrame:
    """Widen by ``pad_ms``, clamp to [0, duration_ms] and merge."""
    df = iv.join(recordings.select(*keys, "duration_ms"), keys)
    df = df.select(
        *keys, F.greatest(F.lit(0), F.col("start_ms") - pad_ms).cast("bigint").alias("start_ms"),
        F.least(F.col("duration_ms"), F.col("end_ms") + pad_ms).alias("end_ms"))
    return merge_intervals(df, keys)


@one_pass
def speech_from_silence(
    silence: DataFrame, recordings: DataFrame, pad_ms: int = 200, cap_ms: int | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Speech = complement of silence, padded and merged, up to an optional cap."""
    rec = recordings.select(*keys, "duration_ms")
    if cap_ms is not None and cap_ms > 0:
        rec = rec.withColumn("duration_ms", F.least(F.col("duration_ms"), F.lit(cap_ms).cast("bigint")))
    speech = complement(silence, rec, keys).select(*keys, "start_ms", "end_ms")
    return pad_and_merge(speech, rec, pad_ms, keys) if pad_ms > 0 else speech


@one_pass
def silence_islands(
    frames: DataFrame, db: float = -35.0, min_ms: int = 350, keys: list[str] = KEYS
) -> DataFrame:
    """Runs of consecutive frames below ``db`` that last at least ``min_ms``.

    ``frames`` has ``pos``, ``start_ms``, ``end_ms`` and ``energy_db``.
    """
    df = frames.select(*keys, "pos", "start_ms", "end_ms", (F.col("energy_db") < db).alias("__quiet"))
    df = scan(df, keys, ["pos"], {"__p": lag_of("__quiet")})
    first = F.col("__quiet") & ~F.coalesce(F.col("__p")["__quiet"], F.lit(False))
    df = df.withColumn("__at", F.when(first, F.col("pos")))
    df = scan(df, keys, ["pos"], {"__in": ("last_before", F.col("__at"))}).where("__quiet")
    runs = df.groupBy(*keys, F.coalesce("__at", "__in").alias("__run")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("frames"))
    return runs.where(F.col("end_ms") - F.col("start_ms") >= min_ms).drop("__run")


@one_pass
def silence_boundaries(
    speech: DataFrame, recordings: DataFrame, min_ms: int = 1500, keys: list[str] = KEYS
) -> DataFrame:
    """Midpoints of silences of at least ``min_ms`` strictly inside the recording.

    Midpoints closer than 0.05 s to the last one kept would be dropped; silences are
    disjoint and ``min_ms`` long, so two midpoints are always at least that far apart.
    """
    if min_ms < 50:
        raise ValueError("min_ms below 50 would need the last-kept rule")
    gaps = complement(speech, recordings, keys, min_ms)
    inside = gaps.join(recordings.select(*keys, "duration_ms"), keys)
    return inside.where((F.col("centroid_ms") > 0) & (F.col("centroid_ms") < F.col("duration_ms"))).select(
        *keys, F.col("centroid_ms").alias("boundary_ms"))


def chunk_target_secs(recordings: DataFrame) -> DataFrame:
    """Chunk length from ``duration_secs`` and ``avg_difficulty``, either may be null."""
    d, hard = F.col("duration_secs"), F.col("avg_difficulty")
    base = (
        F.when(d >= 7200, 360.0).when(d >= 3600, 300.0).when(d >= 1800, 240.0)
        .when(d.isNotNull(), 180.0).otherwise(300.0))
    target = (
        F.when(hard >= 0.70, F.greatest(base * 0.75, F.lit(120.0)))
        .when(hard <= 0.30, F.least(base * 1.15, F.lit(420.0))).otherwise(base))
    return recordings.withColumn("chunk_target_secs", target)


@one_pass
def plan_chunks(
    boundaries: DataFrame, recordings: DataFrame, target_ms: int | str = 300_000, overlap: int = 2_000,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Chunks around chosen boundaries, overlapping their neighbours by ``overlap`` ms.

    Recordings up to 1.3 times the target stay whole.  Boundaries are in ms and unique.
    ``target_ms`` is one length for all, or names the column of ``recordings`` that has each one's.
    """
    target = F.col(target_ms) if isinstance(target_ms, str) else F.lit(target_ms)
    short = F.col("duration_ms") <= 1.3 * target
    rec = recordings.select(*keys, F.col("duration_ms").cast("double").alias("__dur"), short.alias("__whole"))
    cuts = boundaries.join(rec.where("not __whole"), keys).select(
        *keys, F.col("boundary_ms").cast("double").alias("__to"), "__dur", F.lit(False).alias("__end"))
    ends = rec.select(*keys, F.col("__dur").alias("__to"), "__dur", F.lit(True).alias("__end"))
    rows = cuts.unionByName(ends)
    block = F.floor(F.col("__to") / (BLOCK_MS * 10))
    specs = {"__prev": ("last_before", F.when(~F.col("__end"), F.col("__to"))),
             "chunk_index": ("sum_before", F.lit(1).cast("bigint"))}
    df = scan(rows, keys, ["__to", "__end"], specs, block)
    first = F.col("__prev").isNull()
    prev = F.coalesce("__prev", F.lit(0.0))
    start = F.when(first, 0.0).otherwise(F.greatest(F.lit(0.0), prev - overlap))
    end = F.when(F.col("__end"), F.col("__dur")).otherwise(F.least(F.col("__dur"), F.col("__to") + overlap))
    return df.select(
        *keys, F.col("chunk_index").cast("int").alias("chunk_index"),
        start.alias("start_ms"), end.alias("end_ms"),
        F.when(first, 0.0).otherwise(prev - start).alias("overlap_before_ms"),
        F.when(F.col("__end"), 0.0).otherwise(end - F.col("__to")).alias("overlap_after_ms"))
