"""Time joins: bucketed overlap, best alignment, and keyed attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.functions import text as T
from cuestrata.operators.intervals import BLOCK_MS, merge_intervals, overlap_ms
from cuestrata.operators.ordered import one_pass, scan
from cuestrata.session import stage

KEYS = ["recording_id"]
BUCKET_MS = 30_000


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str] = KEYS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of overlapping intervals with ``ov`` ms in common.

    ``a`` has (keys, a_start, a_end, ...), ``b`` has (keys, b_start, b_end, ...).  Both are
    spread over time buckets and meet on (keys, bucket), so one long recording is many
    small groups; a pair is kept in the first bucket both sides reach.
    """
    def spread(df, start, end):
        first, last = F.floor(F.col(start) / bucket_ms), F.floor((F.col(end) - 1) / bucket_ms)
        return df.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(first, last)))

    left, right = spread(a, "a_start", "a_end"), spread(b, "b_start", "b_end")
    pairs = left.join(right, [*keys, "__bucket"])
    home = F.greatest(F.floor(F.col("a_start") / bucket_ms), F.floor(F.col("b_start") / bucket_ms))
    pairs = pairs.where(
        (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("__bucket") == home))
    return pairs.withColumn("ov", overlap_ms("a_start", "a_end", "b_start", "b_end")).drop("__bucket")


def _spans(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Distinct intervals of one side, so that copies are joined once."""
    return df.select(*keys, F.col("start_ms").alias(f"{side}_start"), F.col("end_ms").alias(f"{side}_end")).distinct()


def covered_ms(cues: DataFrame, speech: DataFrame, keys: list[str] = KEYS, merged: bool = False) -> DataFrame:
    """(keys, start_ms, end_ms, covered): speech inside each distinct interval of ``cues``.

    ``merged`` says that ``speech`` is disjoint already.
    """
    spoken = (speech if merged else merge_intervals(speech, keys)).select(*keys, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    hits = overlap_join(_spans(cues, keys, "a"), spoken, keys)
    return hits.groupBy(*keys, F.col("a_start").alias("start_ms"), F.col("a_end").alias("end_ms")).agg(
        F.sum("ov").alias("covered"))


@one_pass
def speech_ratio(cues: DataFrame, speech: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cues with ``speech_ratio`` = speech inside the cue over its length."""
    df = cues.join(covered_ms(cues, speech, keys), [*keys, "start_ms", "end_ms"], "left")
    # a cue without length has no overlap either
    ratio = F.coalesce("covered", F.lit(0)) / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    return df.withColumn("speech_ratio", ratio).drop("covered")


def verify_against_speech(
    cues: DataFrame, speech: DataFrame, min_ratio: float = 0.35, keys: list[str] = KEYS
) -> DataFrame:
    """Issue rows: ``low speech overlap`` and ``non-monotonic`` (starts before the previous cue ends)."""
    base = cues.select(*keys, "pos", "start_ms", "end_ms")
    order = scan(base, keys, ["pos"], {"__p": ("last_before", F.col("end_ms"))})
    back = order.where(F.col("start_ms") < F.coalesce("__p", F.lit(0))).select(
        *keys, "pos", F.lit("non-monotonic").alias("issue"), F.col("__p").cast("double").alias("measure"))
    low = speech_ratio(base, speech, keys).where(F.col("speech_ratio") < min_ratio).select(
        *keys, "pos", F.lit("low speech overlap").alias("issue"), F.col("speech_ratio").alias("measure"))
    return back.unionByName(low)


@one_pass
def align_by_time(ref: DataFrame, hyp: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For each hypothesis cue the reference cue it overlaps most, else the nearest in centre.

    Adds ``ref_pos``, ``ref_start_ms``, ``ref_end_ms``, ``overlap_ms`` and ``iou`` to the
    hypothesis (keys, pos, start_ms, end_ms); ties go to the smallest ``ref_pos``.
    Groups without any reference cue give no rows.
    """
    refs = ref.groupBy(*keys, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end")).agg(
        F.min("pos").alias("ref_pos"))
    spans = _spans(hyp, keys, "a")
    best = overlap_join(spans, refs, keys).groupBy(*keys, "a_start", "a_end").agg(
        F.min(F.struct((-F.col("ov")).alias("o"), "ref_pos", "b_start", "b_end")).alias("__b"))
    best = stage(spans.join(best, [*keys, "a_start", "a_end"], "left"), "aligned")
    matched = best.where("__b is not null").select(
        *keys, "a_start", "a_end", F.col("__b.ref_pos").alias("ref_pos"), F.col("__b.b_start").alias("ref_start_ms"),
        F.col("__b.b_end").alias("ref_end_ms"), (-F.col("__b.o")).alias("overlap_ms"))

    # nearest centre: walk both sides in order of doubled centre, references first
    lone = best.where("__b is null").select(*keys, "a_start", "a_end")
    marks = refs.groupBy(*keys, (F.col("b_start") + F.col("b_end")).alias("__c")).agg(
        F.min(F.struct("ref_pos", "b_start", "b_end")).alias("__r"))
    # only recordings with such a cue need their references in order
    marks = marks.join(lone.select(*keys).distinct(), keys, "left_semi")
    asks = lone.select(*keys, (F.col("a_start") + F.col("a_end")).alias("__c")).distinct()
    rows = marks.withColumn("__q", F.lit(0)).unionByName(asks.withColumn("__q", F.lit(1)), allowMissingColumns=True)
    known = F.when(F.col("__q") == 0, F.struct("__c", "__r"))
    near = scan(rows, keys, ["__c", "__q"], {"__lo": ("last_before", known), "__hi": ("next_after", known)},
                F.floor(F.col("__c") / (2 * BLOCK_MS))).where("__q = 1")

    def option(side):
        c = F.col(side)
        return F.when(c.isNotNull(), F.struct(
            F.abs(c["__c"] - F.col("__c")).alias("d"), c["__r"]["ref_pos"].alias("ref_pos"),
            c["__r"]["b_start"].alias("b_start"), c["__r"]["b_end"].alias("b_end")))

    near = near.withColumn("__n", F.least(option("__lo"), option("__hi"))).where("__n is not null")
    fallback = lone.withColumn("__c", F.col("a_start") + F.col("a_end")).join(near.select(*keys, "__c", "__n"), [*keys, "__c"]).select(
        *keys, "a_start", "a_end", F.col("__n.ref_pos").alias("ref_pos"), F.col("__n.b_start").alias("ref_start_ms"),
        F.col("__n.b_end").alias("ref_end_ms"), F.lit(0).cast("bigint").alias("overlap_ms"))
    pairs = matched.unionByName(fallback).withColumnRenamed("a_start", "start_ms").withColumnRenamed("a_end", "end_ms")
    union = F.greatest("ref_end_ms", "end_ms") - F.least("ref_start_ms", "start_ms")
    pairs = pairs.withColumn(
        "iou", F.when(F.col("overlap_ms") > 0, F.col("overlap_ms") / F.greatest(union, F.lit(1))).otherwise(0.0))
    return hyp.select(*keys, "pos", "start_ms", "end_ms").join(pairs, [*keys, "start_ms", "end_ms"])


def zip_by_position(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of both sides at the same position, for recordings with equal counts.

    Gives (keys, pos, text_a, text_b).
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    equal = count(a, "__na").join(count(b, "__nb"), keys).where("__na = __nb").select(*keys)
    left = a.select(*keys, "pos", F.col("text").alias("text_a"))
    right = b.select(*keys, "pos", F.col("text").alias("text_b"))
    return left.join(right, [*keys, "pos"]).join(equal, keys, "left_semi")


def attach_by_index(requests: DataFrame, responses: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Put responses on requests by ``idx``: the latest (``ord``) wins, empty falls back to the source."""
    last = responses.groupBy(*keys, "idx").agg(F.max_by("text", "ord").alias("__t"))
    out = requests.join(last, [*keys, "idx"], "left")
    return out.withColumn("text", F.coalesce(F.nullif("__t", F.lit("")), F.col("text"))).drop("__t")
