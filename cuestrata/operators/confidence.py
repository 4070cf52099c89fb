"""Recogniser confidence: per segment, per cue, and runs of doubtful cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.operators.joins import _spans, overlap_join
from cuestrata.operators.ordered import one_pass, scan
from cuestrata.operators.scenes import clamp
from cuestrata.session import stage

KEYS = ["recording_id"]
SIGNALS = ["avg_logprob", "no_speech_prob", "compression_ratio", "word_prob_mean", "low_word_prob_ratio"]


def segment_confidence(segments: DataFrame) -> DataFrame:
    """Add ``score`` in 0..1 and ``suspicious`` to recogniser segments."""
    logprob, silent, packed, mean, low = (F.col(c) for c in SIGNALS)
    score = clamp(
        clamp(F.exp(logprob), 0.0, 1.0) * 0.55 + clamp(mean, 0.0, 1.0) * 0.45 - silent * 0.45
        - F.least(F.lit(0.35), F.greatest(F.lit(0.0), packed - 2.0) / 2.0)
        - F.least(F.lit(0.25), low * 0.35),
        0.0, 1.0)
    suspicious = (
        (packed > 2.4) | ((silent > 0.70) & (logprob <= -1.25)) | (logprob <= -1.60)
        | ((mean > 0) & ((mean < 0.45) | (low > 0.55))))
    return segments.withColumns({"score": score, "suspicious": suspicious})


def cue_confidence(cues: DataFrame, segments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cues with overlap-weighted segment signals; null where no segment overlaps.

    Equal segments are summed and equal cue spans are joined once, so copies add nothing
    to the join.
    """
    names = ["score", *SIGNALS]
    segs = segment_confidence(segments.where(F.col("end_ms") > F.col("start_ms")))
    segs = segs.groupBy(*keys, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in names], F.bool_or("suspicious").alias("suspicious"))
    pairs = overlap_join(_spans(cues, keys, "a"), segs, keys)
    sums = pairs.groupBy(*keys, F.col("a_start").alias("start_ms"), F.col("a_end").alias("end_ms")).agg(
        F.sum(F.col("ov") * F.col("__n")).alias("__w"),
        *[F.sum(F.col(c) * F.col("ov")).alias(f"__{c}") for c in names], F.bool_or("suspicious").alias("suspicious"))
    means = sums.select(
        *keys, "start_ms", "end_ms",
        clamp(F.col("__score") / F.col("__w"), 0.0, 1.0).alias("score"),
        *[(F.col(f"__{c}") / F.col("__w")).alias(c) for c in SIGNALS], "suspicious")
    return cues.join(means, [*keys, "start_ms", "end_ms"], "left")


def adjusted_score() -> Column:
    """Cue score less small penalties for compression and weak words."""
    packed = F.least(F.lit(0.20), F.greatest(F.lit(0.0), F.col("compression_ratio") - 2.2) / 2.2)
    weak = F.least(F.lit(0.15), F.col("low_word_prob_ratio") * 0.20)
    return clamp(F.col("score") - packed - weak, 0.0, 1.0)


def mean_confidence(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean adjusted score over the covered cues of a group; null if none is covered."""
    value = F.when(F.col("score").isNotNull(), adjusted_score())
    return scored.groupBy(*keys).agg(F.avg(value).alias("mean_confidence"))


def is_low(profile: str) -> Column:
    floor = rules.CONFIDENCE_FLOOR[profile]
    score, mean = F.col("score"), F.col("word_prob_mean")
    low = (
        (score < floor) | F.col("suspicious") | (F.col("avg_logprob") <= -1.25)
        | ((mean > 0) & (mean < 0.42)) | (F.col("low_word_prob_ratio") > 0.60)
        | ((F.col("no_speech_prob") > 0.65) & (score < floor + 0.08)))
    return F.coalesce(score.isNotNull() & low, F.lit(False))


@one_pass
def low_confidence_spans(scored: DataFrame, profile: str = "balanced", keys: list[str] = KEYS) -> DataFrame:
    """Runs of low cues as half-open [``span_start``, ``span_end``) over dense ``pos``.

    A run goes on over one cue that is not low, never over two.  ``score`` is the mean
    adjusted score of all cues inside, bridged ones included.
    """
    df = scored.select(*keys, "pos", F.when(F.col("score").isNotNull(), adjusted_score()).alias("__v"), is_low(profile).alias("__low"))
    df = stage(df, "low")  # read by two rounds of scans
    low_pos = F.when(F.col("__low"), F.col("pos"))
    df = scan(df, keys, ["pos"], {"__last": ("last_before", low_pos), "__next": ("next_after", low_pos)})
    opens = F.col("__low") & (F.col("__last").isNull() | (F.col("pos") - F.col("__last") > 2))
    bridged = ~F.col("__low") & (F.col("pos") - F.col("__last") == 1) & (F.col("__next") - F.col("pos") == 1)
    df = df.withColumns({"__at": F.when(opens, F.col("pos")), "__in": F.col("__low") | F.coalesce(bridged, F.lit(False))})
    df = scan(df, keys, ["pos"], {"__run": ("last_before", F.col("__at"))}).where("__in")
    spans = df.groupBy(*keys, F.coalesce("__at", "__run").alias("span_start")).agg(
        (F.max("pos") + 1).cast("int").alias("span_end"), F.coalesce(F.avg("__v"), F.lit(0.0)).alias("score"))
    return spans.withColumn("floor", F.lit(rules.CONFIDENCE_FLOOR[profile]))
