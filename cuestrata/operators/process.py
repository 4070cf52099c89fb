"""Whole paths as one job: cues through a model to checked output, and silences to chunk plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.functions.repair import clean_translation
from cuestrata.operators.consistency import phrase_consistency
from cuestrata.operators.context import context_tags, context_windows, map_text_batches
from cuestrata.operators.folds import pick_boundaries
from cuestrata.operators.intervals import chunk_target_secs, plan_chunks
from cuestrata.operators.quality import structural_gate, structural_health
from cuestrata.operators.selection import compact_if_not_worse, enforce_gate
from cuestrata.session import forget, settled
from cuestrata.sources.report import quality_report

KEYS = ["recording_id"]


def process(
    cues: DataFrame, model: Callable[[list, list, list, list], list], profile: str = "balanced", lang: str = "en",
    radius: int = 2, keys: list[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(cues with ``status``, report) of a corpus taken through gate, model, repair and gate.

    ``cues`` has (keys, pos, start_ms, end_ms, text) with dense positions; ``model`` is the
    batch function of ``map_text_batches``.  Recordings that the first gate rejects keep their
    text and are in no report.  The steps: structural gate, model with context, one wording per phrase,
    repairs, compaction where it makes nothing worse, semantic gate.
    """
    # a text is staged once a step and shuffled once a step; what a step leaves goes with it
    base, timed = cues.select(*keys, "pos", "start_ms", "end_ms", "text"), [*keys, "pos", "start_ms", "end_ms"]
    first = settled(lambda: structural_gate(structural_health(base, keys), profile).select(*keys, "pathological"), "verdict")

    def answered():
        sound = enforce_gate(base, first, profile, keys).where("status <> 'rejected'").drop("status")
        ready = context_windows(context_tags(sound, profile, keys), radius, keys).withColumn("src", F.col("text"))
        return map_text_batches(ready, model).select(*timed, "src", F.col("text").alias("tgt"))

    answers = settled(answered, "answers")
    steady = settled(lambda: phrase_consistency(answers, keys, lang=lang).select(*timed, F.col("new_tgt").alias("text")), "steady")
    forget(answers)
    clean = settled(lambda: clean_translation(steady, keys).select(*timed, "text"), "clean")
    forget(steady)
    final = clean
    if profile == "strict":
        final = settled(lambda: compact_if_not_worse(clean, profile, lang, keys).drop("compacted"), "final")
        forget(clean)
    report = settled(lambda: quality_report(final, lang, profile, keys), "report")
    passed = enforce_gate(final, report.withColumn("pathological", ~F.col("passed")), profile, keys)
    if profile != "strict":
        return passed, report
    rejected = enforce_gate(base, first, profile, keys).where("status = 'rejected'").select(*passed.columns)
    return passed.unionByName(rejected), report


def plan_recordings(gaps: DataFrame, recordings: DataFrame, overlap: int = 2_000, keys: list[str] = KEYS) -> DataFrame:
    """Chunks of each recording by its own target length: from silences to boundaries to chunks.

    ``recordings`` has (keys, duration_ms) and, where it is known, ``avg_difficulty``.
    """
    if "avg_difficulty" not in recordings.columns:
        recordings = recordings.withColumn("avg_difficulty", F.lit(None).cast("double"))
    aimed = chunk_target_secs(recordings.withColumn("duration_secs", F.col("duration_ms") / 1000))
    rec = aimed.select(*keys, "duration_ms", (F.col("chunk_target_secs") * 1000).alias("target_ms"))
    return plan_chunks(pick_boundaries(gaps, rec, "target_ms", keys), rec, "target_ms", overlap, keys)
