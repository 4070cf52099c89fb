"""Quality reports: flat rows, scene rows, warnings, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.operators.quality import SEMANTIC, feature_table, semantic_gate, semantic_health, structural_health
from cuestrata.operators.runs import checkpoint_summary, recovery_events
from cuestrata.operators.scenes import scene_quality
from cuestrata.session import stage, write_folders
from cuestrata.sources.text_store import TextStore

KEYS = ["recording_id"]


def _percent(c: str):
    return F.concat(F.lit(f"{c}="), F.format_string("%.2f%%", F.col(c) * 100))


def quality_report(
    cues: DataFrame, lang: str = "en", profile: str = "balanced", keys: list[str] = KEYS,
    featured: DataFrame | None = None, scored: DataFrame | None = None,
) -> DataFrame:
    """One row per recording: structure, semantics, warnings and verdict; ``featured`` and ``scored`` as in ``semantic_health``."""
    gate = semantic_gate(semantic_health(cues, lang, keys, featured, scored), profile)
    df = gate.join(structural_health(cues, keys).drop("cue_count"), keys)
    warned = ("scene_low_ratio", "name_inconsistency", "malformed_ratio")
    warnings = F.concat_ws(", ", *[F.when(F.col(c) > 0, _percent(c)) for c in warned])
    summary = F.concat_ws(" ", F.concat(F.lit("cues="), F.col("cue_count").cast("string")), *[_percent(c) for c in SEMANTIC])
    return df.select(
        *keys, "cue_count", "top_line_ratio", "overlap_ratio", "non_empty_ratio", *SEMANTIC, "scene_count",
        warnings.alias("warnings"), (~F.col("pathological")).alias("passed"),
        F.when(F.col("pathological"), summary).otherwise("quality gate passed").alias("reason"))


def report_json(
    cues: DataFrame, lang: str = "en", profile: str = "balanced", keys: list[str] = KEYS, events: DataFrame | None = None
) -> DataFrame:
    """JSON lines (keys, ``line``, ``json``): line 0 is the report, line k its k-th scene.

    With the chunk ``events`` of the recordings, (one key, chunk_index, event_id, ts, success, ...), the report
    has a checkpoint section, and line -1 - c says why chunk c stands as failed.
    The form is the same for a recording of any length, and no document grows with it.
    """
    # defects of the lines and scores of the scenes are computed once, for the report and for its scenes
    featured = stage(feature_table(cues, keys), "features")
    scored = stage(scene_quality(featured, keys, featured=True), "scored")
    flat = quality_report(cues, lang, profile, keys, featured, scored)
    extra, failures = [], None
    if events is not None:
        runs = events.withColumnRenamed(keys[0], "run_id")
        failures = recovery_events(runs).withColumnRenamed("run_id", keys[0]).join(flat.select(*keys), keys, "left_semi")
        flat = flat.join(checkpoint_summary(runs).withColumnRenamed("run_id", keys[0]), keys, "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        extra = [F.struct(zero("completed_chunks"), zero("failed_chunks")).alias("checkpoint")]
    body = F.struct(
        F.lit("1.0").alias("version"), F.lit(lang).alias("target_language"), F.lit(profile).alias("quality_profile"),
        F.struct(
            "cue_count", F.struct("top_line_ratio", "overlap_ratio", "non_empty_ratio").alias("structural"),
            F.struct(*SEMANTIC, "scene_count").alias("semantic")).alias("quality"),
        *extra, "warnings", F.struct(F.col("passed").alias("pass"), "reason").alias("verdict"))
    item = F.struct(F.col("scene_id").alias("scene"), F.col("n").alias("cue_count"), "difficulty", "score", "floor", F.col("passed").alias("pass"))
    head = flat.select(*keys, F.lit(0).cast("bigint").alias("line"), F.to_json(body).alias("json"))
    out = head.unionByName(scored.select(*keys, F.col("scene_id").cast("bigint").alias("line"), F.to_json(item).alias("json")))
    if failures is not None:
        lost = F.struct("event", F.col("chunk_index").alias("chunk"), "reason")
        out = out.unionByName(failures.select(*keys, (-1 - F.col("chunk_index")).cast("bigint").alias("line"), F.to_json(lost).alias("json")))
    return out


def write_report(cues: DataFrame, path: str, **options) -> None:
    """Write the JSON lines, one folder per recording; recordings written before stay.  ``store_report`` makes few files."""
    keys = list(options.get("keys", KEYS))
    lines = report_json(cues, **options).repartitionByRange(*keys, "line").sortWithinPartitions(*keys, "line")
    write_folders(lines.select(*keys, F.col("json").alias("value")), path, keys)


def store_report(cues: DataFrame, store: TextStore, token: str, **options) -> bool:
    """Add the JSON lines of a batch of recordings to a store."""
    return store.write(report_json(cues, keys=store.keys, **options), "line", "json", token)
