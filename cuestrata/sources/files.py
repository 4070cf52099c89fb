"""Choosing what to process: finished outputs, source priority, placeholder files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions.text import ascii_lower

PRIORITY = {"given": 1, "chunked_asr": 2, "asr": 3, "sidecar": 4, "previous": 5}


def output_name(inputs: DataFrame, lang: str, path_col: str = "path") -> DataFrame:
    """Add ``output``: the input path with its extension replaced by ``.<lang>.srt``."""
    stem = F.regexp_replace(F.col(path_col), r"(?<=[^/])\.[^./]*$", "")
    return inputs.withColumn("output", F.concat(stem, F.lit(f".{lang}.srt")))


def pending(inputs: DataFrame, outputs: DataFrame, lang: str = "en", path_col: str = "path") -> DataFrame:
    """Inputs whose output is not among ``outputs`` (column ``output``) yet."""
    return output_name(inputs, lang, path_col).join(outputs.select("output"), "output", "left_anti")


def resolve_source(
    candidates: DataFrame, profile: str = "balanced", verify: bool = False, keys: list[str] = ("recording_id",)
) -> DataFrame:
    """One source per recording from rows (keys, kind, uri).

    Kinds in order: given, chunked_asr, asr, sidecar, previous.  Under ``strict`` a
    sidecar is refused; ``previous`` counts only for verification.
    """
    keys = list(keys)
    kind = F.col("kind")
    rank = F.lit(None).cast("int")
    for name, r in PRIORITY.items():
        rank = F.when(kind == name, r).otherwise(rank)
    if not verify:
        rank = F.when(kind != "previous", rank)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "uri", "kind")))
    df = candidates.groupBy(*keys).agg(best.alias("__b"))
    refused = (F.col("__b.kind") == "sidecar") & F.lit(profile == "strict")
    found = F.col("__b").isNotNull() & ~refused
    return df.select(
        *keys, F.when(found, F.col("__b.kind")).alias("kind"), F.when(found, F.col("__b.uri")).alias("uri"),
        F.when(F.col("__b").isNull(), "no source").when(refused, "sidecar refused").otherwise("ok").alias("status"))


def flag_placeholder(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``placeholder``: the text carries a stock mark, wherever it stands."""
    head = ascii_lower(text_col)
    hit = F.lit(False)
    for mark in rules.PLACEHOLDER_MARKS:
        hit = hit | head.contains(mark)
    return files.withColumn("placeholder", hit)
