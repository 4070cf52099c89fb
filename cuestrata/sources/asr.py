"""Recogniser output: segment JSON in, shifted and merged segments out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestrata.operators.intervals import BLOCK_MS
from cuestrata.operators.ordered import number_rows
from cuestrata.sources.text_store import TextStore

WORD = T.StructType([T.StructField("probability", T.DoubleType())])
SEGMENT = T.StructType([
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
    T.StructField("avg_logprob", T.DoubleType()), T.StructField("no_speech_prob", T.DoubleType()),
    T.StructField("compression_ratio", T.DoubleType()), T.StructField("words", T.ArrayType(WORD)),
])
DOCUMENT = T.StructType([T.StructField("segments", T.ArrayType(SEGMENT))])


def _ms(secs: Column) -> Column:
    return F.round(secs * 1000).cast("bigint")


def segments_from(df: DataFrame, keys: list[str], segments: str = "segments") -> DataFrame:
    """Clean segment rows from an array of recogniser segments."""
    s = df.select(*keys, F.explode(segments).alias("s")).select(*keys, "s.*").where(F.col("end") > F.col("start"))
    probs = F.transform(F.filter("words", lambda w: w["probability"].isNotNull()),
                        lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w["probability"])))
    s = s.withColumn("__p", F.coalesce(probs, F.array().cast("array<double>")))
    n = F.size("__p")
    return s.select(
        *keys, _ms(F.col("start")).alias("start_ms"), _ms(F.col("end")).alias("end_ms"),
        F.coalesce("avg_logprob", F.lit(-1.5)).alias("avg_logprob"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("no_speech_prob", F.lit(0.0)))).alias("no_speech_prob"),
        F.greatest(F.lit(0.0), F.coalesce("compression_ratio", F.lit(1.0))).alias("compression_ratio"),
        F.when(n == 0, 0.0).otherwise(F.aggregate("__p", F.lit(0.0), lambda a, x: a + x) / n).alias("word_prob_mean"),
        F.when(n == 0, 0.0).otherwise(F.size(F.filter("__p", lambda x: x < 0.45)) / n).alias("low_word_prob_ratio"))


def asr_text_to_segments(df: DataFrame, keys: list[str], text_col: str = "json") -> DataFrame:
    """Segment rows of a table that has one recogniser JSON document per row."""
    return segments_from(df.withColumn("segments", F.from_json(text_col, DOCUMENT)["segments"]), keys)


def read_asr_segments(spark: SparkSession, path: str) -> DataFrame:
    """Read recogniser JSON files below ``path``; ``recording_id`` is the file."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return segments_from(raw.withColumn("recording_id", F.input_file_name()), ["recording_id"])


def merge_chunk_segments(segments: DataFrame, chunks: DataFrame, keys: list[str] = ("recording_id",)) -> DataFrame:
    """Segments of all chunks on the recording's own clock, without word figures.

    ``chunks`` gives each chunk's ``offset_ms`` per (keys, chunk_index).
    """
    keys = list(keys)
    offsets = chunks.select(*keys, "chunk_index", F.col("offset_ms").cast("bigint").alias("__off"))
    df = segments.where(F.col("end_ms") > F.col("start_ms")).join(offsets, [*keys, "chunk_index"])
    return df.select(
        *keys, "chunk_index", (F.col("start_ms") + F.col("__off")).alias("start_ms"), (F.col("end_ms") + F.col("__off")).alias("end_ms"),
        "avg_logprob", "no_speech_prob", "compression_ratio")


def segments_json(merged: DataFrame, keys: list[str] = ("recording_id",)) -> DataFrame:
    """One JSON line per merged segment, numbered in order of start: (keys, ``n``, ``json``).

    The form is the same for a recording of any length, and no document grows with it.
    """
    keys = list(keys)
    order = [c for c in ("start_ms", "chunk_index", "end_ms", "avg_logprob") if c in merged.columns]
    at = number_rows(merged, keys, order, "n", F.floor(F.col("start_ms") / BLOCK_MS))
    line = F.struct(
        (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"),
        "avg_logprob", "no_speech_prob", "compression_ratio")
    return at.select(*keys, "n", F.to_json(line).alias("json"))


def write_segments(merged: DataFrame, path: str, keys: list[str] = ("recording_id",)) -> None:
    """Write the JSON lines, one folder per recording; recordings written before stay.

    Lines are in order within a file, and files of a long recording sort by name.
    """
    keys = list(keys)
    lines = segments_json(merged, keys).repartitionByRange(*keys, "n").sortWithinPartitions(*keys, "n")
    lines.select(*keys, F.col("json").alias("value")).write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").text(path)


def store_segments(merged: DataFrame, store: TextStore, token: str) -> bool:
    """Add the JSON lines of a batch of recordings to a store."""
    return store.write(segments_json(merged, store.keys), "n", "json", token)
