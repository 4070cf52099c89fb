"""Silence logs: lines of a detector's text output to silence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestrata.operators.intervals import merge_intervals
from cuestrata.operators.ordered import row_block, scan

KEYS = ["recording_id"]
NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def silence_from_lines(
    lines: DataFrame, recordings: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None, block=None
) -> DataFrame:
    """Merged silences of log ``line`` rows in ``order``.

    An end closes the latest start since the end before it; a start still open at the
    end of the log closes at the recording's duration.
    """
    order = order or ["pos"]
    line = F.col("line")
    value = lambda mark: F.regexp_extract(line, mark + r":\s*" + NUMBER + r"(?=[\s|]|$)", 1).try_cast("double")
    starts = line.contains("silence_start:")
    start, end = F.when(starts, value("silence_start")), F.when(~starts, value("silence_end"))
    df = lines.select(*keys, *order, *([] if block is None else [block.alias("__blk")]), start.alias("__s"), end.alias("__e"))
    df = df.where("__s is not null or __e is not null")
    # the latest event before an end is either the start it closes or an end that used it up
    event = F.struct("__s", F.col("__e").isNull().alias("open"))
    df = scan(df, keys, order, {"__p": ("last_before", event), "__n": ("next_after", F.lit(1))},
              row_block(order[0]) if block is None else F.col("__blk"))
    opened = F.when(F.col("__p")["open"], F.col("__p")["__s"])
    closed = df.where("__e is not null").select(*keys, opened.alias("s"), F.col("__e").alias("e"))
    length = recordings.select(*keys, (F.col("duration_ms") / 1000).alias("__d"))
    hanging = df.where("__s is not null and __n is null").join(length, keys).select(*keys, F.col("__s").alias("s"), F.col("__d").alias("e"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    both = closed.unionByName(hanging).where("e > s").select(*keys, ms("s").alias("start_ms"), ms("e").alias("end_ms"))
    return merge_intervals(both, keys)


def read_silence_log(spark: SparkSession, path: str, recordings: DataFrame) -> DataFrame:
    """Read detector logs below ``path``; the recording is the file, lines keep their order."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("recording_id"), F.col("_metadata.file_block_start").alias("__from"),
        F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    return silence_from_lines(raw, recordings, KEYS, ["__from", "__id"], F.col("__from"))
