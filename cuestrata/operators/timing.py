"""Media time: parsing, printing, shifting, and spans of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.functions.text import strip
from cuestrata.operators.ordered import number_rows

KEYS = ["recording_id"]


def _sides(timing: Column) -> tuple[Column, Column]:
    """Text before and after the first arrow."""
    left = F.substring_index(timing, "-->", 1)
    right = F.when(timing.contains("-->"), F.substring(timing, F.length(left) + 4, F.length(timing)))
    return left, right


def _clock_ms(side: Column, mode: str) -> Column:
    side = strip(side)
    clock, ms = F.substring_index(side, ",", 1), F.substring_index(side, ",", -1)
    part = F.split(clock, ":")
    if mode == "strict":
        # unsigned integers of any width; further colon parts are ignored
        shape = r"^\+?\d+:\+?\d+:\+?\d+(:[^,]*)?,\+?\d+$"
        unit = lambda c: strip(c).try_cast("bigint")
    elif mode == "swap":
        # exactly three signed integers, blanks around them allowed
        shape = r"^\s*[+-]?\d+\s*:\s*[+-]?\d+\s*:\s*[+-]?\d+\s*,\s*[+-]?\d+\s*$"
        unit = lambda c: strip(c).try_cast("bigint")
    elif mode == "decimal":
        number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
        shape = f"^{number}:{number}:{number},{number}$"
        unit = lambda c: c.try_cast("double")
    else:
        raise ValueError(f"unknown timing mode {mode!r}")
    total = unit(part[0]) * 3600000 + unit(part[1]) * 60000 + unit(part[2]) * 1000 + unit(ms)
    return F.when(side.rlike(shape), F.round(total).cast("bigint"))


def swapped_times(timing: Column) -> Column:
    """Struct whose ``ok`` says that a timing text is one in ``swap`` mode."""
    left, right = _sides(timing)
    s, e = _clock_ms(left, "swap"), _clock_ms(F.when(~right.contains("-->"), right), "swap")
    return F.struct((s.isNotNull() & e.isNotNull()).alias("ok"))


def parse_timing(cues: DataFrame, mode: str = "strict", timing_col: str = "timing") -> DataFrame:
    """Add ``start_ms``, ``end_ms`` and ``timing_ok`` from ``H:M:S,ms --> H:M:S,ms``.

    ``strict``: unsigned integers, an end before the start is an error.
    ``decimal``: decimal parts, exactly three, reversed ranges allowed.
    ``swap``: signed integers, reversed ranges are swapped.
    Errors give null times.
    """
    left, right = _sides(F.col(timing_col))
    if mode == "swap":
        right = F.when(~right.contains("-->"), right)
    df = cues.withColumns({"__s": _clock_ms(left, mode), "__e": _clock_ms(right, mode)})
    if mode == "swap":
        start, end = F.least("__s", "__e"), F.greatest("__s", "__e")
    else:
        start, end = F.col("__s"), F.col("__e")
    ok = F.col("__s").isNotNull() & F.col("__e").isNotNull()
    if mode == "strict":
        ok = ok & (F.col("__e") >= F.col("__s"))
    return df.withColumns({
        "start_ms": F.when(ok, start), "end_ms": F.when(ok, end), "timing_ok": ok,
    }).drop("__s", "__e")


def clock(ms: Column | str) -> Column:
    """``HH:MM:SS,mmm``; negatives print as zero, hours may pass 99."""
    t = F.greatest(F.lit(0).cast("bigint"), F.col(ms) if isinstance(ms, str) else ms)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000,
    )


def format_timing(cues: DataFrame) -> DataFrame:
    """Set ``timing`` from ``start_ms`` and ``end_ms``."""
    return cues.withColumn("timing", F.concat(clock("start_ms"), F.lit(" --> "), clock("end_ms")))


def shift_cues(cues: DataFrame, offset_ms: Column | int) -> DataFrame:
    by = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms).cast("bigint")
    return cues.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by})


def reindex(cues: DataFrame, keys: list[str] = KEYS, dense: bool = False) -> DataFrame:
    """``idx`` = place in the recording, from 1.

    ``dense`` says that ``pos`` already runs 0, 1, 2, ... and saves the counting pass.
    """
    if dense:
        return cues.withColumn("idx", (F.col("pos") + 1).cast("int"))
    out = number_rows(cues.drop("idx"), keys, ["pos"], "__p")
    return out.withColumn("idx", (F.col("__p") + 1).cast("int")).drop("__p")


def duration(cues: DataFrame, strict: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Latest end per recording; null if zero, and under ``strict`` if any cue is bad."""
    longest = F.greatest(F.max("end_ms"), F.lit(0))
    value = F.when(longest > 0, longest)
    if strict:
        value = F.when(F.bool_and(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()), value)
    return cues.groupBy(*keys).agg(value.alias("duration_ms"))


def span(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest start and latest end of a cue range; null unless all parse and end > start."""
    ok = F.bool_and(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    first, last = F.min("start_ms"), F.greatest(F.max("end_ms"), F.lit(0))
    good = ok & (last > first)
    return cues.groupBy(*keys).agg(
        F.when(good, first).alias("span_start_ms"), F.when(good, last).alias("span_end_ms"))
