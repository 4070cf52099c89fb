"""Structural and semantic health of recordings, their gates, and translation quality."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import and_, eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from cuestrata import rules
from cuestrata.functions import text as T
from cuestrata.operators.names import name_inconsistency
from cuestrata.operators.ordered import lag_of, one_pass, scan, taken_whole
from cuestrata.session import stage
from cuestrata.operators.scenes import clamp, scene_low_ratio, scene_quality

KEYS = ["recording_id"]


@one_pass
def structural_health(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cue count, share of the most frequent line, of filled lines and of overlapping cues.

    Lines are counted first and recordings second, so a repeated line or a huge recording
    is folded before it is shuffled.  A recording with an unreadable time has
    ``timing_ok`` false and null ratios.
    """
    df = cues.select(*keys, "pos", "start_ms", "end_ms", T.health_key("text").alias("__k"))
    df = scan(df, keys, ["pos"], {"__e": ("max_before", F.col("end_ms"))})
    over = F.coalesce(F.col("start_ms") < F.col("__e"), F.lit(False))
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    by_line = df.groupBy(*keys, "__k").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(over.cast("bigint")).alias("__o"), F.sum(bad.cast("bigint")).alias("__b"))
    filled = F.when(F.col("__k") != "", F.col("__n"))
    sums = by_line.groupBy(*keys).agg(
        F.sum("__n").alias("cue_count"), F.coalesce(F.max(filled), F.lit(0)).alias("__top"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("__full"), F.sum("__o").alias("__over"),
        (F.sum("__b") == 0).alias("timing_ok"))
    n, ok = F.col("cue_count"), F.col("timing_ok")
    return sums.select(
        *keys, "cue_count", "timing_ok",
        F.when(ok, F.col("__top") / n).alias("top_line_ratio"),
        F.when(ok, F.when(n > 1, F.col("__over") / (n - 1)).otherwise(0.0)).alias("overlap_ratio"),
        F.when(ok, F.col("__full") / n).alias("non_empty_ratio"))


def _with_limits(df: DataFrame, limits: dict, profile) -> DataFrame:
    """Add one profile's limits: a name, or a column naming it per row."""
    if isinstance(profile, str):
        fixed = {f"__{n}": F.lit(float(v)) for n, v in limits[profile].items()}
        return df.withColumns({"profile": F.lit(profile), **fixed})
    table = rules.limits_frame(df.sparkSession, limits)
    table = table.select("profile", *[F.col(c).alias(f"__{c}") for c in table.columns[1:]])
    return df.withColumn("profile", profile).join(F.broadcast(table), "profile")  # three rows


def structural_gate(health: DataFrame, profile="balanced", scope: str = "recording") -> DataFrame:
    """Add ``pathological`` by the limits of a recording or of a chunk."""
    limits = {"recording": rules.RECORDING_LIMITS, "chunk": rules.CHUNK_LIMITS}[scope]
    df = _with_limits(health, limits, profile)
    bad = (F.col("cue_count") >= F.col("__min_cues")) & (
        (F.col("top_line_ratio") >= F.col("__max_top_line"))
        | (F.col("overlap_ratio") >= F.col("__max_overlap"))
        | (F.col("non_empty_ratio") < F.col("__min_non_empty")))
    return df.select(*health.columns, "profile", bad.alias("pathological"))


def chunk_health_score(health: DataFrame, profile="balanced") -> DataFrame:
    """Add ``quality_score``: mean of three clamped components, 1 for small chunks."""
    df = _with_limits(health, rules.CHUNK_LIMITS, profile)
    mean = (
        clamp(1 - F.col("top_line_ratio") / F.col("__max_top_line"), 0.0, 1.0)
        + clamp(1 - F.col("overlap_ratio") / F.col("__max_overlap"), 0.0, 1.0)
        + clamp(F.col("non_empty_ratio") / F.col("__min_non_empty"), 0.0, 1.0)) / 3
    score = F.when(F.col("cue_count") < F.col("__min_cues"), 1.0).otherwise(mean)
    return df.select(*health.columns, "profile", score.alias("quality_score"))


def feature_table(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Times and defect flags of cues, without their text."""
    return T.text_features(cues.select(*keys, "pos", "start_ms", "end_ms", "text")).drop("text")


def defect_ratios(featured: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Shares of cues with each text defect and with any of them, and ``more`` sums."""
    share = lambda c: F.avg(c.cast("double"))
    bad, low, rep = F.col("malformed"), F.col("low_function"), F.col("repeats")
    return featured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cue_count"), share(bad | low | rep).alias("anomaly_ratio"),
        share(bad).alias("malformed_ratio"), share(low).alias("low_function_ratio"),
        share(rep).alias("adjacent_repeat_ratio"), *more)


SEMANTIC = [
    "anomaly_ratio", "malformed_ratio", "low_function_ratio", "adjacent_repeat_ratio",
    "scene_low_ratio", "name_inconsistency",
]


@one_pass
def semantic_health(
    cues: DataFrame, lang: str = "en", keys: list[str] = KEYS, featured: DataFrame | None = None, scored: DataFrame | None = None
) -> DataFrame:
    """Fluency defects per recording; zero for targets other than English.

    A caller that has them already gives the ``feature_table`` of the cues and its scored scenes.
    """
    if lang.lower() != "en":
        zeros = [F.lit(0.0).alias(c) for c in SEMANTIC]
        return cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("cue_count")).select(
            *keys, "cue_count", F.lit(0).cast("bigint").alias("scene_count"), *zeros)
    if featured is None:
        featured = stage(feature_table(cues, keys), "features")
    if scored is None:
        scored = scene_quality(featured, keys, featured=True)
    scenes = scene_low_ratio(scored, keys)
    names = name_inconsistency(cues, keys)
    out = defect_ratios(featured, keys).join(scenes, keys, "left").join(names, keys, "left")
    return out.select(
        *keys, "cue_count", F.coalesce("scene_count", F.lit(0)).alias("scene_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SEMANTIC])


def semantic_gate(health: DataFrame, profile="balanced") -> DataFrame:
    """Add ``pathological``: any ratio at or above its limit."""
    df = _with_limits(health, rules.SEMANTIC_LIMITS, profile)
    bad = F.lit(False)
    for c in SEMANTIC:
        bad = bad | (F.col(c) >= F.col(f"__{c}"))
    return df.select(*health.columns, "profile", ((F.col("cue_count") > 0) & bad).alias("pathological"))


def semantic_penalty() -> Column:
    """Weighted sum of the defect ratios."""
    return (
        F.col("anomaly_ratio") * 1.3 + F.col("malformed_ratio") * 1.5
        + F.col("low_function_ratio") + F.col("adjacent_repeat_ratio") * 1.2)


def _excess(ratio: Column, start: float, width: float, weight: float) -> Column:
    return F.when(ratio > start, F.least((ratio - start) / width, F.lit(1.0)) * weight).otherwise(0.0)


def _collapse_penalty(unique: Column, tok: Column, top: Column, loop: Column, cues: Column, min_tokens: int, min_cues: int) -> Column:
    unique, top, loop = unique / tok, top / tok, loop / tok
    scarce = F.when(unique < 0.030, F.least((0.030 - unique) / 0.030, F.lit(1.0)) * 0.8).otherwise(0.0)
    penalty = clamp(scarce + _excess(top, 0.12, 0.18, 0.7) + _excess(loop, 0.15, 0.25, 0.5), 0.0, 1.4)
    return F.when((F.coalesce(tok, F.lit(0)) >= min_tokens) & (cues >= min_cues), penalty).otherwise(0.0)


def _repetition_penalty(top: Column, cues: Column, min_cues: int) -> Column:
    """``top`` is (minus the count, line) of the most frequent filled line, or null."""
    ratio = -top["f"] / cues
    stock = F.when(T.generic_interjection(top["k"]), _excess(ratio, 0.025, 0.12, 0.5)).otherwise(0.0)
    penalty = clamp(_excess(ratio, 0.04, 0.12, 1.0) + stock, 0.0, 1.6)
    return F.when((cues >= min_cues) & top.isNotNull(), penalty).otherwise(0.0)


def lexical_collapse(cues: DataFrame, keys: list[str] = KEYS, min_tokens: int = 200, min_cues: int = 80) -> DataFrame:
    """Penalty for a vocabulary that has collapsed onto few words."""
    n = cues.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cues"))
    words = cues.select(*keys, F.explode(T.lower_tokens("text")).alias("__t")).where(F.length("__t") >= 2)
    freq = words.groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("__f"))
    sums = freq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__uniq"), F.sum("__f").alias("__tok"), F.max("__f").alias("__top"),
        F.coalesce(F.sum(F.when(F.col("__t").isin(*rules.QUESTION_LOOP), F.col("__f"))), F.lit(0)).alias("__loop"))
    df = n.join(sums, keys, "left")
    penalty = _collapse_penalty(*(F.col(c) for c in ("__uniq", "__tok", "__top", "__loop", "__cues")), min_tokens, min_cues)
    return df.select(*keys, penalty.alias("lexical_collapse"))


def line_repetition(cues: DataFrame, keys: list[str] = KEYS, min_cues: int = 80) -> DataFrame:
    """Penalty for one line filling the recording; ties go to the first line in order."""
    freq = cues.groupBy(*keys, T.line_key("text").alias("__k")).agg(F.count(F.lit(1)).alias("__f"))
    filled = F.when(F.col("__k") != "", F.struct((-F.col("__f")).alias("f"), F.col("__k").alias("k")))
    top = freq.groupBy(*keys).agg(F.sum("__f").alias("__cues"), F.min(filled).alias("__top"))
    return top.select(*keys, _repetition_penalty(F.col("__top"), F.col("__cues"), min_cues).alias("line_repetition"))


_SUMS = (
    "__cues bigint, __bad bigint, __bad_n bigint, __rep bigint, __rep_n bigint, __flat bigint, __w double, "
    "__uniq bigint, __tok bigint, __top bigint, __loop bigint, __line struct<f:bigint,k:string>")
_WORD = re.compile("[a-z']+")
#: Different words and lines that a task holds of a recording it has only a part of.
UNITS = 100_000


class _Tally:
    """Sums of one recording; its words and lines are held as counts."""

    def __init__(self):
        self.cues = self.bad = self.bad_n = self.rep = self.rep_n = self.flat = 0
        self.weight, self.words, self.lines = 0.0, Counter(), Counter()

    def add(self, low: str | None, key: str | None, bad: bool | None, weight: float) -> None:
        self.cues += 1
        self.weight += weight
        if key:
            self.lines[key] += 1
        if low is None:
            return
        self.bad, self.bad_n, self.rep_n = self.bad + bad, self.bad_n + 1, self.rep_n + 1
        t = _WORD.findall(low)
        self.words.update(t)
        n = len(t)
        if n >= 4:
            same = list(map(eq, t, t[2:]))
            self.rep += any(map(eq, t, t[1:])) or any(map(and_, same, same[1:]))
        self.flat += n >= 8 and len(set(t)) / n < 0.45

    FLAGS = ("__cues", "__bad", "__bad_n", "__rep", "__rep_n", "__flat", "__w")

    def units(self) -> list:
        """Counts that can be added up: words, lines behind a space, flags behind a tab."""
        flags = zip(self.FLAGS, (self.cues, self.bad, self.bad_n, self.rep, self.rep_n, self.flat, self.weight))
        return [
            *([w, float(c)] for w, c in self.words.items() if len(w) >= 2), *([" " + k, float(c)] for k, c in self.lines.items()),
            *(["\t" + name, float(v)] for name, v in flags)]

    def sums(self) -> list:
        counts = {w: c for w, c in self.words.items() if len(w) >= 2}
        line = min(((-c, k) for k, c in self.lines.items()), default=None)
        some = lambda total: total if counts else None
        return [
            self.cues, self.bad, self.bad_n, self.rep, self.rep_n, self.flat, self.weight, len(counts), some(sum(counts.values())),
            max(counts.values(), default=None), some(sum(counts.get(w, 0) for w in rules.QUESTION_LOOP)), line and {"f": line[0], "k": line[1]}]


def _whole_sums(flags: DataFrame, keys: list[str]) -> DataFrame:
    """One row of sums per recording from (keys, low, key, bad, weight), streamed in the order of the keys."""
    return _tallied(flags, keys, _SUMS, lambda tally: [tally.sums()], None)


def _block_sums(flags: DataFrame, keys: list[str]) -> DataFrame:
    """The same sums of recordings that lie in many tasks: counts of a task's words, lines and flags meet by recording and unit."""
    t, f = F.col("__t"), F.col("__f")
    counts = _tallied(flags, keys, "__t string, __f double", _Tally.units, UNITS).groupBy(*keys, "__t").agg(F.sum("__f").alias("__f"))
    is_line, is_sum = t.startswith(" "), t.startswith("\t")
    word = F.when(~is_line & ~is_sum, f.cast("bigint"))
    return counts.groupBy(*keys).agg(
        *[F.sum(F.when(t == f"\t{name}", f)).alias(name) for name in _Tally.FLAGS],
        F.count(word).alias("__uniq"), F.sum(word).alias("__tok"), F.max(word).alias("__top"),
        F.coalesce(F.sum(F.when(t.isin(*rules.QUESTION_LOOP), word)), F.lit(0)).alias("__loop"),
        F.min(F.when(is_line, F.struct((-f).alias("f"), F.expr("substr(__t, 2)").alias("k")))).alias("__line"))


def _tallied(flags: DataFrame, keys: list[str], columns: str, give, most: int | None) -> DataFrame:
    """Rows that ``give`` makes of each recording's tally, or of parts of it with about ``most`` words and lines."""
    rows = flags.sortWithinPartitions(*keys)
    schema = T_.StructType([*(rows.schema[k] for k in keys), *T_.StructType.fromDDL(columns).fields])
    out_schema = to_arrow_schema(schema)

    def made(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in done], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tally, done = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            groups = zip(*columns[:-4], strict=True)
            for group, low, key, bad, weight in zip(groups, *columns[-4:], strict=True):
                if group != here or (most and len(tally.words) + len(tally.lines) > most):
                    if tally is not None:
                        done += [[*here, *r] for r in give(tally)]
                    here, tally = group, _Tally()
                tally.add(low, key, bad, weight)
            yield made(done)
            done = []
        if tally is not None:
            yield made([[*here, *r] for r in give(tally)])

    return rows.mapInArrow(stream, schema)


def _quality(sums: DataFrame, keys: list[str], min_tokens: int, min_cues: int) -> DataFrame:
    n = F.col("__cues")
    base = (F.try_divide("__bad", "__bad_n") * 1.5 + F.try_divide("__rep", "__rep_n") * 1.1
            + F.col("__flat") / n + F.col("__w") / n * 1.2)
    penalty = _collapse_penalty(*(F.col(c) for c in ("__uniq", "__tok", "__top", "__loop", "__cues")), min_tokens, min_cues)
    total = base + penalty + _repetition_penalty(F.col("__line"), n, min_cues)
    return sums.select(*keys, clamp(1.0 - total, 0.0, 1.0).alias("quality"))


@one_pass
def translation_quality(
    cues: DataFrame, lang: str = "en", keys: list[str] = KEYS, min_tokens: int = 200, min_cues: int = 80
) -> DataFrame:
    """One fluency score per recording; 1 for targets other than English."""
    if lang.lower() != "en":
        return cues.groupBy(*keys).agg(F.lit(1.0).alias("quality"))
    df = cues.select(*keys, "pos", "text")
    bad = T.malformed_contraction("text") | T.double_apostrophe("text")
    dup = F.coalesce((F.col("__k") != "") & (F.col("__p")["__k"] == F.col("__k")), F.lit(False))
    weight = F.when(dup & T.generic_interjection("__k"), 0.25).when(dup, 1.0).otherwise(0.0)
    if taken_whole():
        # one shuffle of the texts serves the window and all counts; each text is cut into words once
        df = df.repartition(*keys).withColumn("__k", T.line_key("text"))
        df = scan(df, keys, ["pos"], {"__p": lag_of("__k")})
        sums = _whole_sums(df.select(*keys, T.token_lower("text").alias("low"), "__k", bad.alias("bad"), weight.alias("w")), keys)
        return _quality(sums, keys, min_tokens, min_cues)
    df = scan(df.withColumn("__k", T.line_key("text")), keys, ["pos"], {"__p": lag_of("__k")})
    sums = _block_sums(df.select(*keys, T.token_lower("text").alias("low"), "__k", bad.alias("bad"), weight.alias("w")), keys)
    return _quality(sums, keys, min_tokens, min_cues)
