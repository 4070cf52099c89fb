"""Live view of chunk processing: progress, remaining time and the adaptive policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.operators.ordered import BLOCK, scan

BLOCK_SECS = 60
#: Events that one array holds at most.
PIECE = 4096
ORDER = ["ts", "event_id"]


def event_block() -> Column:
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / BLOCK_SECS)


def triggers(events: DataFrame, profile: str = "balanced") -> DataFrame:
    """Add ``slow``, ``low_quality`` and ``timed_out`` per event."""
    reason = F.coalesce("reason", F.lit("")) if "reason" in events.columns else F.lit("")
    ok = F.col("success")
    return events.withColumns({
        "slow": ok & ~F.col("from_cache") & (F.col("actual_secs") > F.col("predicted_secs") * 2),
        "low_quality": ~ok | (F.col("quality_score") < rules.MONITOR_FLOOR[profile]),
        "timed_out": ~ok & F.lower(reason).contains("timed out"),
    })


def chunk_monitor(events: DataFrame, totals: DataFrame, profile: str = "balanced") -> DataFrame:
    """One row per success event with progress so far and remaining seconds.

    ``totals`` gives ``total_predicted_secs`` per run.  A repeated success of a chunk
    replaces its earlier figures, so sums run over differences to the chunk's last success.
    """
    df = triggers(events, profile).where("success")
    base = F.greatest(F.col("predicted_secs"), F.lit(0.001))
    df = scan(df, ["run_id", "chunk_index"], ORDER, {"__p": ("last_before", F.struct("actual_secs", base.alias("pred")))}, event_block())
    old = F.col("__p")
    df = df.withColumns({
        "__da": F.col("actual_secs") - F.coalesce(old["actual_secs"], F.lit(0.0)),
        "__dp": base - F.coalesce(old["pred"], F.lit(0.0)),
        "__dn": F.when(old.isNull(), 1).otherwise(0).cast("bigint")})
    df = scan(df, ["run_id"], ORDER, {
        "__a": ("sum_before", F.col("__da")), "__q": ("sum_before", F.col("__dp")), "__n": ("sum_before", F.col("__dn"))}, event_block())
    actual, predicted = F.col("__a") + F.col("__da"), F.col("__q") + F.col("__dp")
    df = df.join(totals, "run_id")
    left = F.greatest(F.lit(0.0), F.col("total_predicted_secs") - predicted)
    eta = F.when(predicted > 0, left * F.greatest(F.lit(0.05), actual / predicted)).otherwise(0.0)
    return df.select(
        "run_id", "chunk_index", "event_id", "ts", (F.col("__n") + F.col("__dn")).alias("completed"),
        eta.alias("eta_secs"), "slow", "low_quality")


def adaptive_policy(events: DataFrame, profile: str = "balanced") -> DataFrame:
    """Policy of each run after all its events: timeout scale, extra retries, strict first pass.

    One event maps the scale x to clamp(a x, lo, hi) and the retry count through a table
    of four entries.  Both kinds of map stay of their kind when chained, so they are reduced as a
    tree: pieces of ``PIECE`` events of a minute, minutes, hours, days, runs.  An array holds a piece, or the
    pieces, minutes, hours or days of the level above, never a run's or a minute's events.
    """
    nth = F.row_number().over(Window.partitionBy("run_id", BLOCK).orderBy(*ORDER))
    df = triggers(events, profile).withColumn(BLOCK, event_block()).select(
        "run_id", BLOCK, F.floor((nth - 1) / PIECE).alias("__piece"), F.struct(*ORDER, "slow", "low_quality", "timed_out").alias("__e"))
    pieces = df.groupBy("run_id", BLOCK, "__piece").agg(F.array_sort(F.collect_list("__e")).alias("__es"))
    unit = F.struct(
        F.lit(1.0).alias("a"), F.lit(1.0).alias("lo"), F.lit(4.0).alias("hi"),
        F.array(*[F.lit(i) for i in range(4)]).alias("m"), F.lit(False).alias("strict"))

    def chain(f, g):
        """First ``f``, then ``g``."""
        squeeze = lambda x: F.least(g["hi"], F.greatest(g["lo"], g["a"] * x))
        lo, hi = squeeze(f["lo"]), squeeze(f["hi"])
        return F.struct(
            F.when(lo == hi, 0.0).otherwise(f["a"] * g["a"]).alias("a"), lo.alias("lo"), hi.alias("hi"),
            F.transform(f["m"], lambda v: g["m"][v]).alias("m"), g["strict"].alias("strict"))

    def table(slow, low, late):
        def one(v):
            if slow:
                v = min(v + 1, 2)
            if low:
                v = max(v, 1)
            if late:
                v = min(v + 1, 3)
            return v
        return F.array(*[F.lit(one(i)) for i in range(4)])

    def as_map(e):
        factor = F.when(e["slow"], 1.20).otherwise(0.98)
        first = F.struct(factor.alias("a"), F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"))
        late = e["timed_out"]
        lo = F.when(late, F.greatest(F.lit(1.0), 1.35 * first["lo"])).otherwise(first["lo"])
        hi = F.when(late, F.least(F.lit(4.0), 1.35 * first["hi"])).otherwise(first["hi"])
        moves = table(False, False, False)
        for slow in (False, True):
            for low in (False, True):
                for out in (False, True):
                    here = (e["slow"] == F.lit(slow)) & (e["low_quality"] == F.lit(low)) & (late == F.lit(out))
                    moves = F.when(here, table(slow, low, out)).otherwise(moves)
        return F.struct(
            F.when(late, factor * 1.35).otherwise(factor).alias("a"), lo.alias("lo"), hi.alias("hi"),
            moves.alias("m"), e["low_quality"].alias("strict"))

    level = pieces.select("run_id", BLOCK, "__piece", F.aggregate(F.transform("__es", as_map), unit, chain).alias("__f"))
    hour, day = F.floor(F.col(BLOCK) / 60), F.floor(F.col("__hour") / 24)
    for order, group in (("__piece", {BLOCK: F.col(BLOCK)}), (BLOCK, {"__hour": hour}), ("__hour", {"__day": day}), ("__day", {})):
        level = level.groupBy("run_id", *(c.alias(name) for name, c in group.items())).agg(F.array_sort(F.collect_list(F.struct(order, "__f"))).alias("__fs"))
        level = level.select("run_id", *group, F.aggregate(F.transform("__fs", lambda s: s["__f"]), unit, chain).alias("__f"))
    whole = level
    f = F.col("__f")
    return whole.select(
        "run_id", F.least(f["hi"], F.greatest(f["lo"], f["a"])).alias("timeout_scale"),
        f["m"][0].alias("extra_retry_budget"), f["strict"].alias("strict_first_pass"))
