"""Running values over ordered groups of any size.

Two ways give the same values:

* *Whole groups*: plain windows, partitioned by the keys.  However many scans follow each other,
  the input is read and shuffled once, as all windows share one partitioning and one order.
* *Blocks*: the order is cut into blocks of bounded size.  Each block is windowed by itself,
  one summary row a block is carried along the group and the carried value is joined back,
  so no group is one task; but each scan reads its input twice.

``one_pass`` chooses for an operator: groups of up to ``WHOLE_ROWS`` rows, which is nearly all of
them, go the first way in one plan, and only larger ones the second.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata.session import stage

#: Rows of a group that one task may order at most.
WHOLE_ROWS = 100_000
ROWS_PER_BLOCK = 8192
BLOCK = "__block"


#: Whether the plan being built may take groups whole; None while nobody has decided.
_whole: ContextVar[bool | None] = ContextVar("whole", default=None)


def taken_whole() -> bool:
    """Whether the operator being built has its groups whole, each in one partition of the windows' exchange."""
    return bool(_whole.get())


def _decided(whole: bool, build: Callable[[], DataFrame]) -> DataFrame:
    token = _whole.set(whole)
    try:
        return build()
    finally:
        _whole.reset(token)


def one_pass(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Decide once, for all scans that ``operator`` makes, which groups of its first argument are taken whole.

    One narrow count of the keys in each table finds the large groups.  Without any, the whole plan is plain
    windows.  With some, they alone go by blocks, if the operator reads no other table; if it does, all groups do.
    """
    spec = inspect.signature(operator)

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        if _whole.get() is not None:
            return operator(df, *args, **kwargs)
        bound = spec.bind(df, *args, **kwargs)
        bound.apply_defaults()
        keys = list(bound.arguments["keys"])
        tables = [x for x in [df, *args, *kwargs.values()] if isinstance(x, DataFrame) and set(keys) <= set(x.columns)]
        counts = [x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WHOLE_ROWS).select(*keys) for x in tables]
        if all(c.isEmpty() for c in counts):
            return _decided(True, lambda: operator(df, *args, **kwargs))
        if len(tables) > 1:
            return _decided(False, lambda: operator(df, *args, **kwargs))
        large = stage(counts[0], "large")
        small = _decided(True, lambda: operator(df.join(large, keys, "left_anti"), *args, **kwargs))
        return small.unionByName(_decided(False, lambda: operator(df.join(large, keys, "left_semi"), *args, **kwargs)))

    return run


def _scan_whole(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    here = Window.partitionBy(*keys)
    before = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "max_before": lambda v: F.max(v).over(before), "sum_before": lambda v: F.coalesce(F.sum(v).over(before), F.lit(0)),
        "last_before": lambda v: F.last(v, ignorenulls=True).over(before), "next_after": lambda v: F.last(v, ignorenulls=True).over(after)}
    return df.withColumns({name: kinds[kind](value) for name, (kind, value) in specs.items()})


def row_block(order: str = "pos", rows: int = ROWS_PER_BLOCK) -> Column:
    """Block number of a position that is unique within its group."""
    return F.floor(F.col(order) / F.lit(rows))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    block: Column | None = None,
) -> DataFrame:
    """Add running columns; ``specs`` maps a name to (kind, expression).

    Kinds, all excluding the row itself: ``max_before``, ``sum_before``,
    ``last_before`` (latest non-null) and ``next_after`` (nearest non-null).
    ``order`` must be unique within ``keys``; ``block`` must not decrease along it
    and defaults to runs of ``ROWS_PER_BLOCK`` positions of the first order column.
    """
    if _whole.get():
        return _scan_whole(df, keys, order, specs)
    base = df.withColumn(BLOCK, row_block(order[0]) if block is None else block)
    sort_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    here = Window.partitionBy(*keys, BLOCK)
    before = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carried, merged = {}, [], {}, {}
    for name, (kind, value) in specs.items():
        loc, tot, car = f"__l_{name}", f"__t_{name}", f"__c_{name}"
        present = F.when(value.isNotNull(), sort_key)
        if kind == "max_before":
            local[loc] = F.max(value).over(before)
            totals.append(F.max(value).alias(tot))
            carried[car] = F.max(tot).over(along)
            merged[name] = F.greatest(loc, car)
        elif kind == "sum_before":
            local[loc] = F.sum(value).over(before)
            totals.append(F.sum(value).alias(tot))
            carried[car] = F.sum(tot).over(along)
            merged[name] = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
        elif kind == "last_before":
            local[loc] = F.last(value, ignorenulls=True).over(before)
            totals.append(F.max_by(value, present).alias(tot))
            carried[car] = F.last(tot, ignorenulls=True).over(along)
            merged[name] = F.coalesce(F.col(loc), F.col(car))
        elif kind == "next_after":
            local[loc] = F.last(value, ignorenulls=True).over(after)
            totals.append(F.min_by(value, present).alias(tot))
            carried[car] = F.last(tot, ignorenulls=True).over(back)
            merged[name] = F.coalesce(F.col(loc), F.col(car))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    summary = base.groupBy(*keys, BLOCK).agg(*totals)
    carry = summary.withColumns(carried).select(*keys, BLOCK, *carried)
    joined = base.withColumns(local).join(carry, [*keys, BLOCK], "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in merged.items()])


def lag_of(*cols: str) -> tuple[str, Column]:
    """Spec for the previous row's columns, as a struct, keeping their nulls."""
    return "last_before", F.struct(*cols)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str = "pos", block: Column | None = None
) -> DataFrame:
    """Add a dense 0-based position along ``order``."""
    out = scan(df, keys, order, {"__seq": ("sum_before", F.lit(1).cast("bigint"))}, block)
    return out.withColumn(name, F.col("__seq").cast("int")).drop("__seq")
