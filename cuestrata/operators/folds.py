"""Order-dependent rules whose state is the row kept last.

Each fold is first cut, in Spark, at places where its state cannot matter; what lies
between two cuts is usually one row and skips Python altogether.  The rest is sorted by
Spark and streamed through a small Python state machine that holds one row, so even a
run that could not be cut is never collected.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from cuestrata import rules
from cuestrata.functions import text as T
from cuestrata.operators.intervals import BLOCK_MS
from cuestrata.operators.ordered import number_rows, one_pass, scan, taken_whole
from cuestrata.session import stage

KEYS = ["recording_id"]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one vectorised row at a time."""
    y = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, ch in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != ord(ch)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def _alike(a: str, b: str, floor: float = 0.6) -> bool:
    longest = max(len(a), len(b))
    if longest == 0 or a == b:
        return True
    if 1 - abs(len(a) - len(b)) / longest < floor:
        return False
    return 1 - edit_distance(a, b) / longest >= floor


# --------------------------------------------------------------------- stitching
WINDOW_MS = 3000


def _stitch_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drop rows that repeat the row kept last; ``__first`` starts a new run."""
    last = None
    for pdf in batches:
        keep = np.ones(len(pdf), dtype=bool)
        rows = zip(pdf["__first"], pdf["start_ms"], pdf["chunk_index"], pdf["text"])
        for i, (first, start, chunk, text) in enumerate(rows):
            if not first and last is not None:
                gap = abs(start - last[0])
                across = chunk != last[1] and gap < WINDOW_MS and _alike(last[2], text)
                if across or (gap < 2000 and text == last[2]):
                    keep[i] = False
                    continue
            last = (start, chunk, text)
        yield pdf[keep]


def stitch_chunks(chunk_cues: DataFrame, chunks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Merge the cues of overlapping chunks into one timeline, dropping repeats.

    ``chunks`` gives ``offset_ms`` per (keys, chunk_index).  A cue is dropped against the
    last *kept* one: from another chunk within 3 s and at least 0.6 similar, or from any
    chunk within 2 s with the same text.  A recording with one chunk is left unshifted.

    A cue is certainly kept, whatever was kept before it, when all cues of the 3 s before
    it come from its own chunk and none of the 2 s before has its text.  Such cues cut
    the fold; only cues near chunk edges and stutters remain for Python.
    """
    many = chunks.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias("__many"))
    info = chunks.select(*keys, "chunk_index", F.col("offset_ms").cast("bigint").alias("__off")).join(many, keys)
    df = chunk_cues.join(info, [*keys, "chunk_index"])
    by = F.when(F.col("__many"), F.col("__off")).otherwise(0)
    df = df.select(
        *keys, "chunk_index", "pos", (F.col("start_ms") + by).alias("start_ms"), (F.col("end_ms") + by).alias("end_ms"),
        "text", "__many")
    single = df.where("not __many").select(*keys, "chunk_index", "pos", "start_ms", "end_ms", "text")

    # rows of the last 3 s before a block's start are shown to the block as well
    multi = df.where("__many").drop("__many")
    block = F.floor(F.col("start_ms") / BLOCK_MS)
    shown = multi.withColumn("__home", block).withColumn(
        "__b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("start_ms") + WINDOW_MS) / BLOCK_MS)))))
    near = Window.partitionBy(*keys, "__b").orderBy("start_ms").rangeBetween(-(WINDOW_MS - 1), 0)
    same = Window.partitionBy(*keys, "__b", "text").orderBy("start_ms", "chunk_index", "pos")
    shown = shown.withColumns({
        "__lo": F.min("chunk_index").over(near), "__hi": F.max("chunk_index").over(near),
        "__said": F.lag("start_ms").over(same)}).where("__b = __home")
    fresh = F.col("__said").isNull() | (F.col("start_ms") - F.col("__said") >= 2000)
    sure = (F.col("__lo") == F.col("__hi")) & fresh
    marked = stage(shown.select(*multi.columns, sure.alias("__first")), "marked")
    # the row after a doubtful stretch closes it; runs are named by the sure row before them
    marked = marked.withColumn("__at", F.when(F.col("__first"), F.struct("start_ms", "chunk_index", "pos")))
    order = ["start_ms", "chunk_index", "pos"]
    marked = scan(marked, keys, order, {
        "__in": ("last_before", F.col("__at")), "__next": ("next_after", F.col("__first"))}, F.floor(F.col("start_ms") / BLOCK_MS))
    marked = marked.withColumn("__run", F.coalesce("__at", "__in"))
    lonely = F.col("__first") & F.coalesce(F.col("__next"), F.lit(True))
    cols = [*keys, "chunk_index", "pos", "start_ms", "end_ms", "text"]
    plain = marked.where(lonely).select(*cols)
    work = marked.where(~lonely).select(*cols, F.coalesce("__first", F.lit(False)).alias("__first"), "__run")
    # a stretch before the first sure row has no name: its first row starts it
    head = work.where("__run is null").groupBy(*keys).agg(F.min(F.struct(*order)).alias("__h"))
    work = work.join(head, keys, "left").withColumn(
        "__first", F.col("__first") | (F.col("__run").isNull() & (F.struct(*order) == F.col("__h"))))
    work = work.repartition(*keys, "__run").sortWithinPartitions(*keys, F.col("__run").asc_nulls_first(), *order)
    folded = work.select(*cols, "__first").mapInPandas(_stitch_fold, work.select(*cols, "__first").schema).select(*cols)
    return plain.unionByName(folded).unionByName(single)


def renumber_stitched(stitched: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Give stitched cues their final ``idx`` along (start, chunk, pos)."""
    out = number_rows(stitched, keys, ["start_ms", "chunk_index", "pos"], "__n", F.floor(F.col("start_ms") / BLOCK_MS))
    return out.withColumn("idx", F.col("__n") + 1).drop("__n")


# -------------------------------------------------------------------- compaction
_TOKEN = re.compile(r"[A-Za-z']+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _spoils(text: str, words: frozenset) -> bool:
    """Would the merged text repeat itself or run low on function words?"""
    toks = _TOKEN.findall(text)
    low = [t.lower() for t in toks]  # ASCII letters only
    n = len(low)
    if n >= 4 and any(low[i] == low[i + 1] for i in range(n - 1)):
        return True
    if any(low[i:i + 2] == low[i + 2:i + 4] for i in range(n - 3)):
        return True
    seen = {}
    for i in range(n - 2):
        if i - seen.setdefault(tuple(toks[i:i + 3]), i) >= 3:
            return True
    return n >= 6 and sum(t in words for t in low) / n < 0.10


def _joinable(left: str, right: str) -> bool:
    if not left or not right or "A" <= right[0] <= "Z" or left[-1] in ".?!:":
        return False
    if "[" in left or "]" in left or "[" in right or "]" in right:
        return False
    return len(left.split()) <= 8 and len(right.split()) <= 8


def _compact_fold(gap_ms, per_line, lines, cps, long_ms, schema, along=False):
    """State machine over sorted rows; a run never merges more than its ``__budget``, with ``along`` a recording's runs together."""
    words = frozenset(rules.FUNCTION_WORDS)

    def step(current, row, budget):
        """'skip', 'extend', 'merge' or 'break' for ``row`` after ``current``."""
        if row[2] == "":
            return "skip", None
        gap = max(0, row[0] - current[1])
        if gap > gap_ms:
            return "break", None
        if gap <= 120 and len(current[2]) == len(row[2]) <= 48 and current[2].translate(_LOWER) == row[2].translate(_LOWER):
            return "extend", None
        if current[3] >= budget or not _joinable(current[2], row[2]):
            return "break", None
        text = f"{current[2]} {row[2]}"
        took = max(1, row[1] - current[0])
        if took > long_ms or len(text) / (took / 1000) > cps or len(text) > per_line * lines or _spoils(text, words):
            return "break", None
        return "merge", text

    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow][:-6] + ["__run"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current, done = None, None, []

        def emit():
            nonlocal done
            if not done:
                return None
            frame = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow)], schema=arrow)
            done = []
            return frame

        def close():
            if current is not None:
                done.append((*key[:-1], current[4], current[0], current[1], current[2], key[-1], current[5]))

        for batch in batches:
            column = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            rows = zip(*[column(c) for c in ("start_ms", "end_ms", "text", "pos", "__budget")])
            for k, (start, end, text, pos, budget) in zip(zip(*map(column, names)), rows):
                merged = 0
                if along and current is not None and k[:-1] == key[:-1]:
                    merged = current[3]
                if current is not None and k == key:
                    what, joined = step(current, (start, end, text), budget)
                    if what == "skip":
                        continue
                    if what in ("extend", "merge"):
                        current[1] = max(current[1], end)
                        if what == "merge":
                            current[2] = joined
                            current[3] += 1
                            current[5] += 1
                        continue
                    merged = current[3]
                close()
                key = k
                # [start, end, text, merges in this run, pos, merges in this row]
                current = [start, end, text, merged, pos, 0]
            frame = emit()
            if frame is not None:
                yield frame
        close()
        frame = emit()
        if frame is not None:
            yield frame

    return fold


@one_pass
def compact_cues(
    cues: DataFrame, keys: list[str] = KEYS, max_gap_ms: int = 80, per_line: int = 36, lines: int = 2,
    max_cps: float = 21.0, max_ms: int = 6500,
) -> DataFrame:
    """Merge runs of short adjacent cues; gives (keys, pos, start_ms, end_ms, text, merges).

    ``pos`` is that of the first cue of each merged run.  A recording may merge at most
    max(20, cues / 16) times.  That budget is the only state crossing a cut.  A recording that is
    taken whole is folded once, its merges counted along the way, and nothing is staged.  In a large one, runs are
    first folded without the budget, their merges are summed along the recording, and only the
    runs left with less than they used are folded again.
    """
    norm = cues.select(*keys, "pos", "start_ms", "end_ms", T.collapse("text").alias("text"))
    # what makes a text unfit to go before or after another is found once a line; runs of white space are gone
    right = F.col("text")
    barred = right.contains("[") | right.contains("]") | (F.length(right) - F.length(F.replace(right, F.lit(" "), F.lit(""))) >= 8)
    norm = norm.withColumns({"__k": T.ascii_lower("text"), "__barred": barred})
    stops = F.substring(right, -1, 1).isin(".", "?", "!", ":")
    filled = F.when(right != "", F.struct(F.col("__k").alias("k"), (F.col("__barred") | stops).alias("u")))
    df = scan(norm, keys, ["pos"], {"__e": ("max_before", F.col("end_ms")), "__p": ("last_before", filled)})
    lkey, rkey = F.col("__p")["k"], F.col("__k")
    apart = F.col("start_ms") - F.col("__e") > max_gap_ms
    unfit = F.col("__p")["u"] | F.col("__barred") | F.substring(right, 1, 1).between("A", "Z")
    # a repeat of the merged text so far ends with the line before, so it is seen here too
    repeats = (rkey == lkey) | F.endswith(rkey, F.concat(F.lit(" "), lkey))
    cut = (right != "") & (apart | (unfit & ~repeats))
    first = F.col("__e").isNull()
    df = df.withColumn("__at", F.when(first | F.coalesce(cut, F.lit(False)), F.col("pos")))
    whole, after = taken_whole(), F.struct("__at")
    df = scan(df.drop("__e", "__p", "__k", "__barred"), keys, ["pos"], {
        "__in": ("last_before", F.col("__at")), **({} if whole else {"__after": ("next_after", after)})})
    if whole:
        # the next row itself, in the order that is there
        df = df.withColumn("__after", F.lead(after).over(Window.partitionBy(*keys).orderBy("pos")))
    df = df.withColumn("__run", F.coalesce("__at", "__in"))
    df = df.withColumn("__budget", F.greatest(F.lit(20), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 16))) if whole else stage(df, "runs")
    base = [*keys, "pos", "start_ms", "end_ms", "text"]
    # a run of one row: it starts at this row and the next row, if any, starts another
    lonely = F.col("__at").isNotNull() & (F.col("__after").isNull() | F.col("__after")["__at"].isNotNull())
    plain = df.where(lonely).select(*base, F.lit(0).cast("bigint").alias("merges"))
    work = df.where(~lonely).select(*base, "__run", *(["__budget"] if whole else []))

    types = {f.name: f.dataType.simpleString() for f in work.schema}
    width = [*keys, "pos", "start_ms", "end_ms", "text", "__run", "merges"]
    schema = T_.StructType.fromDDL(", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in width))
    fold = _compact_fold(max_gap_ms, per_line, lines, max_cps, max_ms, schema, whole)
    if whole:
        # sorted already: the windows left each recording in the order of its cues
        return plain.unionByName(work.sortWithinPartitions(*keys, "pos").mapInArrow(fold, schema).select(*plain.columns))

    def run(rows):
        ready = rows.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "pos")
        return ready.mapInArrow(fold, schema)

    free = stage(run(work.withColumn("__budget", F.lit(2**62))), "folded")
    sized = cues.groupBy(*keys).agg(F.greatest(F.lit(20), F.floor(F.count(F.lit(1)) / 16)).alias("__limit"))
    used = free.groupBy(*keys, "__run").agg(F.sum("merges").alias("__used"))
    over = used.groupBy(*keys).agg(F.sum("__used").alias("__all")).join(sized, keys).where("__all > __limit").select(*keys, "__limit")
    tight = scan(used.join(over, keys), keys, ["__run"], {"__sofar": ("sum_before", F.col("__used"))})
    tight = tight.withColumn("__budget", F.greatest(F.lit(0), F.col("__limit") - F.col("__sofar")).cast("bigint"))
    tight = tight.where("__budget < __used").select(*keys, "__run", "__budget")
    kept = free.join(tight, [*keys, "__run"], "left_anti")
    again = run(work.join(tight, [*keys, "__run"]).select(*base, "__run", "__budget"))
    return plain.unionByName(kept.select(*plain.columns)).unionByName(again.select(*plain.columns))


# ------------------------------------------------------------- chunk boundaries
@one_pass
def pick_boundaries(
    gaps: DataFrame, recordings: DataFrame, step_ms: int | str = 300_000, keys: list[str] = KEYS, stretch: int = 64
) -> DataFrame:
    """Greedy chunk boundaries: from each, go on to the silence nearest one step ahead.

    The next boundary depends on the present one alone, so it is looked up for every gap
    at once.  Chains of ``stretch`` steps are then followed inside bounded pieces of the
    timeline, the pieces are linked through their entry points, and the chosen chains
    are written out.  Recordings without gaps are cut evenly.  ``step_ms`` is one length for
    all, or names the column of ``recordings`` that has each one's.
    """
    step = F.col(step_ms) if isinstance(step_ms, str) else F.lit(step_ms)
    rec = recordings.select(*keys, F.col("duration_ms").cast("double").alias("__dur"), step.cast("double").alias("__step"))
    marks = stage(gaps.select(*keys, F.col("centroid_ms").cast("double").alias("b")).distinct().join(rec, keys), "marks")
    starts = marks.select(*keys, "__dur", "__step").distinct().withColumn("b", F.lit(0.0))
    froms = marks.select(*keys, "b", "__dur", "__step").unionByName(starts).distinct()
    step = F.col("__step")
    asks = froms.where(F.col("b") + step < F.col("__dur") - step * 0.3).select(
        *keys, (F.col("b") + step).alias("t"), F.lit(1).alias("q"), "b", "__step")
    usable = marks.where(F.col("b") < F.col("__dur") - step * 0.2).select(
        *keys, F.col("b").alias("t"), F.lit(0).alias("q"), "b", "__step")
    mark = F.when(F.col("q") == 0, F.col("t"))
    near = scan(usable.unionByName(asks), keys, ["t", "q", "b"],
                {"lo": ("last_before", mark), "hi": ("next_after", mark)}, F.floor(F.col("t") / BLOCK_MS)).where("q = 1")
    least = F.col("b") + step * 0.3
    lo, hi = F.when(F.col("lo") >= least, F.col("lo")), F.when(F.col("hi") >= least, F.col("hi"))
    nxt = F.when(lo.isNull() | (hi - F.col("t") < F.col("t") - lo), F.coalesce(hi, lo)).otherwise(lo)
    hops = near.select(*keys, "b", nxt.alias("nxt")).where("nxt is not null")
    hops = stage(froms.select(*keys, "b", "__step").join(hops, [*keys, "b"], "left").withColumn(
        "piece", F.floor(F.col("b") / (step * stretch))).drop("__step"), "hops")

    key_schema = ", ".join(f"`{k}` {recordings.schema[k].dataType.simpleString()}" for k in keys)

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Last jump of each chain inside its piece; rows come from the far end of a piece."""
        piece, seen = None, {}
        for pdf in batches:
            out = []
            for *k, b, nxt in pdf[[*keys, "piece", "b", "nxt"]].itertuples(index=False, name=None):
                if k != piece:
                    piece, seen = k, {}
                seen[b] = seen.get(nxt, nxt)
                out.append(seen[b])
            yield pdf[[*keys, "b"]].assign(out=np.array(out, dtype="float64"))

    far_first = hops.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", F.col("b").desc())
    leave = far_first.mapInPandas(exits, f"{key_schema}, b double, out double")
    leave = stage(leave.withColumn("out", F.when(~F.isnan("out"), F.col("out"))), "leave")
    entries = leave.where("out is not null").select(*keys, F.col("out").alias("b")).unionByName(starts.select(*keys, "b")).distinct()
    links = leave.join(entries, [*keys, "b"]).repartition(*keys).sortWithinPartitions(*keys, "b")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, want = None, None
        for pdf in batches:
            hit = np.zeros(len(pdf), dtype=bool)
            for i, (*k, b, out) in enumerate(pdf[[*keys, "b", "out"]].itertuples(index=False, name=None)):
                if k != key:
                    key, want = k, 0.0
                if b == want:
                    hit[i], want = True, out
            yield pdf[hit][[*keys, "b"]]

    on_path = links.mapInPandas(follow, f"{key_schema}, b double")
    chosen = on_path.join(rec, keys).select(*keys, F.col("b").alias("entry"), F.floor(F.col("b") / (step * stretch)).alias("piece"))
    todo = hops.join(chosen, [*keys, "piece"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows on the chain that starts at the piece's entry."""
        piece, at = None, None
        for pdf in batches:
            hit = np.zeros(len(pdf), dtype=bool)
            rows = pdf[[*keys, "piece", "b", "nxt", "entry"]].itertuples(index=False, name=None)
            for i, (*k, b, nxt, entry) in enumerate(rows):
                if k != piece:
                    piece, at = k, entry
                if b == at:
                    hit[i], at = True, nxt
            yield pdf[hit][[*keys, "b"]].rename(columns={"b": "boundary_ms"})

    near_first = todo.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "b")
    picked = near_first.mapInPandas(write, f"{key_schema}, boundary_ms double").where("boundary_ms > 0")
    bare = rec.join(marks.select(*keys).distinct(), keys, "left_anti").withColumn("__n", F.ceil(F.col("__dur") / step))
    even = bare.where("__n > 1").select(
        *keys, F.explode(F.transform(F.sequence(F.lit(1), F.col("__n") - 1), lambda i: i * step)).alias("boundary_ms"))
    return picked.unionByName(even)
