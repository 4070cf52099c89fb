"""Windows of a fixed length that occur more than once in a corpus: the frame of substring dedup.

1. Each text becomes super-k-mers: runs of consecutive windows that share their minimiser, the
   smallest hash of ``m`` consecutive tokens in the window.  A loop of words or bytes is one run.  Only (document,
   start, windows, minimiser) travels at first; equal windows have equal minimisers, so a
   minimiser that occurs once rules its windows out.
2. What is left travels as one packed string per super-k-mer to the bucket of its minimiser,
   where an operator compares whole windows (``solve``).
3. A minimiser with more super-k-mers than one task should hold is dealt out anew: equal packed
   strings are folded first, then windows meet by a 128-bit digest, in Spark aggregations.

Nothing is dropped at any size: the bound of step 3 only chooses between two exact ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import (
    LAST_ID, by_row, byte_values, forget, lean, mix, multiplier, partitions, row_slices, sliding_min, span_hashes, stage, text_buffer, text_key, text_or_empty, word_spans,
)

#: Super-k-mers of one minimiser that a single task compares at most.
HOT_ROWS = 2000
#: Tokens in one numpy pass, and bytes of packed strings compared at a time.
PIECE, CHUNK = 1 << 20, 1 << 20
_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``words`` or bytes, how many, and how many make a minimiser."""

    words: bool
    length: int
    m: int

    def tokens(self, buf: np.ndarray, offsets: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Values of all tokens, and the first token of each row."""
        if self.words:
            starts, ends, first = word_spans(buf, offsets)
            return span_hashes(buf, starts, ends, seed), first
        return byte_values(seed)[buf], offsets


def power_grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values: doubles the length as far as it can."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    whole, parts, have = values, [], 1
    levels = [values]
    while have * 2 <= n:
        whole = mix(whole[: len(whole) - have] * np.uint64(multiplier(have)) + whole[have:])
        levels.append(whole)
        have *= 2
    at, size = 0, len(values) - n + 1
    for bit in reversed(range(len(levels))):
        if n >> bit & 1:
            parts.append(levels[bit][at : at + size])
            at += 1 << bit
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * np.uint64(multiplier(999)) + p)
    return out


def super_kmers(values: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(row, start, windows, key, loop) of each run of windows with one minimiser; a loop has it at several places."""
    out = []
    for at in range(0, max(len(values) - unit.length + 1, 0), PIECE):
        part = values[at : at + PIECE + unit.length - 1]
        hashes = power_grams(part, unit.m)
        keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        low = sliding_min(keyed, unit.length - unit.m + 1)
        row = np.searchsorted(first, np.arange(at, at + len(part)), "right") - 1
        there = np.flatnonzero(row[: len(low)] == row[unit.length - 1 :])
        if not len(there):
            continue
        place = (low[there] & _PLACE).astype(np.int64)
        value = hashes[place]
        new = np.append(True, (value[1:] != value[:-1]) | (there[1:] != there[:-1] + 1))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(there))
        start = there[begin]
        out.append((row[start], at + start - first[row[start]], stop - begin, value[begin].view(np.int64), place[stop - 1] != place[begin]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """id (null doc_id: after all others), th, text (null: empty); neither key is null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_key().alias("th"), text_or_empty().alias("text"))


def light_runs(texts: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy() for c in (0, 1))
            buf, off = text_buffer(batch.column(2))
            for a, b in row_slices(off):
                row, start, n, key, loop = super_kmers(*unit.tokens(buf[off[a] : off[b]], off[a : b + 1] - off[a]), unit)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a + row]), pa.array(ths[a + row]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key), pa.array(loop)], names=["id", "th", "start", "n", "key", "loop"])

    return texts.mapInArrow(lean(run), "id long, th long, start int, n int, key long, loop boolean")


def repeated_runs(light: DataFrame, across: bool) -> DataFrame:
    """Runs whose minimiser occurs again (``across``: in another document; a loop repeats itself), and whether it is hot."""
    total = light.count()
    limit = min(HOT_ROWS, max(64, total // (2 * partitions(light.sparkSession))))
    again = F.col("lo") < F.col("hi") if across else (F.col("rows") > 1) | F.col("loops")
    counts = light.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("loop").alias("loops")).where(again)
    return light.join(counts.select("key", (F.col("rows") > limit).alias("hot")), "key")


def packed(texts: DataFrame, runs: DataFrame, unit: Unit) -> DataFrame:
    """Packed string of each run: id, th, start, n, key, loop, pack; words are joined by one space."""
    lists = runs.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "key", "loop")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy() for c in (0, 1))
            buf, off = text_buffer(batch.column(2))
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            start, n, key = (flat.field(i).to_numpy() for i in range(3))
            loop = flat.field(3)
            for a, b in row_slices(off):
                raw = buf[off[a] : off[b]].tobytes()
                lo, hi = bounds[a], bounds[b]
                row = by_row(np.diff(bounds[a : b + 1]))
                if unit.words:
                    starts, ends, first = word_spans(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    begin = first[row] + start[lo:hi]
                    last = begin + n[lo:hi] + unit.length - 2
                    sizes = np.append(0, np.cumsum(ends - starts))
                    count = last - begin
                    tight = ((ends[last] - starts[begin]) == sizes[last + 1] - sizes[begin] + count).tolist()
                    packs = []
                    for i, j, k, l, c, ok in zip(starts[begin].tolist(), ends[last].tolist(), begin.tolist(), last.tolist(), count.tolist(), tight, strict=True):
                        piece = raw[i:j]
                        packs.append(piece if ok and piece.count(b" ") == c else b" ".join([raw[s:e] for s, e in zip(starts[k : l + 1].tolist(), ends[k : l + 1].tolist(), strict=True)]))
                else:
                    begin = (off[a:b] - off[a])[row] + start[lo:hi]
                    packs = [raw[i:j] for i, j in zip(begin.tolist(), (begin + n[lo:hi] + unit.length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a + row]), pa.array(ths[a + row]), pa.array(start[lo:hi], pa.int32()), pa.array(n[lo:hi], pa.int32()), pa.array(key[lo:hi]), loop.slice(lo, hi - lo), pa.array(packs, pa.binary())],
                    names=["id", "th", "start", "n", "key", "loop", "pack"])

    joined = texts.join(lists, ["id", "th"]).select("id", "th", "text", "runs")
    return joined.mapInArrow(lean(run), "id long, th long, start int, n int, key long, loop boolean, pack binary")


@dataclass
class Bucket:
    """Whole groups of super-k-mers: members, and the distinct packed strings they stand for."""

    ids: np.ndarray
    ths: np.ndarray
    start: np.ndarray
    n: np.ndarray
    string: np.ndarray  # of each member
    packs: list[bytes]
    windows: np.ndarray  # of each string
    shared: np.ndarray  # whether a string's minimiser has other strings
    loop: np.ndarray  # whether a string has its minimiser at several places


def _bucket(rows: list[list]) -> Bucket:
    ids, ths, start, n, keys, loops, packs = rows
    seen: dict[tuple[int, bytes], int] = {}
    string = [seen.setdefault(x, len(seen)) for x in zip(keys, packs, strict=True)]
    strings = list(seen)
    windows = np.zeros(len(strings), np.int64)
    windows[string] = n
    loop = np.zeros(len(strings), bool)
    loop[string] = loops
    _, group, size = np.unique(np.array([k for k, _ in strings], np.int64), return_inverse=True, return_counts=True)
    return Bucket(np.array(ids), np.array(ths), np.array(start), np.array(n), np.array(string), [p for _, p in strings], windows, size[group] > 1, loop)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Yields members, the first and the end of a range of windows of each, and whether an earlier document has them.
Solve = Callable[[Bucket, Unit], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]]


def solved(packs: DataFrame, unit: Unit, solve: Solve) -> DataFrame:
    """Spans of tokens (id, th, start, end, later) to remove, bucket by bucket; ``solve`` yields members and window ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(7)], 0

        def results(rows):
            bucket = _bucket(rows)
            for member, a, b, later in solve(bucket, unit):
                start = bucket.start[member]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket.ids[member]), pa.array(bucket.ths[member]), pa.array(start + a, pa.int32()), pa.array(start + b + unit.length - 1, pa.int32()),
                    pa.array(np.full(len(member), later))], names=["id", "th", "start", "end", "later"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for column, values in zip(held, part.columns, strict=True):
                    column.extend(values.to_pylist())
                size += sum(map(len, held[6][-part.num_rows :]))
                if size >= CHUNK and held[4][0] != held[4][-1]:
                    cut = held[4].index(held[4][-1])  # equal keys stand together
                    yield from results([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
                    size = sum(map(len, held[6]))
        if held[0]:
            yield from results(held)

    dealt = packs.repartition(partitions(packs.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(run), "id long, th long, start int, end int, later boolean")


def folded(row: np.ndarray, w1: np.ndarray, w2: np.ndarray, loop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows and the cuts between groups: equal windows of one string are a group, in rising places.

    Only a loop has a window at several places, so all other windows are groups of their own.
    """
    inside = np.flatnonzero(loop)
    inside = inside[np.lexsort((w2[inside], w1[inside], row[inside]))]
    order = np.append(np.flatnonzero(~loop), inside)
    new = np.ones(len(order), bool)
    tail = new[len(order) - len(inside) :]
    tail[1:] = np.logical_or.reduce([x[inside][1:] != x[inside][:-1] for x in (row, w1, w2)])
    return order, np.append(np.flatnonzero(new), len(order))


def hot_spans(packs: DataFrame, unit: Unit, across: bool) -> DataFrame:
    """The same spans for hot minimisers, without a group that one task must hold."""
    packs = stage(packs.withColumn("digest", F.md5("pack")), "packs")
    # equal strings first: a large group of copies is folded before the shuffle
    strings = packs.groupBy("digest", "pack").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows"), F.max("loop").alias("loop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            members, loops = batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            for a, b in row_slices(off):
                part, rows = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                two = []
                for seed in (1, 2):
                    values, first = unit.tokens(part, rows, seed)
                    two.append(power_grams(values, unit.length).view(np.int64))
                each = np.maximum(np.diff(first) - unit.length + 1, 0)
                row = by_row(each)
                place = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(each)[:-1]), each)
                at = first[row] + place
                w1, w2 = two[0][at], two[1][at]
                order, cuts = folded(row, w1, w2, loops[a:b][row])
                head = order[cuts[:-1]]
                pick = pa.array(a + row[head])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pick), batch.column(2).take(pick), batch.column(3).take(pick), pa.array(members[a + row[head]] * np.diff(cuts)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place[order], pa.int32())), pa.array(w1[head]), pa.array(w2[head])],
                    names=["digest", "lo", "hi", "times", "places", "w1", "w2"])

    windows = stage(strings.select("digest", "pack", "lo", "hi", "rows", "loop").mapInArrow(lean(run), "digest string, lo long, hi long, times long, places array<int>, w1 long, w2 long"), "windows")
    again = F.col("first") < F.col("last") if across else F.col("times") > 1
    # both staged, so that each join reads two plain shuffles: a window of very many strings, or a string of very many copies, can be split
    found = stage(windows.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum("times").alias("times")).where(again).select("w1", "w2", "first"), "found")
    marked = stage(windows.select("digest", "places", "w1", "w2").join(found, ["w1", "w2"]).groupBy("digest").agg(F.collect_list(F.struct("places", "first")).alias("marks")), "marks")
    forget(windows, found)
    out = packs.select("id", "th", "start", "digest").join(marked, "digest").select("id", "th", "start", F.explode("marks").alias("w"))
    out = out.select("id", "th", "start", "w.first", F.explode("w.places").alias("place"))
    if across:
        out = out.where(F.col("first") < F.col("id"))
    begin = F.col("start") + F.col("place")
    return out.select("id", "th", begin.alias("start"), (begin + unit.length).alias("end"), (F.col("first") < F.col("id")).alias("later"))


def repeated_spans(texts: DataFrame, unit: Unit, across: bool, solve: Solve) -> DataFrame:
    """id, th, spans (start, end, later: also in an earlier document): the token spans of each document that repeated windows cover."""
    light = stage(light_runs(texts, unit), "light")
    runs = stage(repeated_runs(light, across), "runs")
    forget(light)
    spans = solved(packed(texts, runs.where(~F.col("hot")), unit), unit, solve)
    hot = runs.where("hot")
    if not hot.isEmpty():
        spans = spans.unionByName(hot_spans(packed(texts, hot, unit), unit, across))
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end", "later")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, spans (null: none) of every row."""
    texts = keyed_texts(docs)
    return texts.join(spans, ["id", "th"], "left").select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "text", "spans")


def span_mask(lists: pa.Array, first: np.ndarray, later: bool = False) -> np.ndarray:
    """Which tokens of a slice the spans cover (``later``: those alone that an earlier document has); ``first`` has the first token of each row."""
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten()
    row, start, end = by_row(counts), flat.field(0).to_numpy(), flat.field(1).to_numpy()
    if later:
        some = flat.field(2).to_numpy(zero_copy_only=False)
        row, start, end = row[some], start[some], end[some]
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edge, first[row] + start, 1)
    np.add.at(edge, first[row] + end, -1)
    return np.cumsum(edge)[:-1] > 0
