"""Suffix-array dedup over bytes: Burrows-Wheeler transforms of shards, merged by interleave refinement.

The strings of a bucket (see ``windows``) are cut into shards.  Each shard's suffixes are
sorted once, which gives its transform.  The shards are then merged without sorting suffixes
again: starting from "all of shard 0, then all of shard 1, ...", each round reads the
symbols before the suffixes in the present interleave and deals the shards' marks stably by
those symbols, after which the interleave is right for one symbol more.  The round in which a
border between neighbours appears is their common prefix, and stretches without a border are the
repeated intervals.

A symbol is the 64-bit hash of ``BLOCK`` consecutive bytes and the suffix after it starts
``BLOCK`` bytes on, so each string holds ``BLOCK`` interleaved sequences, each with an end of
its own, and a common prefix of ``length / BLOCK`` symbols is a common string of ``length`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import lean, row_slices, text_buffer
from cuestrata.llm.substrings import spans_of_rows, spread
from cuestrata.llm.windows import Bucket, Unit, keyed_texts, power_grams, repeated_spans, span_mask, with_spans

BYTES, MINIMISER, BLOCK = 400, 192, 50
#: Bytes of strings in one shard, about.
SHARD = 1 << 18


class Transform:
    """Transform of one shard: for each suffix in order, its node and the symbol before it (0: none).

    A node is a byte of the shard's text or the place behind one of its strings.  Suffixes are
    sorted by their first ``depth`` symbols, by doubling; equal ones stay in the order of nodes.
    """

    def __init__(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, depth: int):
        rank, have, step = symbols, 1, after
        while have < depth:
            more = min(have, depth - have)
            far = after
            for _ in range(more - 1):
                far = np.where(far >= 0, after[far], -1)
            step = far
            second = np.where(step >= 0, rank[step], 0)
            _, rank = np.unique(rank.astype(np.int64) * (int(rank.max()) + 1) + second, return_inverse=True)
            have += more
        self.node = np.argsort(rank, kind="stable")
        previous = before[self.node]
        self.symbol = np.where(previous >= 0, symbols[previous], 0)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of all shards, refined ``depth`` times: shard and rank in the shard of each suffix, and the
    common prefix (in symbols, ``depth`` at most) with the suffix before it."""
    sizes = [len(s.node) for s in shards]
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    symbols = np.concatenate([s.symbol for s in shards])
    block = np.zeros(len(shard), np.int64)
    common = np.full(len(shard), depth, np.int64)
    common[:1] = 0
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(depth):
        by_shard = np.argsort(shard, kind="stable")
        symbol = np.empty_like(symbols)
        symbol[by_shard] = symbols
        order = np.argsort(symbol, kind="stable")
        symbol, shard, block = symbol[order], shard[order], block[order]
        border = np.append(True, (symbol[1:] != symbol[:-1]) | ((block[1:] != block[:-1]) & (symbol[1:] > 0)))
        common[border & (common == depth)] = k
        block = np.cumsum(border)
        if border.all():
            break
    by_shard = np.argsort(shard, kind="stable")
    rank = np.empty(len(shard), np.int64)
    rank[by_shard] = np.arange(len(shard)) - base[shard[by_shard]]
    return shard, rank, common


def repeated_windows(
    strings: list[bytes], windows: np.ndarray, unit: Unit, block: int = BLOCK, shard_bytes: int = SHARD, ids: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window (of all strings, end to end) also starts elsewhere in the strings, and the smallest
    of the strings' ``ids`` among the windows equal to it."""
    raw = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    off = np.append(0, np.cumsum(size))
    values, _ = unit.tokens(raw, off)
    hashes = power_grams(values, block)
    # nodes: the bytes of each string and one place behind it
    node_off = off + np.arange(len(off))
    string = np.repeat(np.arange(len(strings)), size + 1)
    inside = np.arange(node_off[-1]) - node_off[string]
    full = inside + block <= size[string]
    _, ranked = np.unique(hashes[(off[string] + inside)[full]], return_inverse=True)
    symbols = np.zeros(len(string), np.int64)
    symbols[full] = ranked + 1
    node = np.arange(len(string))
    after = np.where(full, node + block, -1)
    before = np.where(inside >= block, node - block, -1)

    count = min(255, max(1, -(-len(raw) // shard_bytes)))
    cuts = np.unique(np.searchsorted(off, np.linspace(0, off[-1], count + 1)))
    cuts[0], cuts[-1] = 0, len(strings)
    shards = []
    for a, b in zip(node_off[cuts[:-1]].tolist(), node_off[cuts[1:]].tolist(), strict=True):
        part = slice(a, b)
        shards.append(Transform(symbols[part], np.where(after[part] >= 0, after[part] - a, -1), np.where(before[part] >= 0, before[part] - a, -1), unit.length // block))
    depth = unit.length // block
    shard, rank, common = merge(shards, depth)
    start = node_off[cuts[:-1]]
    nodes = np.concatenate([s.node for s in shards])
    base = np.concatenate([[0], np.cumsum([len(s.node) for s in shards])[:-1]])
    ordered = nodes[base[shard] + rank] + start[shard]
    same = common == depth  # as the suffix before it
    twice = same | np.append(same[1:], False)
    repeated = np.zeros(len(string), bool)
    repeated[ordered] = twice
    own = (np.zeros(len(strings), np.int64) if ids is None else ids)[string]
    least = np.empty_like(own)
    if len(own):
        # a repeated interval is a stretch without a border
        least[ordered] = np.minimum.reduceat(own[ordered], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    there = inside < windows[string]
    return repeated[there], least[there]


def solve_any(bucket: Bucket, unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Windows that start anywhere else: all those of a string with several members, and those that the merge finds."""
    count = np.bincount(bucket.string, minlength=len(bucket.packs))
    lo = np.full(len(bucket.packs), np.iinfo(np.int64).max)
    np.minimum.at(lo, bucket.string, bucket.ids)
    earliest = bucket.ids == lo[bucket.string]
    for later in (False, True):
        every = np.flatnonzero(~earliest if later else (count[bucket.string] > 1) & earliest)
        yield every, np.zeros(len(every), np.int64), bucket.n[every], later
    strings = np.flatnonzero(bucket.shared | bucket.loop)
    if len(strings):
        each = bucket.windows[strings]
        mask, least = repeated_windows([bucket.packs[s] for s in strings], each, unit, ids=lo[strings])
        of = np.repeat(np.arange(len(strings)), each)
        place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        for which, chosen, later in ((mask, count[bucket.string] == 1, False), (least < lo[strings][of], earliest, True)):
            begin, end = spans_of_rows(which, each)
            yield *spread(bucket, chosen, strings[of[begin]], place[begin], place[end - 1] + 1), later


def dedup_bytes(docs: DataFrame, length: int = BYTES, minimiser: int = MINIMISER) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary), n_later.

    ``n_later`` counts the removed bytes that a string of an earlier document covers: those that would go
    if the first document kept its passage.  ``length`` is a multiple of ``BLOCK``.  Null texts count as empty, and a null doc_id is a
    document of its own kind.  Repeated rows stand for one text each, so they remove each
    other's bytes from ``length`` bytes on.  Extra columns are not looked at.
    """
    if length % BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK}")
    unit = Unit(False, length, minimiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for a, b in row_slices(off):
                part, first = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                lists = batch.column(2).slice(a, b - a)
                gone = span_mask(lists, first)
                again = np.append(0, np.cumsum(span_mask(lists, first, True)))[first]
                begin, _ = spans_of_rows(gone, np.diff(first))
                left = np.append(0, np.cumsum(~gone))[first]
                kept = part[~gone].tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(left)), pa.array(np.diff(np.searchsorted(begin, first))),
                    pa.array([kept[x:y] for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(again))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_later"])

    spans = repeated_spans(keyed_texts(docs), unit, False, solve_any)
    return with_spans(docs, spans).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_later long")




def dedup_bytes_digests(docs: DataFrame) -> DataFrame:
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_later")
