"""Benchmark decontamination with SimHash over item-sized windows.

A window has as many words as the benchmark item it is held against.  Its SimHash, taken of
its word shingles, is looked up in a multi-index: four 16-bit blocks, each listing the items
within ``BLOCK_RADIUS`` bits of a value.  Fingerprints at most ``RADIUS`` bits apart agree to within
``BLOCK_RADIUS`` bits in one block at least, so the lookup misses none of them.  The pairs found
are verified exactly: the weighted Jaccard similarity of their shingles, a shingle's weight
being how often it occurs.

Windows without any shingle of an item have similarity 0 to it and get no fingerprint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import by_row, grams, lean, lower_ascii, row_slices, span_hashes, text_buffer

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_RADIUS = 4, 4
#: (BLOCK_RADIUS + 1) differing bits in each block are needed to be missed.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items looked for in one pass over the documents; more items take more passes.
ITEMS = 1024

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ONES = np.array([bin(v).count("1") for v in range(1 << 16)], np.uint8)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and non-ASCII characters; A-Z as a-z), and each row's first word."""
    solid = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.append(False, solid[:-1]) if len(buf) else solid
    after = np.append(solid[1:], False) if len(buf) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return span_hashes(lower_ascii(buf), starts, ends), np.searchsorted(starts, offsets)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes: a bit is set where most of a row's hashes have it."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=-1)
    most = bits.reshape(*shingles.shape, 64).sum(axis=1, dtype=np.int32) * 2 > shingles.shape[1]
    return np.packbits(most, axis=-1).view(np.uint64).ravel()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_ONES[((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for i in range(BLOCKS))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    whole = sum(a.values()) + sum(b.values()) - low
    return low / whole if whole else 0.0


@dataclass
class Items:
    """Index of one block of benchmark items."""

    ids: list[int | None]
    size: np.ndarray  # in words
    shingle: np.ndarray  # words in a shingle: fewer for an item that is shorter
    counts: list[Counter]
    prints: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]]  # by block: bounds by value, items
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by shingle size: hashes, bounds, items

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]], k: int) -> Items:
        ids, size, shingle, counts, prints = [], [], [], [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            values, _ = words(raw, np.array([0, len(raw)]))
            if not len(values):
                continue
            n = min(k, len(values))
            hashes = grams(values, n)
            ids.append(item)
            size.append(len(values))
            shingle.append(n)
            counts.append(Counter(hashes.tolist()))
            prints.append(simhash(hashes[None, :])[0])
        fingerprints = np.array(prints, np.uint64)
        near, value = [], np.arange(1 << 16)
        for i in range(BLOCKS):
            own = ((fingerprints >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
            pairs = [np.flatnonzero(_ONES[value ^ x] <= BLOCK_RADIUS) for x in own]
            values = np.concatenate(pairs) if pairs else value[:0]
            items = by_row(np.array([len(p) for p in pairs], np.int64)) if pairs else value[:0]
            order = np.argsort(values, kind="stable")
            near.append((np.searchsorted(values[order], np.arange((1 << 16) + 1)), items[order].astype(np.int32)))
        known = {}
        for n in set(shingle):
            of = [(h, i) for i, c in enumerate(counts) if shingle[i] == n for h in c]
            hashes, items = np.array([h for h, _ in of], np.uint64), np.array([i for _, i in of])
            order = np.argsort(hashes, kind="stable")
            unique, first = np.unique(hashes[order], return_index=True)
            known[n] = unique, np.append(first, len(order)), items[order]
        return Items(ids, np.array(size, np.int64), np.array(shingle, np.int64), counts, fingerprints, near, known)

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs within the radius."""
        windows, items = [], []
        for i, (bound, listed) in enumerate(self.near):
            value = ((prints >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64)
            times = bound[value + 1] - bound[value]
            window = by_row(times)
            items.append(listed[bound[value][window] + np.arange(len(window)) - (np.cumsum(times) - times)[window]])
            windows.append(window)
        window, item = np.concatenate(windows), np.concatenate(items).astype(np.int64)
        close = distance(prints[window], self.prints[item]) <= RADIUS
        pair = np.unique(window[close] * len(self.ids) + item[close])
        return pair // len(self.ids), pair % len(self.ids)


def _windows(items: Items, first: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """(start, words) of all windows that share a shingle of n words with an item of their size."""
    unique, bound, listed = items.known[n]
    table = np.zeros(1 << 20, bool)
    table[(unique >> np.uint64(44)).astype(np.int64)] = True
    hit = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(unique, hashes[hit]), len(unique) - 1)
    real = unique[at] == hashes[hit]
    hit, at = hit[real], at[real]
    row = np.searchsorted(first, hit, "right") - 1
    inside = hit + n <= first[row + 1]
    hit, at, row = hit[inside], at[inside], row[inside]
    times = bound[at + 1] - bound[at]
    which = by_row(times)
    item = listed[bound[at][which] + np.arange(len(which)) - (np.cumsum(times) - times)[which]]
    size, place, row = items.size[item], hit[which], row[which]
    low = np.maximum(place + n - size, first[row])
    high = np.maximum(np.minimum(place, first[row + 1] - size), first[row])  # a shorter text is one window
    each = np.maximum(high - low + 1, 0)
    of = by_row(each)
    start = low[of] + np.arange(len(of)) - (np.cumsum(each) - each)[of]
    return np.unique(np.stack([start, size[of]], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)


def match_slice(items: Items, values: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, start, words) of every window of a slice that is like an item of its size."""
    out = []
    for n in items.known:
        if len(values) < n:
            continue
        hashes = grams(values, n)
        pairs = _windows(items, first, n, hashes)
        for size in np.unique(pairs[:, 1]).tolist():
            start = pairs[pairs[:, 1] == size, 0]
            row = np.searchsorted(first, start, "right") - 1
            have = np.minimum(size, first[row + 1] - start)
            for words_there in np.unique(have).tolist():
                some = np.flatnonzero(have == words_there)
                count = words_there - n + 1
                for at in range(0, len(some), 1024):
                    pick = some[at : at + 1024]
                    rows = hashes[start[pick][:, None] + np.arange(count)]
                    window, item = items.lookup(simhash(rows))
                    ok = (items.size[item] == size) & (items.shingle[item] == n)
                    for w, i in zip(window[ok].tolist(), item[ok].tolist(), strict=True):
                        alike = similarity(Counter(rows[w].tolist()), items.counts[i])
                        if alike >= threshold:
                            out.append((int(row[pick[w]]), i, alike, int(start[pick[w]] - first[row[pick[w]]]), words_there))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words, n_windows: the best window of each document and item.

    Of equally good windows the first is given; ``start`` counts words.  Null and empty texts
    and items match nothing.  An item of fewer than ``k`` words is one shingle as a whole, and a text
    shorter than the item is one window.  Repeated rows each give theirs.  The benchmark is
    read in blocks of ``ITEMS`` items, each a pass over the documents, so what a task holds doesn't
    grow with it.  Extra columns are not looked at.
    """
    schema = "doc_id long, item_id long, similarity double, start long, n_words long, n_windows long"
    source = docs.select(F.col("doc_id").cast("long"), "text")

    def one(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                buf, off = text_buffer(batch.column(1))
                best: dict[tuple[int, int], list] = {}
                for a, b in row_slices(off):
                    values, first = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    for row, item, alike, start, size in match_slice(items, values, first, threshold):
                        seen = best.get((a + row, item))
                        if seen is None:
                            best[a + row, item] = [alike, start, size, 1]
                        else:
                            seen[3] += 1
                            if (-alike, start) < (-seen[0], seen[1]):
                                seen[:3] = alike, start, size
                keys = list(best)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([items.ids[i] for _, i in keys], pa.int64()), pa.array([best[x][0] for x in keys], pa.float64()),
                    *(pa.array([best[x][c] for x in keys], pa.int64()) for c in (1, 2, 3))], names=["doc_id", "item_id", "similarity", "start", "n_words", "n_windows"])

        return source.mapInArrow(lean(run), schema)

    return reduce(DataFrame.unionByName, map(one, indexes(benchmark, k)))


def indexes(benchmark: DataFrame, k: int) -> Iterator[Broadcast]:
    """Broadcast index of each block of ``ITEMS`` items, read block by block; one empty index if there are none."""
    context, rows, blocks = benchmark.sparkSession.sparkContext, [], 0
    for item in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        rows.append(tuple(item))
        if len(rows) == ITEMS:
            yield context.broadcast(Items.build(rows, k))
            rows, blocks = [], blocks + 1
    if rows or not blocks:
        yield context.broadcast(Items.build(rows, k))


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold a window like a benchmark item; all columns stay, no other row goes.

    Null and empty texts hold nothing and stay; texts of any length are looked at whole; repeated rows
    go or stay together; null, empty and equal items of the benchmark add nothing.  Without items or without
    documents nothing happens.  Only the column ``text`` is looked at, whatever the others are called.
    """
    place = docs.columns.index("text")

    def one(frame: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, off = text_buffer(batch.column(place))
                for a, b in row_slices(off):
                    clean = np.ones(b - a, bool)
                    values, first = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    clean[[r for r, *_ in match_slice(index.value, values, first, threshold)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        return frame.mapInArrow(lean(run), frame.schema)

    return reduce(one, indexes(benchmark, k), docs)
