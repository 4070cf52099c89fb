"""N-gram Jaccard join by rare-first prefix filtering, and the components that its links form.

1. Shingles are ordered rare first, by how often their slot of a fixed-size frequency table
   occurs in all documents, then by hash: one order for the whole corpus.
2. Documents with equal sets are one class.  Two classes can only link if the first shingles of
   both in that order, the prefixes, share one, so postings of prefixes are what is shuffled.
3. In a posting list, classes of compatible size form stars around a hub, so a
   large group of near copies costs as many pairs as it has members.  Pairs pass the length filter, the
   positional filter and a suffix filter: each set has 256 parity bits over parts of the hash space, and
   two sets differ in as many shingles at least as their bits do.  What is left is made distinct
   and verified once, on the texts.
4. Links make components.  Then the pairs of each posting list that lie in different components are
   verified as well, which no star has done; pairs inside a component can't change it.

Together that decides every pair that could join two components, so components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata.llm.common import LAST_ID, forget, grams, lean, lower_ascii, mix, partitions, row_slices, span_hashes, stage, text_buffer, text_key, word_spans
from cuestrata.llm.windows import keyed_texts

#: Slots of the frequency table; its size doesn't grow with the corpus.
SLOT_BITS = 20
SIGNS = ["s0", "s1", "s2", "s3"]
SHINGLE, PERCENT = 5, 80


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all k-word shingles, A-Z as a-z; a row of fewer words has one for the whole sequence."""
    low = lower_ascii(buf)
    starts, ends, first = word_spans(low, offsets)
    values = span_hashes(low, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    every = grams(values, k)
    inside = row[: len(every)] == row[k - 1 :] if len(every) else np.zeros(0, bool)
    rows, hashes = [row[: len(every)][inside]], [every[inside]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            hashes.append(mix(grams(values, n)[first[short]] + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def distinct_keys(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row, each row's keys in ascending order without repeats."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], key[new]


def slot_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each slot occur in all documents: summed in tasks, then by slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for a, b in row_slices(off):
                _, hashes = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], k)
                counts += np.bincount((hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(counts[slot])], names=["slot", "times"])

    table = texts.select("text").mapInArrow(lean(run), "slot int, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[table.column("slot").to_numpy()] = table.column("times").to_numpy()
    return out


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def set_rows(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """id, th, n (shingles), cid (class: equal sets), prefix (rare first), s0 to s3 (parity of the shingles in 256 parts of the hash space)."""
    counts = slot_counts(texts, k)
    rank = np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for a, b in row_slices(off):
                row, hashes = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], k)
                row, key = distinct_keys(row, rank[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))
                n = np.bincount(row, minlength=b - a)
                first = np.append(0, np.cumsum(n))
                place = np.arange(len(row)) - first[row]
                kept = place < prefix_size(n, percent)[row]
                sums = np.append(np.uint64(0), np.cumsum(mix(key)))
                cid = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64)
                signs = np.zeros((b - a, 4), np.uint64)
                np.bitwise_xor.at(signs, (row, ((key >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (key & np.uint64(63)))
                bounds = np.append(0, np.cumsum(np.bincount(row[kept], minlength=b - a)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(cid),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key[kept].view(np.int64))),
                    *(pa.array(signs[:, i].copy().view(np.int64)) for i in range(4))],
                    names=["id", "th", "n", "cid", "prefix", *SIGNS])

    return texts.mapInArrow(lean(run), "id long, th long, n long, cid long, prefix array<long>, s0 long, s1 long, s2 long, s3 long")


def posting_lists(classes: DataFrame, percent: int) -> DataFrame:
    """token, n, at (place of the token in the prefix), cid: members of posting lists that have a partner of compatible size.

    A list is streamed in the order of sizes, whatever its length, as neighbours show whether there is a partner.
    """
    names = ["token", "n", "at", "cid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last row, and whether the row before it is a partner
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
            token, n = columns[:2]
            if not len(token):
                continue
            near = np.flatnonzero((token[1:] == token[:-1]) & (n[:-1] * 100 >= percent * n[1:]))
            partner = np.zeros(len(token), bool)
            partner[near] = partner[near + 1] = True
            partner[0] |= known
            held, known = [c[-1:] for c in columns], bool(partner[-1])
            partner[-1] = False  # decided with the next batch
            yield pa.RecordBatch.from_arrays([pa.array(c[partner]) for c in columns], names=names)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)

    postings = classes.select("n", "cid", F.posexplode("prefix").alias("at", "token")).select("token", "n", F.col("at").cast("long").alias("at"), "cid")
    dealt = postings.repartition(partitions(classes.sparkSession), "token").sortWithinPartitions("token", "n", "cid")
    return dealt.mapInArrow(lean(run), "token long, n long, at long, cid long")


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the hub of its list and range of sizes (hub_n, hub_at, hub_cid).

    The hub has the fewest rare shingles before the token: what is rare in a group of near copies are
    edits, so the hub is near the group's common source.
    """
    ranged = lists.withColumn("range", F.floor(F.log("n") / math.log(100 / percent))) if percent < 100 else lists.withColumn("range", F.col("n"))
    hubs = ranged.groupBy("token", "range").agg(F.min(F.struct("at", "n", "cid")).alias("h"))
    return ranged.join(hubs, ["token", "range"]).select("n", "at", "cid", F.col("h.n").alias("hub_n"), F.col("h.at").alias("hub_at"), F.col("h.cid").alias("hub_cid"))


def may_link(n: Column, at: Column, other_n: Column, other_at: Column, percent: int) -> Column:
    """Length filter, and positional filter: with this first common shingle the overlap can still be large enough."""
    return (
        (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent)
        & ((100 + percent) * F.least(n - at, other_n - other_at) >= percent * (n + other_n)))


def alike(a: str, b: str, percent: int) -> Column:
    """Suffix filter: the parity bits of two linked sets differ in no more places than the sets may."""
    differ = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in SIGNS), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among distinct candidate pairs of classes: suffix filter, then the exact overlap of both texts."""
    side = lambda x: classes.select(F.col("cid").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *SIGNS)))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(alike("a_", "b_", percent)).select("a", "b")
    both = close.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")

    def sets(column: pa.Array) -> list[np.ndarray]:
        buf, off = text_buffer(column)
        out = []
        for a, b in row_slices(off):
            row, key = distinct_keys(*shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], k))
            out += np.split(key, np.cumsum(np.bincount(row, minlength=b - a))[:-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True)]
                link = pa.array([100 * c >= percent * (total - c) for c, total in common], pa.bool_())
                yield part.select([0, 1]).filter(link)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by alternating large and small stars until nothing changes.

    Every round is a written table, so a lost executor costs no replay, and the last one is what the
    result reads; rounds grow with the logarithm of the longest chain.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        out = large.join(small, "a").select("a", "b", "m")
        last, edges = edges, stage(out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(out.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, th, n, component (doc_id): the component of every row under ``100 * overlap >= percent * union``.

    ``id`` is the doc_id, null ones standing after all others.  Null, empty and blank texts have an
    empty set and are alone; rows with fewer than ``k`` words have one shingle.  Equal sets are
    linked, so copies and repeated rows share a component.
    """
    texts = keyed_texts(docs)
    rows = stage(set_rows(texts, k, percent), "sets")
    filled = rows.where("n > 0")
    classes = stage(filled.groupBy("cid").agg(F.min(F.struct("id", "th")).alias("of"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), *(F.first(x).alias(x) for x in SIGNS))
                    .select("cid", "n", "prefix", *SIGNS, F.col("of.id").alias("id"), F.col("of.th").alias("th")), "classes")
    lists = stage(posting_lists(classes, percent), "lists")
    light = classes.select("cid", "n", *SIGNS)
    needed = lists.select("cid").distinct().join(classes.select("cid", "id", "th"), "cid")
    # repeated rows have one text each; any of them serves
    fetched = stage(texts.join(needed, ["id", "th"]).dropDuplicates(["cid"]).select("cid", "text"), "texts")

    first = stars(lists, percent).where((F.col("cid") != F.col("hub_cid")) & may_link(F.col("n"), F.col("at"), F.col("hub_n"), F.col("hub_at"), percent))
    tried = stage(first.select(F.least("cid", "hub_cid").alias("a"), F.greatest("cid", "hub_cid").alias("b")).distinct(), "tried")
    links = stage(verify(tried, light, fetched, k, percent), "links")
    roots = components(links)

    named = lists.select("token", "n", "at", "cid").join(roots, lists.cid == roots.node, "left").select("token", "n", "at", "cid", F.coalesce("root", "cid").alias("root"))
    sizes = named.groupBy("token", "root").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("token").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("token", "main")
    open_ = stage(named.join(mixed, "token").join(light.drop("n"), "cid"), "open")
    left, right = open_.where("root <> main").alias("x"), open_.alias("y")
    across = left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent) & alike("x.", "y.", percent))
    more = across.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    later = stage(verify(more, light, fetched, k, percent), "links")
    if not later.isEmpty():
        roots = components(roots.toDF("a", "b").union(later))
    forget(lists, fetched, tried, links, open_, later)

    owner = classes.select("cid", "id").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "id", F.coalesce("root", "cid").alias("root"))
    least = owner.groupBy("root").agg(F.min("id").alias("component"))
    by_class = owner.select("cid", "root").join(least, "root").select("cid", "component")
    out = rows.select("id", "th", "n", "cid").join(by_class, "cid", "left")
    return out.select("id", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id of its component; null only if all are null)."""
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return jaccard_classes(docs, k, percent).select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, of equal ids the one whose text hash is smallest.

    Texts without words are no copies of each other: all of them stay.
    """
    classes = jaccard_classes(docs, k, percent)
    best = classes.where("n > 0").groupBy("component").agg(F.min(F.struct("id", "th")).alias("k")).select("k.*", F.lit(True).alias("filled"))
    alone = classes.where("n = 0").select("id", "th", F.lit(False)).distinct()
    chosen = best.union(alone).toDF("__class_id", "__class_th", "__filled")
    keyed = docs.withColumns({"__own": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__text": text_key()})
    kept = keyed.join(chosen, (F.col("__own") == F.col("__class_id")) & (F.col("__text") == F.col("__class_th")))
    # repeated rows share id and hash: one of them is kept
    nth = F.row_number().over(Window.partitionBy("__own", "__text").orderBy("__own"))
    return kept.withColumn("__nth", nth).where("__nth = 1 or not __filled").select(*docs.columns)
