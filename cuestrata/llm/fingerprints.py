"""Document fingerprints by winnowing.

A rolling hash is taken of every k-gram of code points; of every window of w consecutive
k-grams the smallest hash is kept, the rightmost one of equals, together with its position.
Any passage of ``w + k - 1`` code points that two texts share gives both of them a common
entry, and a passage shorter than ``k`` never does (but for texts shorter than k, which are
one gram as a whole).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import SLICE_BYTES, grams, lean, mix, partitions, sliding_min, text_key, text_or_empty

K, WINDOW = 20, 60
#: Code points that one numpy pass works on.
PIECE = 1 << 20


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    return grams(mix(codes.astype(np.uint64) + np.uint64(0x51ED27)), k) >> np.uint64(32)


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and positions of one text, by position."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, n)
    keep: list[np.ndarray] = []
    for at in range(0, max(n - k - window + 2, 1), PIECE):
        part = codes[at : at + PIECE + k + window - 2]
        h = _hashes(part, k)
        # the low half makes the rightmost of equal hashes the smallest
        keyed = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(at, at + len(h), dtype=np.uint64))
        low = sliding_min(keyed, min(window, len(h)))
        keep.append(low[np.append(True, low[1:] != low[:-1])])
    kept = np.concatenate(keep)
    place = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
    place, first = np.unique(place, return_index=True)
    return (kept[first] >> np.uint64(32)).astype(np.int64), place


def winnow_all(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[list[int], list[int]]]:
    """``winnow`` of each text, several texts in one pass."""
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= PIECE):
            size += len(texts[to])
            to += 1
        codes = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts[at:to]])
        start = np.append(0, np.cumsum(sizes))
        wide = sizes >= k + window - 1
        if to - at > 1 and wide.any():
            h = _hashes(codes, k)
            keyed = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
            low = sliding_min(keyed, window)
            change = np.append(True, low[1:] != low[:-1])
            change[start[:-1][start[:-1] < len(low)]] = True
        for r in range(to - at):
            if to - at == 1 or not wide[r]:
                h, p = winnow(codes[start[r] : start[r + 1]], k, window)
                out[at + r] = h.tolist(), p.tolist()
                continue
            a, b = start[r], start[r + 1] - (k + window - 2)
            kept = low[a:b][change[a:b]]
            place = np.int64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF)).astype(np.int64) - a
            out[at + r] = (kept >> np.uint64(32)).tolist(), place.tolist()
        at = to
    return out


def likeness(a: list[int], b: list[int]) -> float:
    """Share of common hashes (Jaccard); two empty fingerprints are alike, one alone is not."""
    x, y = set(a), set(b)
    both = len(x & y)
    whole = len(x) + len(y) - both
    return both / whole if whole else 1.0


def written(print_: tuple[list[int], list[int]]) -> str:
    return " ".join(["%08x@%d" % x for x in zip(*print_, strict=True)])


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes (array<bigint>), positions (array<bigint>) of each whole text; null is empty.

    A text shorter than ``k`` has no hash; equal hashes in a window count by their rightmost place;
    repeated rows each give a row, an empty table none; other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = winnow_all(texts, k, window)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, texts), pa.int64()),
                pa.array([h for h, _ in prints], pa.list_(pa.int64())), pa.array([p for _, p in prints], pa.list_(pa.int64()))],
                names=["doc_id", "n_chars", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def in_descending_parts(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, th, text, part, tail: ranges of descending doc_id, each followed by the next range's first row.

    Rows go by doc_id descending (null last), then by a hash of the text.  ``tail`` marks the
    copies of first rows: one for each range, so their number never grows with the input.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), text_or_empty().alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    bounds = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts))))
    if bounds:
        bucket = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="id", outputCol="bucket", handleInvalid="keep")
        placed = bucket.transform(keyed.withColumn("id", F.col("doc_id").cast("double")))
        part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - F.col("bucket")).cast("int")
    else:
        placed, part = keyed, F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    placed = placed.withColumn("part", part)
    heads = placed.groupBy("part").agg(F.max(F.struct("doc_id", "th")).alias("h")).select("part", "h.*").orderBy("part").collect()
    rows = [(h.doc_id, h.th, h.part, heads[i - 1].part) for i, h in enumerate(heads)]
    first = spark.createDataFrame(rows, "h_id long, h_th long, h_part int, tail_part int")
    here = placed.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")) & (F.col("part") == F.col("h_part")), "left")
    both = F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.struct(F.col("tail_part").alias("part"), F.lit(True).alias("tail")))
    dealt = here.select("doc_id", "th", "text", F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("at")).select("doc_id", "th", "text", "at.part", "at.tail")
    return dealt.repartitionById(max([h.part for h in heads], default=0) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("th").desc())


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, compared.

    The edited text has its last half replaced by the start of the next document in
    descending doc_id.  Null texts count as empty; rows with one doc_id are ordered by a hash
    of their text, null ids come last; of a single row the next document is itself.  An empty
    fingerprint is ''.  Extra columns of the input are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row: its next isn't known yet
        for batch in batches:
            ids, parts, tails = (batch.column(c).to_pylist() for c in ("doc_id", "part", "tail"))
            column, at = batch.column("text"), 0
            while at < len(ids):
                texts, size = [], 0
                while at + len(texts) < len(ids) and (size == 0 or size < SLICE_BYTES):
                    texts.append(column[at + len(texts)].as_py())
                    size += len(texts[-1])
                to = at + len(texts)
                rows = held + list(zip(ids[at:to], parts[at:to], tails[at:to], texts, winnow_all(texts, k, window), strict=True))
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[2]]
                held, at = rows[-1:], to
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                prints = winnow_all(edited, k, window)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([written(a[4]) for a, _ in pairs], pa.string()), pa.array(map(written, prints), pa.string()),
                    pa.array([likeness(a[4][0], p[0]) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                    pa.array([likeness(a[4][0], b[4][0]) for a, b in pairs], pa.float64())], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]
    return in_descending_parts(docs, partitions(docs.sparkSession)).select("doc_id", "part", "tail", "text").mapInArrow(lean(run), schema)
