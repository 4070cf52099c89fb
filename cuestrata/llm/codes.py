"""Vector codes by product quantisation, with LAESA pivots.

Vectors become integers and are cut into parts.  For each part position a few fixed pivots are
chosen from the first codebook, and the distances of every part to them are computed once and
staged with the integers.  In each round only the distances between pivots and the codebook's
entries are new: by the triangle inequality their differences to the staged distances are lower
bounds for part and entry.  A part is compared exactly, in integers, with the entry of the lowest
bound first and then only with entries whose bound doesn't exceed the best distance so far.

Codebooks and pivots are tables of a fixed size; sums and counts are added up in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestrata.llm.common import forget, lean, stage
from cuestrata.llm.whitening import common_length, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Fixed pivots of each part position.
PIVOTS = 4
#: An integer beyond this counts as this, so that squared distances are exact in 64 bits.
BOUND = 1 << 26
#: Vectors compared at a time, and pieces that equal labels are dealt over.
PIECE, SALTS = 512, 32
#: What staged distances, stored with 24 bits, and roots may be off, relatively; bounds give way by as much.
SLACK = 1e-6


def whole_numbers(vectors: DataFrame, vector: str, ident: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label, x (ints, filled up with zeros to a multiple of ``parts``), and the length of x."""
    held = lambda c: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c.cast("double") * SCALE))
    rows = usable(vectors, vector).select(
        F.col(ident).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, lambda c: F.floor(held(c)).cast("int")).alias("x"))
    d = common_length(rows, "x") or parts
    more = -d % parts
    rows = rows.where(F.size("x") == d)
    return (rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), more))) if more else rows), d + more


def first_codebooks(rows: DataFrame, d: int, parts: int, entries: int) -> np.ndarray:
    """[part, entry, position]: the vectors of the smallest ids, in their order."""
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    return np.array([r.x for r in first], np.int64).reshape(-1, parts, d // parts).transpose(1, 0, 2)


def choose_pivots(codebooks: np.ndarray, pivots: int) -> np.ndarray:
    """[part, pivot, position]: in each codebook the first entry, then always the one farthest from those chosen."""
    out = []
    for book in codebooks:
        chosen = [0]
        while len(chosen) < min(pivots, len(book)):
            nearest = ((book[:, None, :] - book[chosen][None]) ** 2).sum(axis=2).min(axis=1)
            chosen.append(int(nearest.argmax()))
        out.append(book[chosen])
    return np.array(out)


def with_pivot_distances(rows: DataFrame, d: int, pivots: np.ndarray) -> DataFrame:
    """Add far: the distances of all parts to the pivots of their position."""
    parts, count, q = pivots.shape
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                x = matrix(piece.column(2), d).astype(np.int64).reshape(-1, parts, 1, q)
                far = np.sqrt(((x - own) ** 2).sum(axis=3)).astype(np.float32).reshape(len(x), parts * count)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), parts * count).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=["vec_id", "label", "x", "far"])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema, T.StructField("far", T.ArrayType(T.FloatType()))]))


def nearest(x: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (the lower index of equals) and squared distance of each part, and how many exact
    distances it took; ``far`` has the distances to the pivots."""
    between = np.sqrt(((pivots[:, None, :] - book[None]) ** 2).sum(axis=2))
    low, size = np.zeros((len(x), len(book)), np.float32), np.zeros((len(x), 1), np.float32)
    for p in range(len(pivots)):
        np.maximum(low, np.abs(far[:, p, None] - between[p].astype(np.float32)), out=low)
        size = np.maximum(size, far[:, p, None])
    low -= SLACK * (size + np.float32(between.max(initial=0)))
    first = low.argmin(axis=1)
    best = ((x - book[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(low <= (np.sqrt(best) * (1 + SLACK)).astype(np.float32)[:, None])
    exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
    start = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(exact, start)
    tied = np.flatnonzero(exact == best[row])
    _, place = np.unique(row[tied], return_index=True)  # the lowest entry stands first
    return entry[tied[place]], best, len(row) + len(x)


def assigned(x: np.ndarray, far: np.ndarray, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries and squared distances [vector, part], and the exact distances computed."""
    code, error, work = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64), 0
    for p in range(x.shape[1]):
        code[:, p], error[:, p], n = nearest(x[:, p], far[:, p], books[p], pivots[p])
        work += n
    return code, error, work


def _pieces(batch: pa.RecordBatch, d: int, pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    parts, count, q = pivots.shape
    for at in range(0, batch.num_rows, PIECE):
        piece = batch.slice(at, PIECE)
        x = matrix(piece.column("x"), d).astype(np.int64).reshape(-1, parts, q)
        yield piece, x, matrix(piece.column("far"), parts * count).reshape(-1, parts, count)


def improved(table: DataFrame, d: int, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codebooks of the next round: floors of the means of the parts; an unused entry stays."""
    shared = table.sparkSession.sparkContext.broadcast((books, pivots))
    parts, count, q = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, pivots = shared.value
        sums, times = np.zeros((parts * count, q), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            for _, x, far in _pieces(batch, d, pivots):
                code, _, _ = assigned(x, far, books, pivots)
                unit = (code + np.arange(parts) * count).ravel()
                times += np.bincount(unit, minlength=parts * count)
                for k in range(q):
                    np.add.at(sums[:, k], unit, x[:, :, k].ravel())
        used = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(times[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["unit", "times", "sums"])

    partial = table.select("x", "far").mapInArrow(lean(run), "unit int, times long, sums array<long>")
    each = partial.select("unit", "times", F.posexplode("sums").alias("k", "s")).groupBy("unit", "k").agg(F.sum("times").alias("times"), F.sum("s").alias("s"))
    out = books.reshape(parts * count, q).copy()
    for r in each.collect():  # parts * entries * positions rows at most
        out[r.unit, r.k] = r.s // r.times
    return out.reshape(books.shape)


def coded(table: DataFrame, d: int, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, codes, error, evaluations (exact distances per vector, a mean of its piece)."""
    shared = table.sparkSession.sparkContext.broadcast((books, pivots))
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, pivots = shared.value
        for batch in batches:
            for piece, x, far in _pieces(batch, d, pivots):
                code, error, work = assigned(x, far, books, pivots)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel(), pa.int16()), parts).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([
                    piece.column("vec_id"), piece.column("label"), lists, pa.array(error.sum(axis=1)), pa.array(np.full(len(x), work / len(x)))],
                    names=["vec_id", "label", "codes", "error", "evaluations"])

    label = next(f.dataType.simpleString() for f in table.schema if f.name == "label")
    return table.select("vec_id", "label", "x", "far").mapInArrow(lean(run), f"vec_id long, label {label}, codes array<smallint>, error long, evaluations double")


def encode_vectors(
    vectors: DataFrame, vector: str = "embedding", ident: str = "vec_id", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, codes, error, evaluations) and the codebooks [part, entry, position].

    Rows go whose vector is null, empty or has a null or non-finite component.  If vectors differ in
    length, the commonest length is coded and the rows of others go; a length that isn't a
    multiple of ``parts`` is filled up with zeros.  Repeated rows are coded alike and all count;
    of equal ids the smaller vector comes first, null ids come last; with fewer vectors than ``entries`` the
    codebooks have one entry a vector.  An empty table gives no rows and empty codebooks.  Extra
    columns are not looked at.
    """
    rows, d = whole_numbers(vectors, vector, ident, label, parts)
    books = first_codebooks(rows, d, parts, entries)
    if not books.size:
        kind = rows.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, codes array<smallint>, error long, evaluations double"), books
    chosen = choose_pivots(books, pivots)
    table = stage(with_pivot_distances(rows, d, chosen), "pivots")
    for _ in range(rounds):
        books = improved(table, d, books, chosen)
    out = stage(coded(table, d, books, chosen), "codes")
    forget(table)
    return out, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """Add label_error: the error of all rows of the label, nulls together; a hot label is dealt over tasks."""
    sums = codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    many = sums.select("l", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return salted.join(many, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s", "salt")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256, evaluations."""
    codes, books = encode_vectors(vectors)
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    return label_errors(codes).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"), "evaluations")
