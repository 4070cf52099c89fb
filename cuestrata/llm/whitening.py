"""Embedding whitening by incremental eigendecomposition.

1. Entries become integers and equal vectors are folded: the fit list.
2. Each partition keeps spectra (rows seen, mean, eigenvalues and eigenvectors of the scatter about
   that mean) and takes its rows in one by one.  A row is a centred rank-one update: in the
   present eigenbasis the new scatter is a diagonal plus ``rho z z'``, whose eigenvalues are the roots
   of the secular equation ``1 + rho sum(z_i^2 / (l_i - l)) = 0``, one between neighbouring old ones.
   Coordinates that the update doesn't reach, and all but one of equal eigenvalues, are deflated first.
3. Spectra are combined in levels: one takes in the other's scaled eigenvectors, and the step
   between the means, as successive rank-one updates.
4. Rayleigh-Ritz: the partitions project their centred rows on the combined basis, the sums of the
   projections' products are a small symmetric matrix, and its eigenvectors turn the basis into the
   components, to double precision.  A last pass over the list measures how white the result is.

Only d x d matrices of the dimension d leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import forget, lean, stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: An entry beyond this counts as this, so that sums stay exact in 64 bits.
BOUND = float(1 << 20)
#: Spectra of one task that are updated side by side, and the rows of a batch from which it is worth it.
SIDE_BY_SIDE, WORTH = 8, 1024
#: Partial results that one task joins.
FAN = 16
EPS = np.finfo(float).eps
#: A relative step so small ends the search for a root, which takes so many rounds at most.
NEAR, ROUNDS = 1e-7, 60


def roots(lam: np.ndarray, z: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(lam) + rho z z'``, and ``lam_i - root_j`` at [j, i]; leading axis: problems side by side.

    ``lam`` rises strictly and no ``z`` is zero.  Each root is kept as its distance from the nearer
    pole and found by rational interpolation between its two poles, held within its bracket.
    """
    k, d = lam.shape
    weight = rho[:, None] * z * z
    end = lam[:, -1] + weight.sum(axis=1)
    right = np.concatenate([lam[:, 1:], end[:, None]], axis=1)
    width = right - lam
    at_or_before = np.tri(d, dtype=bool)[None]  # [j, i]: pole i is not right of root j
    gaps = lam[:, None, :] - lam[:, :, None]

    def value(delta: np.ndarray) -> tuple[np.ndarray, ...]:
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = weight[:, None, :] / delta
            slopes = terms / delta
        f = 1 + terms.sum(axis=2)
        low = np.where(at_or_before, slopes, 0.0).sum(axis=2)
        return f, low, slopes.sum(axis=2) - low

    half = width / 2
    f, _, _ = value(gaps - half[:, :, None])
    from_right = (f < 0) & (np.arange(d) < d - 1)
    origin = np.where(from_right, right, lam)
    base = lam[:, None, :] - origin[:, :, None]
    lo = np.where(from_right, -half, np.where(f < 0, half, 0.0))
    hi = np.where(from_right, 0.0, np.where(f < 0, width, half))
    first = np.where(from_right, -rho[:, None] * np.roll(z, -1, axis=1) ** 2, weight)
    tau = np.where((first > lo) & (first < hi), first, (lo + hi) / 2)
    left_pole = lam - origin
    right_pole = right - origin
    done = np.zeros(tau.shape, bool)
    for _ in range(ROUNDS):
        f, low, high = value(base - tau[:, :, None])
        lo, hi = np.where(f <= 0, tau, lo), np.where(f >= 0, tau, hi)
        dl, dr = left_pole - tau, right_pole - tau
        a = (dl + dr) * f - dl * dr * (low + high)
        b = dl * dr * f
        c = f - dl * low - dr * high
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        last = np.abs(step) <= NEAR * np.abs(tau)  # convergence is quadratic
        inside = np.isfinite(new) & (((new > lo) & (new < hi)) | last)
        tau = np.where(done, tau, np.where(inside, new, (lo + hi) / 2))
        done |= (inside & last) | (f == 0) | (hi - lo <= 8 * EPS * np.abs(tau))
        if done.all():
            break
    return origin + tau, base - tau[:, :, None]


def turn(lam: np.ndarray, z: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New eigenvalues and the rotation of the old eigenvectors; ``z`` is computed anew from the
    roots, so that the rotation is orthogonal however close they lie."""
    d = lam.shape[1]
    new, delta = roots(lam, z, rho)
    j, i = np.arange(d)[:, None], np.arange(d)[None, :]
    pole = np.minimum(j + (j >= i), d - 1)
    below = lam[:, pole] - lam[:, None, :]
    below[:, -1, :] = rho[:, None]
    again = np.sqrt(np.abs(np.prod(-delta / below, axis=1))) * np.where(z < 0, -1.0, 1.0)
    rotation = (again[:, None, :] / delta).transpose(0, 2, 1)
    return new, rotation / np.sqrt((rotation * rotation).sum(axis=1, keepdims=True))


def deflated(lam: np.ndarray, basis: np.ndarray, z: np.ndarray, rho: float, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """One update with deflation: equal eigenvalues are rotated until one of them carries the update, and
    coordinates that it doesn't reach keep their eigenpair."""
    lam, basis, z = lam.copy(), basis.copy(), z.copy()
    for i in range(len(lam) - 1):
        if z[i] != 0 and lam[i + 1] - lam[i] <= tol:
            r = np.hypot(z[i], z[i + 1])
            c, s = z[i + 1] / r, z[i] / r
            basis[:, i], basis[:, i + 1] = c * basis[:, i] - s * basis[:, i + 1], s * basis[:, i] + c * basis[:, i + 1]
            z[i], z[i + 1] = 0.0, r
    some = np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > tol)
    if len(some):
        # an eigenvalue kept by rotation may lie within the tolerance of the next: the pole moves up by as much
        poles = np.maximum.accumulate(lam[some] + np.arange(len(some)) * np.spacing(max(1.0, np.abs(lam).max())))
        new, rotation = turn(poles[None], z[some][None], np.array([rho]))
        lam[some] = new[0]
        basis[:, some] = basis[:, some] @ rotation[0]
    order = np.argsort(lam, kind="stable")
    return lam[order], basis[:, order]


@dataclass
class Spectra:
    """Spectra side by side: rows seen, mean, eigenvalues (rising) and eigenvectors (columns) of the scatter."""

    n: np.ndarray
    mean: np.ndarray
    lam: np.ndarray
    basis: np.ndarray

    @staticmethod
    def empty(k: int, d: int) -> Spectra:
        return Spectra(np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), np.tile(np.eye(d), (k, 1, 1)))

    def rank_one(self, vector: np.ndarray, rho: np.ndarray) -> None:
        """Scatter plus ``rho vector vector'``, for each spectrum."""
        z = np.matmul(vector[:, None, :], self.basis)[:, 0]
        length = np.sqrt((z * z).sum(axis=1))
        tol = 8 * EPS * np.maximum(self.lam[:, -1], rho * length * length)
        plain = (np.diff(self.lam, axis=1) > tol[:, None]).all(axis=1) & (rho[:, None] * np.abs(z) * length[:, None] > tol[:, None]).all(axis=1) & (tol > 0)
        if plain.all():
            self.lam, rotation = turn(self.lam, z, rho)
            self.basis = np.matmul(self.basis, rotation)
            return
        for b in np.flatnonzero(~plain & (rho * length > 0)).tolist():
            self.lam[b], self.basis[b] = deflated(self.lam[b], self.basis[b], z[b], float(rho[b]), float(tol[b]))
        if plain.any():
            self.lam[plain], rotation = turn(self.lam[plain], z[plain], rho[plain])
            self.basis[plain] = np.matmul(self.basis[plain], rotation)

    def add(self, rows: np.ndarray) -> None:
        """One row to each spectrum."""
        step = rows - self.mean
        self.rank_one(step, self.n / (self.n + 1))
        self.n = self.n + 1
        self.mean = self.mean + step / self.n[:, None]

    def take_in(self, other: Spectra) -> None:
        """The other's rows, as successive rank-one updates."""
        total = self.n + other.n
        step = other.mean - self.mean
        self.rank_one(step, self.n * other.n / np.maximum(total, 1))
        for i in range(self.lam.shape[1]):
            self.rank_one(np.sqrt(np.maximum(other.lam[:, i], 0))[:, None] * other.basis[:, :, i], np.ones(len(total)))
        self.mean = self.mean + step * (other.n / np.maximum(total, 1))[:, None]
        self.n = total

    def part(self, which: slice) -> Spectra:
        return Spectra(self.n[which], self.mean[which], self.lam[which], self.basis[which])

    def joined(self) -> Spectra:
        """One spectrum of all, in halves."""
        own = self
        while len(own.n) > 1:
            half = (len(own.n) + 1) // 2
            left, right = own.part(slice(0, half)), own.part(slice(half, None))
            if len(right.n) < half:
                rest = Spectra.empty(1, own.lam.shape[1])
                right = Spectra(*(np.concatenate([getattr(right, x), getattr(rest, x)]) for x in ("n", "mean", "lam", "basis")))
            left.take_in(right)
            own = left
        return own


def integers(vector: str, scale: int, shift: int) -> Column:
    """Entries as longs: floor(scale * entry) + shift; entries beyond ``BOUND`` count as that."""
    held = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("double")))
    return F.transform(vector, lambda c: F.floor(held(c) * scale) + F.lit(shift).cast("long"))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vectors.where(F.coalesce(F.forall(vector, lambda c: fine(c.cast("double"))), F.lit(False)) & (F.size(vector) > 0))


def common_length(rows: DataFrame, column: str) -> int | None:
    """The length that most rows have, the larger one of equals; None if there is no row."""
    first = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def in_levels(parts: DataFrame, count: int, join: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Partial results (id, ...), ``FAN`` to a task, level by level until one is left."""
    while count > 1:
        count = -(-count // FAN)
        parts = parts.withColumn("id", F.floor(F.col("id") / FAN).cast("int")).repartition(count, "id").sortWithinPartitions("id").mapInArrow(join, parts.schema)
    return parts


def numbered(fit: DataFrame) -> int:
    """Partitions that a scan of the list has."""
    return max(1, fit.rdd.getNumPartitions())


_SPECTRUM = "id int, n long, sums array<long>, mean array<double>, lam array<double>, basis array<double>"


def _spectrum_batch(ident: int, n: int, sums: np.ndarray, one: Spectra) -> pa.RecordBatch:
    row = lambda x, kind: pa.array([np.asarray(x).ravel().tolist()], pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        pa.array([ident], pa.int32()), pa.array([n], pa.int64()), row(sums, pa.int64()), row(one.mean[0], pa.float64()), row(one.lam[0], pa.float64()), row(one.basis[0], pa.float64())],
        names=["id", "n", "sums", "mean", "lam", "basis"])


def spectra(fit: DataFrame, d: int) -> DataFrame:
    """A spectrum of each partition's rows, by rank-one updates; ``sums`` are exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wide, rest = Spectra.empty(SIDE_BY_SIDE, d), Spectra.empty(1, d)
        n, sums = 0, np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            n, sums = n + len(x), sums + x.sum(axis=0)
            y = (x - SHIFT).astype(float)
            whole = len(y) // SIDE_BY_SIDE if len(y) >= WORTH else 0
            for row in y[: whole * SIDE_BY_SIDE].reshape(whole, SIDE_BY_SIDE, d):
                wide.add(row)
            for row in y[whole * SIDE_BY_SIDE :]:
                rest.add(row[None])
        if wide.n[0]:
            rest.take_in(wide.joined())
        yield _spectrum_batch(TaskContext.get().partitionId(), n, sums, rest)

    return fit.select("x").mapInArrow(lean(run), _SPECTRUM)


def one_spectrum(parts: DataFrame, count: int, d: int) -> DataFrame:
    """All spectra taken in by one, in levels."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, Spectra]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                new = Spectra(np.array([float(r["n"])]), np.array([r["mean"]]), np.array([r["lam"]]), np.array(r["basis"]).reshape(1, d, d))
                if r["id"] not in held:
                    held[r["id"]] = (r["n"], np.array(r["sums"]), new)
                elif r["n"]:
                    n, sums, own = held[r["id"]]
                    own.take_in(new)
                    held[r["id"]] = (n + r["n"], sums + np.array(r["sums"]), own)
        for ident, (n, sums, own) in held.items():
            yield _spectrum_batch(ident, n, sums, own)

    return in_levels(parts, count, join)


def summed(parts: DataFrame, count: int) -> np.ndarray:
    """Sum of partial arrays (id, m), in levels."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for ident, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[ident] = held.get(ident, 0) + m.values.to_numpy()
        for ident, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int32()), pa.array([m.tolist()], pa.list_(pa.float64()))], names=["id", "m"])

    return np.array(in_levels(parts, count, join).first().m)


def products(fit: DataFrame, d: int, n: int, sums: np.ndarray, basis: np.ndarray, count: int) -> np.ndarray:
    """Covariance of the centred rows' projections on ``basis`` (columns), summed over the partitions."""
    shared = fit.sparkSession.sparkContext.broadcast((sums, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, basis = shared.value
        out = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            y = centred(matrix(batch.column(0), d), n, sums) @ basis
            out += y.T @ y / n
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["id", "m"])

    return summed(fit.select("x").mapInArrow(lean(run), "id int, m array<double>"), count).reshape(basis.shape[1], -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with a single rounding: n * x - sums is exact while it fits 64 bits."""
    whole, rest = np.divmod(sums, n)
    return ((x - whole) * float(n) - rest) / n if n >= 1 << 35 else ((x - whole) * n - rest) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum over entries of (n * x - sums)^2; None where a long can't hold it."""
    whole, rest = (v.astype(object) for v in np.divmod(sums, n))
    small = np.abs(x - whole.astype(np.int64)).max(initial=0) + 1
    if int(small) ** 2 * n * n * x.shape[1] < 1 << 62:
        far = (x - whole.astype(np.int64)) * n - rest.astype(np.int64)
        return (far * far).sum(axis=1).tolist()
    far = (x.astype(object) - whole) * n - rest
    return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]


@dataclass
class Whitening:
    """What a fit gives: the list's size and sums, components as columns, their eigenvalues, and their share."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitening(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors ``x`` of ``rows``; an eigenvalue of zero has no direction worth a scale."""
    fit = stage(rows.select("x").distinct(), "fit")
    count = numbered(fit)
    one = one_spectrum(spectra(fit, d), count, d).first()
    n, sums = one.n, np.array(one.sums)
    basis = np.array(one.basis).reshape(d, d)
    ritz, turned = np.linalg.eigh(products(fit, d, n, sums, basis, count))
    k = min(components, d)
    values, axes = ritz[::-1][:k], (basis @ turned)[:, ::-1][:, :k]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    trace = float(ritz.sum())
    values = np.where(values > d * EPS * max(float(ritz[-1]), 0.0) * 8, values, 0.0)
    some = values > 0
    error = 0.0
    if some.any():
        white = products(fit, d, n, sums, axes[:, some] / np.sqrt(values[some]), count)
        error = float(np.abs(white - np.eye(int(some.sum()))).max())
    forget(fit)
    return Whitening(n, sums, axes, values, values / trace if trace > 0 else np.zeros(k), error)


def whiten(vectors: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error of each row.

    Rows go whose vector is null, empty or has a null or non-finite entry.  If vectors differ in length,
    the commonest length is whitened and the rows of others go.  Equal vectors are fitted once, but every
    row has its result; a null id is a value like any other.  An eigenvalue of zero gives null
    whitened values.  An empty table gives no rows.  Extra columns are not looked at.
    """
    rows = usable(vectors, vector).select(F.col(ident).cast("long").alias("vec_id"), integers(vector, SCALE, SHIFT).alias("x"))
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    d = common_length(rows, "x")
    if d is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    model = fit_whitening(rows, d, components)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        some, k = m.values > 0, len(m.values)
        for batch in batches:
            x = matrix(batch.column(1), d)
            white = np.full((len(x), k), np.nan)
            white[:, some] = centred(x, m.n, m.sums) @ m.components[:, some] / np.sqrt(m.values[some])
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), from_pandas=True), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(x), m.n)), pa.array(deviations(x, m.n, m.sums), pa.int64()), lists(white), lists(np.tile(m.explained, (len(x), 1))),
                pa.array(np.full(len(x), m.identity_error))], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(lean(run), schema)


def whitened_components(vectors: DataFrame) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    return whiten(vectors).select("vec_id", "n", "deviation", "identity_error", each.alias("nth", "c")).select(
        "vec_id", (F.col("nth") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
