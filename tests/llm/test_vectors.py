"""Whitening and vector codes against plain numpy versions, with every awkward row."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cuestrata.llm import codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, codes string, salt int, n int"


def vectors(d: int = 12, count: int = 400) -> list[tuple]:
    rng = random.Random(5)
    rows = [(i * 7 % 401, [round(rng.gauss(0, 0.1 * (1 + k)), 5) for k in range(d)], rng.choice([1, 2, None])) for i in range(count)]
    rows += [(500 + i, rows[3][1], 1) for i in range(200)]  # a third: one vector
    rows += [(rows[5][0], rows[5][1], 1), (None, rows[6][1], None), (None, [0.0] * d, 2)]
    rows += [(900, None, 1), (901, [0.1] * (d - 1) + [None], 1), (902, [float("nan")] * d, 1), (903, [float("inf")] + [0.0] * (d - 1), 1), (904, [], 1), (905, [0.5], 1)]
    return rows


def kept(rows: list[tuple], d: int = 12) -> list[tuple]:
    return [r for r in rows if r[1] and len(r[1]) == d and all(c is not None and np.isfinite(c) for c in r[1])]


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, v, x, "clash", "clash", 1, 2) for i, v, x in rows], SCHEMA).repartition(parts)


def scatter(x: np.ndarray) -> np.ndarray:
    y = x - x.mean(axis=0)
    return y.T @ y


@pytest.mark.parametrize("x", [
    np.random.default_rng(0).normal(0, 8, (300, 20)).round(), np.random.default_rng(1).integers(-3, 3, (10, 6)).repeat(20, axis=0).astype(float),
    np.random.default_rng(2).normal(0, 8, (60, 3)) @ np.random.default_rng(3).normal(0, 1, (3, 9)), np.ones((5, 4)), np.arange(12.0).reshape(12, 1),
    np.random.default_rng(4).normal(0, 8, (80, 6)) * [1e6, 1e3, 1, 1e-3, 0, 1]])
def test_rank_one_updates_give_the_spectrum_of_the_scatter(x):
    one = whitening.Spectra.empty(1, x.shape[1])
    for row in x:
        one.add(row[None])
    many = whitening.Spectra.empty(3, x.shape[1])
    for k in range(0, len(x) // 3 * 3, 3):
        many.add(x[k : k + 3])
    for own, rows in ((one, x), (many.joined(), x[: len(x) // 3 * 3])):
        want, scale = scatter(rows), max(1.0, np.abs(scatter(rows)).max())
        assert np.abs(own.lam[0] - np.linalg.eigvalsh(want)).max() < 1e-9 * scale
        assert np.abs(own.basis[0].T @ own.basis[0] - np.eye(x.shape[1])).max() < 1e-11
        assert np.abs(want @ own.basis[0] - own.basis[0] * own.lam[0]).max() < 1e-9 * scale


@pytest.mark.parametrize(("fan", "worth"), [(16, 1024), (2, 8)])
def test_whitening(spark, monkeypatch, fan, worth):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "WORTH", worth)
    rows = vectors()
    good = kept(rows)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = scatter(fit.astype(float)) / n
    values, axes = np.linalg.eigh(cov)
    want = (x - sums / n) @ axes[:, ::-1] / np.sqrt(values[::-1])
    got = {}
    for r in whitening.whitened_components(frame(spark, rows, 7)).collect():
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.n, r.whitened, r.explained, r.identity_error))
    assert sum(map(len, got.values())) == len(good) * 12
    signs = None
    for (i, _, _), row, w in zip(good, x, want, strict=True):
        deviation = int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)))
        each = sorted(got[i, deviation])[:: len(got[i, deviation]) // 12]
        assert [e[0] for e in each] == list(range(1, 13)) and all(e[1] == n for e in each)
        mine = np.array([e[2] for e in each])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.abs(mine * signs - w).max() < 1e-7
        assert np.abs(np.array([e[3] for e in each]) - values[::-1] / values.sum()).max() < 1e-9 and each[0][4] < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    flat = [(i, [1.0, 2.0, float(i % 2)], 1) for i in range(6)]
    out = whitening.whiten(frame(spark, flat)).collect()
    assert len(out) == 6 and all(r.n == 2 and abs(abs(r.whitened[0]) - 1) < 1e-12 and r.whitened[1:] == [None, None] and r.explained == [1.0, 0.0, 0.0] for r in out)
    assert whitening.whiten(frame(spark, flat[:1])).first().whitened == [None] * 3
    assert whitening.whitened_components(frame(spark, [])).count() == 0
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0], 1), (2, [0.0, 0.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert len(huge) == 3 and all(np.isfinite(r.whitened).all() for r in huge)


def test_deviation_beyond_a_long_is_null():
    n = 1 << 40
    assert whitening.deviations(np.array([[5, 5]]), n, np.array([n, n])) == [None]
    assert whitening.deviations(np.array([[5, 5]]), 10, np.array([7, 8])) == [(50 - 7) ** 2 + (50 - 8) ** 2]
    assert whitening.deviations(np.array([[1 << 20]]), 1 << 10, np.array([1 << 10])) == [((1 << 30) - (1 << 10)) ** 2]


@pytest.mark.parametrize(("parts", "d"), [(4, 12), (5, 12)])
def test_vector_codes(spark, parts, d):
    rows = vectors(d)
    good = kept(rows, d)
    q = -(-d // parts)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (parts * q - d) for _, v, _ in good])
    order = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, x[r].tolist()))[:8]
    books = [[x[r, p * q : p * q + q].tolist() for r in order] for p in range(parts)]

    def nearest(r, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[r, p * q : p * q + q].tolist(), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        code = [[nearest(r, p)[1] for p in range(parts)] for r in range(len(x))]
        for p in range(parts):
            for k in range(8):
                own = [x[r, p * q : p * q + q] for r in range(len(x)) if code[r][p] == k]
                if own:
                    books[p][k] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    out, got_books = codes.encode_vectors(frame(spark, rows), parts=parts, entries=8, rounds=2, pivots=3)
    assert got_books.tolist() == books
    want = sorted((str(i), str([nearest(r, p)[1] for p in range(parts)]), sum(nearest(r, p)[0] for p in range(parts))) for r, (i, _, _) in enumerate(good))
    assert sorted((str(r.vec_id), str(r.codes), r.error) for r in out.collect()) == want
    by_label: dict = {}
    for r in out.collect():
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    with_errors = codes.label_errors(out).collect()
    assert len(with_errors) == len(good) and all(r.label_error == by_label[r.label] for r in with_errors)


def test_vector_codes_query(spark):
    few = [(i, [i * 0.01] * 16, None) for i in range(5)]
    out = codes.vector_codes(frame(spark, [*few, (7, None, 1)])).orderBy("vec_id").collect()
    assert [r.code for r in out] == [f"{i:02x}" * 16 for i in range(5)] and all(r.error == 0 and r.label_error == 0 for r in out)
    books = np.floor(256 * np.float32([i * 0.01 for i in range(5)]).astype(float)).astype(int).tolist() * 16
    assert out[0].codebooks_sha256 == hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    assert codes.vector_codes(frame(spark, [])).count() == 0


def test_pivots_spare_exact_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (500, 4))
    book = x[:64]
    pivots = codes.choose_pivots(book[None], 4)[0]
    far = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2)).astype(np.float32)
    entry, best, work = codes.nearest(x, far, book, pivots)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and work < every.size / 2
