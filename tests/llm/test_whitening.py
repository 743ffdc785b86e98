"""Whitening: the solver against numpy's, the query against a plain second computation, odd rows."""

import math

import duckdb
import numpy as np
import pytest
from filequarry.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(5)
    yield rng.standard_normal((400, 24))
    yield rng.standard_normal((300, 16)) @ np.diag(0.3 ** np.arange(16))
    yield rng.standard_normal((5, 12))
    yield np.vstack([np.eye(8)] * 3) - 1 / 8
    yield np.diag([3.0, 3, 3, 1, 0, 0])
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    for gap in (1e-6, 1e-9, 1e-12, 1e-15):
        yield np.diag([5, 5 - gap, 5 - 2 * gap, 5 - 3 * gap, *np.linspace(1, 2, 16)]) @ q
    yield rng.integers(-9, 9, (50, 1)) @ rng.integers(-9, 9, (1, 7)).astype(float)


@pytest.mark.parametrize("y", list(matrices()), ids=str)
def test_solver(y):
    d = y.shape[1]
    r = np.linalg.qr(y, mode="r")
    a, b, reflectors = whitening.bidiagonal(np.vstack([r, np.zeros((d - len(r), d))]))
    want = np.linalg.svd(y, compute_uv=False) ** 2
    want = np.concatenate([want, np.zeros(d - len(want))])
    assert np.allclose(sorted(whitening.dqds(a**2, b**2), reverse=True), want, rtol=1e-12, atol=1e-13 * want[0])
    values, z = whitening.leading(a, b, 4)
    v = whitening.back_transformed(z, reflectors)
    assert np.abs(v.T @ v - np.eye(4)).max() < 1e-9
    assert np.abs(y.T @ (y @ v) - v * values).max() < 1e-12 * want[0]


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(0, 40, 4.0), np.full(9, 1e-45)
    got = sorted(whitening.dqds(a**2, b**2), reverse=True)
    assert np.allclose(got, a**2, rtol=1e-12)


def plain(table):
    """vec_id -> (n, deviation, {component: |whitened|}, explained), by numpy's eigenvectors."""
    kept = [(i, v) for i, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(c)) for c in v] for _, v in kept]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    for (i, _), row in zip(kept, x):
        w = (np.array(row) - sums / n) @ v[:, :4] / np.sqrt(e[:4])
        yield i, n, int(((n * np.array(row) - sums) ** 2).sum()), w, e[:4] / e.sum()


def test_query_equals_plain_computation(spark):
    got = {}
    for r in queries.op13_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    signs, seen = None, 0
    for i, n, deviation, w, explained in plain(table):
        mine = [got[i][k] for k in (1, 2, 3, 4)]
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        values = np.array([r.whitened for r in mine])
        signs = np.sign(values * w) if signs is None else signs
        assert np.allclose(values, w * signs, atol=1e-8)
        assert 0 <= mine[0].identity_error < 1e-9
        seen += 1
    assert seen == len(got) == len(table)


def whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, x string, component string")
    return whitening.whiten(df).collect()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, [1.0, 1.0, 0.5]), (3, [1.0, 1.0, 0.5]), (None, [-0.0, 1.0, 0.5])]
    rows += [(4, None), (5, []), (6, [1.0, None, 0.5]), (7, [nan, 0.0, 0.5]), (8, [0.0, -inf, 0.5]), (9, [1.0, 2.0])]
    got = whiten(spark, [(*r, "a", "b", "c") for r in rows])
    # two components: the third dimension is constant; -0.0 is 0.0, so the row without id repeats row 1
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, k) for i in (0, 1, 2, 3, 3) for k in (1, 2))
    assert {r.n for r in got} == {3}
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert by[(None, 1)] == by[(1, 1)] and abs(sum(by[(i, 1)] for i in (1, 2, 3))) < 1e-12
    assert math.isclose(sum(r.explained for r in got if r.vec_id == 1), 1)


def test_empty_and_single(spark):
    assert whiten(spark, []) == []
    assert whiten(spark, [(1, [1.0, 2.0], "", "", ""), (2, [1.0, 2.0], "", "", "")]) == []


def test_huge_entries(spark):
    got = whiten(spark, [(1, [1e300, 0.0], "", "", ""), (2, [0.0, 1e9], "", "", ""), (3, [0.0, 0.0], "", "", "")])
    assert {r.deviation for r in got if r.vec_id == 1} == {None}
    assert all(math.isfinite(r.whitened) for r in got)


def test_factors_are_combined_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "QR_ROWS", 7)
    rng = np.random.default_rng(2)
    y = rng.integers(-50, 50, (200, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in y], "x array<long>").repartition(9)
    mean = y.mean(axis=0)
    r = whitening.blockwise_r(df, mean)
    assert np.allclose(r.T @ r, (y - mean).T @ (y - mean))
