"""Embedding whitening: blockwise QR of the centred rows, then a bidiagonal qd solver for the triangle.

Spark makes the list of distinct vectors, their sums, and one triangular factor for each partition of
centred rows; factors are combined sixteen at a time until one is left. Only that one, dimension x
dimension, and per-dimension sums reach the driver. There Householder reflections make it bidiagonal,
dqds finds all singular values to high relative accuracy, and a twisted factorisation at each of the
leading ones gives its right vector. A last pass projects every row.

Nulls, ties, odd rows: a vector that is null, empty, or holds a null or a non-finite entry is dropped, and
so is one of another length than the commonest (of equally common ones the longest). Repeated vectors
enter the fit once, but each row has its results, null or repeated ids too. Entries beyond a long
saturate. Components whose variance is zero to double precision (fewer different vectors than
dimensions, constant dimensions) are left out; with one vector or none there is no row. Among equal
variances any orthonormal choice serves. A deviation beyond a long is null. Further columns are dropped.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from filequarry.llm.common import written

SCALE = 256
#: Triangular factors combined in one task.
FAN_IN = 16
#: Centred rows that one QR step takes.
QR_ROWS = 4096
_EPS = np.finfo(np.float64).eps
_LONG = (1 << 63) - 1


class Model(NamedTuple):
    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray  # dimension x components, unit columns
    variances: np.ndarray
    total: float


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that isn't dropped."""
    rows = quantised(embeddings)
    fit_list = written(rows.select("x").distinct(), "vectors")
    model = fit(fit_list, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, model)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            values = _project(x, model)
            away = pa.array(_deviations(x, model), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n, np.int64)),
                    away.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(values.ravel()),
                    pa.array(np.tile(model.variances / model.total, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, whole multiples of 1/256, of each vector of the commonest length without null or non-finite entries."""
    entry_ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.forall("embedding", entry_ok) & (F.size("embedding") > 0))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("embedding") == (lengths.length if lengths else 0))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def fit(vectors: DataFrame, components: int) -> Model | None:
    """Means, leading directions and variances of ``vectors`` (x), a written table of distinct rows."""
    sums_of = vectors.mapInArrow(_partial_sums, "dim int, n long, total decimal(38,0)")
    sums = sums_of.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()  # one row for each dimension
    if not sums or sums[0].n < 2:
        return None
    n, totals = int(sums[0].n), [int(r.total) for r in sums]
    mean = np.array([t / n for t in totals])
    triangle = blockwise_r(vectors, mean)
    a, b, reflectors = bidiagonal(triangle)
    values, vectors_ = leading(a, b, components)
    variances = values / n
    kept = variances > len(mean) * _EPS * max(variances[0], 0) if len(variances) else np.zeros(0, bool)
    if not kept.any():
        return None
    directions = back_transformed(vectors_[:, kept], reflectors)
    return Model(n, totals, mean, directions, variances[kept], float(np.sum(triangle * triangle)) / n)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of the partition's rows for each dimension."""
    n, totals = 0, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if not len(x):
            continue
        small = max(int(x.max()), -int(x.min())) < _LONG // len(x)
        part = (x if small else x.astype(object)).sum(axis=0).tolist()
        n, totals = n + len(x), part if totals is None else [a + b for a, b in zip(totals, part)]
    if n:
        d = len(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(decimal.Decimal, totals), pa.decimal128(38, 0))], names=["dim", "n", "total"]
        )


def blockwise_r(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows, d x d."""
    d = len(mean)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column("x"))
            for at in range(0, len(x), QR_ROWS):
                r = np.linalg.qr(np.vstack([r, x[at : at + QR_ROWS] - mean]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def combined(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r).reshape(-1, d) for r in group.sort_values("node").r]
        return pd.DataFrame({"node": [int(group.node.iloc[0]) // FAN_IN], "r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    factors = written(vectors.mapInArrow(local, "node long, r binary"), "factors")
    while factors.agg(F.count("*")).first()[0] > 1:
        factors = written(factors.groupBy(F.expr(f"node div {FAN_IN}")).applyInPandas(combined, "node long, r binary"), "factors")
    r = np.frombuffer(factors.first().r).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of the upper bidiagonal form of ``r``, and the reflectors applied from the right."""
    a = r.copy()
    d = len(a)
    reflectors = []
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(v, 2 * (v @ a[k:, k:]))
        if k < d - 1:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ v), v)
            reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit v so that x - 2 v (v.x) has zeros below its first entry; zero where there is nothing to do."""
    v = x.copy()
    norm = np.linalg.norm(v)
    if norm == 0 or not v[1:].any():
        return np.zeros_like(v)
    v[0] += np.copysign(norm, v[0])
    return v / np.linalg.norm(v)


def back_transformed(z: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    out = z.copy()
    for k in reversed(range(len(reflectors))):
        v = reflectors[k]
        out[k + 1 :] -= np.outer(v, 2 * (v @ out[k + 1 :]))
    return out / np.linalg.norm(out, axis=0)


def leading(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of the bidiagonal (a, b), falling, and their right vectors as columns."""
    d = len(a)
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((d, 0))
    a, b = a / size, b / size
    cut = np.abs(b) <= _EPS * (np.abs(a[:-1]) + np.abs(a[1:])) / 8
    # a zero on the diagonal, too, would divide the factors: it is moved off by less than rounding
    a = np.where(np.abs(a) < _EPS * _EPS, _EPS * _EPS, a)
    bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), d]
    found = []
    for start, end in zip(bounds, bounds[1:]):
        values = dqds(a[start:end] ** 2, b[start : end - 1] ** 2)
        found += [(v, start, end) for v in values]
    found.sort(reverse=True)
    found = found[:count]
    z = np.zeros((d, len(found)))
    for k, (value, start, end) in enumerate(found):
        near = [j for j in range(k) if found[j][1] == start and found[j][0] - value < 1e-3 * value]
        z[start:end, k] = _right_vector(a[start:end], b[start : end - 1], value, z[start:end, near])
    return np.array([v for v, _, _ in found]) * size * size, z


def dqds(q: np.ndarray, e: np.ndarray) -> list[float]:
    """Eigenvalues of B'B, where B is upper bidiagonal with squared entries q and e, by differential qd with shifts."""
    out = []
    todo = [(q.tolist(), e.tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while q:
            m = len(q)
            if m == 1:
                out.append(q[0] + moved)
                break
            least = (4 * _EPS) ** 2
            split = next((i for i in range(m - 2, -1, -1) if e[i] <= least * (moved + min(q[i], q[i + 1])) or e[i] == 0), None)
            if split is not None:
                if split == m - 2:
                    out.append(q.pop() + moved)
                    e.pop()
                    continue
                todo.append((q[split + 1 :], e[split + 1 :], moved))
                q, e = q[: split + 1], e[:split]
                continue
            if q[-1] > 1.5 * q[0]:
                q, e = q[::-1], e[::-1]
            q, e, d = _qd(q, e, 0.0)
            # the diagonal of the inverse is 1 / d, so this never exceeds the least eigenvalue
            shift = 0.0 if min(d) <= 0 else (1 - 8 * m * _EPS) / sum(1 / x for x in d)
            if shift > _EPS * moved:
                q2, e2, d = _qd(q, e, shift)
                if min(d) >= 0:
                    q, e, moved = q2, e2, moved + shift
    return out


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    d = q[0] - shift
    q2, e2, ds = [], [], [d]
    for i, off in enumerate(e):
        now = d + off
        t = q[i + 1] / now if now else 0.0
        q2.append(now)
        e2.append(off * t)
        d = d * t - shift
        ds.append(d)
    return [*q2, d], e2, ds


def _right_vector(a: np.ndarray, b: np.ndarray, value: float, others: np.ndarray) -> np.ndarray:
    """Unit eigenvector of B'B at ``value``, orthogonal to ``others``, by the twisted factorisation of B'B - value."""
    n = len(a)
    diag, low = (a * a).tolist(), (b / a[:-1]).tolist()
    tiny = _EPS * _EPS
    down, s = [0.0] * (n - 1), [-value] + [0.0] * (n - 1)
    for i in range(n - 1):
        pivot = s[i] + diag[i] or tiny
        down[i] = diag[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = [0.0] * (n - 1), [0.0] * (n - 1) + [diag[-1] - value]
    for i in range(n - 2, -1, -1):
        t = diag[i] / (diag[i] * low[i] ** 2 + p[i + 1] or tiny)
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    twist = min(range(n), key=lambda k: abs(s[k] + p[k] + value))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    z /= np.linalg.norm(z)
    if not others.shape[1]:
        return z
    rest = z - others @ (others.T @ z)
    if np.linalg.norm(rest) < 0.5:
        # values that agree to many digits: iterate in what the others leave
        rest = np.random.default_rng(n).standard_normal(n)
        tri = np.diag(a * a) + np.diag(b * a[:-1], 1) + np.diag(b * a[:-1], -1)
        tri[np.arange(1, n), np.arange(1, n)] += b * b
        for _ in range(4):
            rest = np.linalg.solve(tri - value * (1 + 2 * _EPS) * np.eye(n), rest)
            rest -= others @ (others.T @ rest)
            rest /= np.linalg.norm(rest)
    rest -= others @ (others.T @ rest)
    return rest / np.linalg.norm(rest)


def _project(x: np.ndarray, model: Model) -> np.ndarray:
    return (x - model.mean) @ model.directions / np.sqrt(model.variances)


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2."""
    sums = model.sums
    most = model.n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if most * most * len(sums) <= _LONG:
        return ((x * model.n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (((x.astype(object) * model.n) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v <= _LONG else None for v in exact.tolist()]


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance, centred on their own mean, minus the identity."""
    k = len(model.variances)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _project(_matrix(batch.column("x")), model) if batch.num_rows else np.zeros((0, k))
            if not len(w):
                continue
            mean = w.mean(axis=0)
            w = w - mean
            yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), pa.array([mean.tolist()]), pa.array([(w.T @ w).ravel().tolist()])], names=["n", "mean", "spread"])

    parts = written(vectors.mapInArrow(moments, "n long, mean array<double>, spread array<double>"), "moments")
    mean = np.array(parts.agg(*(F.sum(F.col("n") * F.col("mean")[i]) / model.n for i in range(k))).first())
    centred = [F.col("mean")[i] - F.lit(float(mean[i])) for i in range(k)]
    spread = [F.sum(F.col("spread")[i * k + j] + F.col("n") * centred[i] * centred[j]) / model.n for i in range(k) for j in range(k)]
    return float(np.abs(np.array(parts.agg(*spread).first()).reshape(k, k) - np.eye(k)).max())
