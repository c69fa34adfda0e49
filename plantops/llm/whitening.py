"""Embedding whitening by QDWH spectral divide and conquer.

The covariance is summed on the cluster in whole numbers: every entry c
becomes x = floor(64 c) + 1000000, the tasks add up the products of x minus a
whole number near the mean, and the d * d sums that reach the driver give the
covariance without rounding before its last step.

Its eigenvectors come from polar decompositions.  For a shift s between two
eigenvalues the polar factor U of V - s I is its matrix sign, so (U + I) / 2
is the projector on the eigenvectors above s.  An orthonormal basis of that
subspace and of its complement cuts V into two smaller blocks, and each is cut
on in the same way until it is diagonal to rounding.  U is found by the
dynamically weighted Halley iteration in its QR form.  The d * d model is
bounded by the vectors' length and sent to all tasks.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = np.finfo(float).eps
SCALE, OFFSET = 64, 1_000_000


def polar_qdwh(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based
    dynamically weighted Halley iterations (six suffice in double precision)."""
    n = len(a)
    alpha = np.linalg.norm(a)  # at least the largest singular value
    if alpha == 0:
        return np.eye(n)
    x = a / alpha
    low = EPS  # a lower bound of the singular values; one too small costs an iteration or two
    for _ in range(30):
        dd = np.cbrt(4 * (1 - low * low) / low ** 4)
        wa = np.sqrt(1 + dd) + 0.5 * np.sqrt(8 - 4 * dd + 8 * (2 - low * low) / (low * low * np.sqrt(1 + dd)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _r = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * low * low) / (1 + wc * low * low), 1.0)
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(5 * EPS):
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first columns span the eigenvectors above
    ``shift`` and the others the rest, with their number; None if one side is
    empty or the cut is not clean to rounding."""
    n = len(a)
    p = (polar_qdwh(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(p)))
    if k <= 0 or k >= n:
        return None
    q = np.random.default_rng(n).standard_normal((n, k))  # a projected random block spans the subspace
    for _ in range(3):
        q, _r = np.linalg.qr(p @ q)
    q, _r = np.linalg.qr(q, mode="complete")
    if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) > 100 * n * EPS * np.linalg.norm(a):
        return None
    return q, k


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric
    matrix.  The largest entry of each vector is positive."""
    scale = np.linalg.norm(v)
    if not len(v):
        return np.empty(0), np.empty((0, 0))
    done: list[np.ndarray] = []
    work = [np.eye(len(v))]  # bases of invariant subspaces that are still to be cut
    while work:
        basis = work.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        off = a - np.diag(np.diag(a))
        if len(a) == 1 or np.linalg.norm(off) <= 4 * EPS * scale:
            done.append(basis)
            continue
        diag, radius = np.sort(np.diag(a)), np.linalg.norm(off, 2)
        mid = float(np.median(diag))
        # the middle of the diagonal first; then points ever nearer to the bounds of the eigenvalues
        tries = [mid, float(np.mean(diag)), *[mid + s * f * radius for f in (0.5, 0.25, 0.75, 0.1, 0.9, 0.02) for s in (1, -1)]]
        cut = next((c for c in (_split(a, t) for t in tries) if c is not None), None)
        if cut is None:  # eigenvalues equal almost to rounding
            done.append(basis @ _rotate(a))
            continue
        q, k = cut
        work += [basis @ q[:, :k], basis @ q[:, k:]]
    q = np.hstack(done)
    e = np.einsum("ij,ij->j", q, v @ q) / np.einsum("ij,ij->j", q, q)
    order = np.argsort(-e, kind="stable")
    q = q[:, order] / np.linalg.norm(q[:, order], axis=0)
    return e[order], q * np.where(q[np.abs(q).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)


def _rotate(a: np.ndarray) -> np.ndarray:
    """Jacobi rotations for a block that no shift cuts cleanly (a cluster)."""
    a, q, n = a.copy(), np.eye(len(a)), len(a)
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * np.linalg.norm(a):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j] == 0:
                    continue
                t = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
                a[:, [i, j]] = a[:, [i, j]] @ r
                a[[i, j], :] = r.T @ a[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ r
    return q


@dataclass
class Model:
    """What whitens vectors of one length: ``weights`` has a column for each
    component, eigenvector / sqrt(eigenvalue); a component without variance has
    a column of NaN."""
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def usable(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the rows that take part, entries as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull())
    # both halves test for themselves: Spark may evaluate the second on rows that the first leaves out
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = F.transform("v", lambda c: F.when(finite(c), F.floor(c * scale) + F.lit(offset).cast("long")))
    return rows.where(F.forall("v", finite)).select("vec_id", whole.alias("x"))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """A list column of lists of ``d`` numbers as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


_SUM = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DecimalType(38, 0))])


def _add_up(rows: DataFrame, d: int, near: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over all rows of y_i (key (-1, i)) and y_i * y_j (i <= j)
    for y = x - near: each task gives one row for each, Spark adds them."""
    centre = np.array(near, np.int64)

    def run(batches):
        one, two = [0] * d, np.zeros((d, d), object)
        for rb in batches:
            if not rb.num_rows:
                continue
            y = _matrix(rb.column(0), d) - centre
            most = max(int(np.abs(y).max(initial=0)), 1)
            # products of doubles are exact up to 2^53; sums of blocks stay below
            step = (1 << 53) // (most * most)
            for lo in range(0, len(y), max(step, 1)):
                part = y[lo:lo + max(step, 1)]
                exact = part.astype(float) if step else part.astype(object)
                two = two + (exact.T @ exact).astype(np.int64 if step else object).astype(object)
                one = [a + int(b) for a, b in zip(one, part.astype(object).sum(axis=0) if not step else part.sum(axis=0))]
        i, j = np.triu_indices(d)
        s = [*map(int, one), *map(int, two[i, j])]
        yield pa.RecordBatch.from_arrays([
            pa.array([*[-1] * d, *i.tolist()], pa.int32()), pa.array([*range(d), *j.tolist()], pa.int32()),
            pa.array([Decimal(x) for x in s], pa.decimal128(38, 0))], names=["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, _SUM).groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in sums.collect()}  # d * (d + 3) / 2 rows


def covariance(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of x, each entry rounded once."""
    near = [round(Fraction(s, n)) for s in sums]
    got = _add_up(rows, d, near)
    t = [got[-1, i] for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = float(Fraction(n * got[i, j] - t[i] * t[j], n * n))
    return v


def _projector(model: Model, d: int):
    n, sums = model.n, model.sums

    def project(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(exact sum of (n x - S)^2, whitened values) of each row."""
        bound = max((max(abs(n * int(x.max(initial=0)) - s), abs(n * int(x.min(initial=0)) - s)) for s in sums), default=0)
        if n * int(np.abs(x).max(initial=0)) < 1 << 62 and bound * bound * max(d, 1) < 1 << 63:
            dev = x * np.int64(n) - np.array(sums, np.int64)
            square = (dev * dev).sum(axis=1).tolist()
        else:
            dev = x.astype(object) * n - np.array(sums, object)
            square = [int(s) for s in (dev * dev).sum(axis=1)]
        return square, (dev.astype(float) / n) @ model.weights

    return project


def fit(rows: DataFrame, d: int, components: int = 32) -> Model:
    """The model of the rows of :func:`usable` with ``d`` entries."""
    each = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()  # d rows
    n, sums = each[0]["n"], [int(r["s"]) for r in sorted(each, key=lambda r: r["i"])]
    v = covariance(rows, d, n, sums)
    e, q = eigenvectors(v)
    e, q, trace = e[:components], q[:, :components], float(np.trace(v))
    flat = e <= d * EPS * max(float(e[0]) if len(e) else 0, 0)
    weights = q / np.sqrt(np.where(flat, np.nan, e))
    model = Model(n, sums, e, weights, np.where(trace > 0, e / (trace or 1), np.nan))
    model.identity_error = _identity_error(rows, d, model)
    return model


def _identity_error(rows: DataFrame, d: int, model: Model) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over
    the components with variance, measured on all rows."""
    live = np.flatnonzero(~np.isnan(model.weights).any(axis=0))
    k = len(live)
    if not k:
        return 0.0
    project = _projector(Model(model.n, model.sums, model.eigenvalues, model.weights[:, live], model.explained), d)

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for rb in batches:
            if rb.num_rows:
                _, z = project(_matrix(rb.column(0), d))
                one, two = one + z.sum(axis=0), two + z.T @ z
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([
            pa.array([*[-1] * k, *i.tolist()], pa.int32()), pa.array([*range(k), *j.tolist()], pa.int32()),
            pa.array([*one.tolist(), *two[i, j].tolist()], pa.float64())], names=["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    got = {(r["i"], r["j"]): r["s"] / model.n for r in sums}  # at most components * (components + 3) / 2 rows
    return max(abs(c - got[-1, i] * got[-1, j] - (i == j)) for (i, j), c in got.items() if i >= 0)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Per remaining row: vec_id, n, deviation (exact sum of (n x - S)^2),
    whitened (array, one value for each component), explained (array) and
    identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left
    out; repeated rows and null ids each count and give a row; vectors of
    different lengths are whitened apart, each length with a model of its own
    (an empty vector has no components); a component without variance has a
    null value; an empty table gives no row; other columns are left out.  A
    deviation beyond a long ends the job with an error."""
    rows = usable(vectors)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
                           T.StructField("identity_error", T.DoubleType())])
    lengths = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect())
    out = [_applied(own, d, fit(own, d, components), schema) for d in lengths if d for own in [rows.where(F.size("x") == d)]]
    return functools.reduce(DataFrame.unionByName, out) if out else rows.sparkSession.createDataFrame([], schema)


def _applied(rows: DataFrame, d: int, model: Model, schema: T.StructType) -> DataFrame:
    project = _projector(model, d)

    def run(batches):
        for rb in batches:
            x = _matrix(rb.column(1), d)
            square, z = project(x)
            m, k = z.shape
            offsets = pa.array(np.arange(m + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([
                rb.column(0), pa.array(np.full(m, model.n, np.int64)), pa.array(square, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), pa.float64(), from_pandas=True)),
                pa.ListArray.from_arrays(offsets, pa.array(np.tile(model.explained, m), pa.float64(), from_pandas=True)),
                pa.array(np.full(m, model.identity_error))], names=schema.names)

    return rows.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component (numbered from 1)."""
    return whitened.select(
        "vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
