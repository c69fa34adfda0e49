import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantops.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, n int, whitened string")


def run(spark, rows, components=32):
    return whitening.by_component(whitening.whiten(frame(spark, rows), components)).collect()


def spectrum(kind, n=24):
    return {"spread": np.linspace(1, 100, n), "two": np.r_[np.ones(n // 2), np.full(n - n // 2, 5.0)], "steep": 10.0 ** np.linspace(-8, 3, n),
            "rank3": np.r_[3.0, 2.0, 1.0, np.zeros(n - 3)], "near": np.r_[1 + 1e-13 * np.arange(n // 2), 2 + 1e-15 * np.arange(n - n // 2)],
            "equal": np.full(n, 7.0), "signs": np.linspace(-4, 9, n)}[kind]


@pytest.mark.parametrize("kind", ["spread", "two", "steep", "rank3", "near", "equal", "signs"])
def test_divide_and_conquer_finds_the_eigenvectors(kind):
    e = spectrum(kind)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(e), len(e))))
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    got, vec = whitening.eigenvectors(a)
    scale = np.abs(e).max()
    assert np.abs(got - np.sort(e)[::-1]).max() < 1e-13 * scale
    assert np.abs(vec.T @ vec - np.eye(len(e))).max() < 1e-14 * len(e)
    assert np.abs(a @ vec - vec * got).max() < 1e-13 * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    e = np.r_[-(10.0 ** np.linspace(-9, 2, 10)), 10.0 ** np.linspace(-9, 2, 10)]
    u = whitening.polar_qdwh((q * e) @ q.T)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12 and abs(np.trace(u)) < 1e-6


def test_against_numpy_with_exact_sums(spark):
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((12, 12))
    good = [(i, np.float32(rng.standard_normal(12) @ mix).tolist()) for i in range(400)]
    rows = [*good, good[0], (None, good[1][1]), (901, None), (902, [None] + [1.0] * 11), (903, [math.nan] + [1.0] * 11), (904, [math.inf] + [1.0] * 11), (905, [])]
    used = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in [*good, good[0], (None, good[1][1])]]
    n, x = len(used), np.array([v for _, v in used], object)
    s = x.sum(axis=0)
    dev = {(i, tuple(v)): int(sum((n * a - b) ** 2 for a, b in zip(v, s))) for i, v in used}
    y = (x * n - s).astype(float) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:5], q[:, ::-1][:, :5]
    z = y @ q / np.sqrt(e)
    got = run(spark, rows, components=5)
    assert len(got) == 5 * n and all(r.n == n for r in got)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(dev[i, tuple(v)] for i, v in used)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for (i, _), row in zip(used, z):
        for c in range(5):
            r = by[i, c + 1][0]
            assert abs(abs(r.whitened) - abs(row[c])) < 1e-9 and abs(r.explained - e[c] / np.trace(v)) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
    a = np.array([[r.whitened for r in sorted(by[i, 1] + by[i, 2] + by[i, 3] + by[i, 4] + by[i, 5], key=lambda r: r.component)][:5] for i in range(1, 400)])
    sign = np.sign((a * z[1:400]).sum(axis=0))
    assert np.abs(a * sign - z[1:400]).max() < 1e-9  # one sign for all rows


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * (i % 3), float(i), 5.0]) for i in range(9)]
    used = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*used)]
    want = [sum((9 * a - b) ** 2 for a, b in zip(v, s)) for v in used]
    frame_ = whitening.usable(frame(spark, rows))
    model = whitening.fit(frame_, 3)
    got, _ = whitening._projector(model, 3)(np.array(used, np.int64))
    assert got == want and model.sums == s
    # a component without variance is null
    out = run(spark, [(i, [float(i % 3), float(i), 5.0]) for i in range(9)])
    assert all((r.whitened is None) == (r.component == 3) for r in out) and out[0].identity_error < 1e-9


def test_lengths_apart_and_empty(spark):
    rows = [(i, [float(i % 5), float(i % 7)]) for i in range(20)] + [(100 + i, [float(i), float(i * i), 1.0 - i]) for i in range(10)]
    out = run(spark, rows)
    assert {(r.n, r.component) for r in out} == {(20, 1), (20, 2), (10, 1), (10, 2), (10, 3)}
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    one = run(spark, [(1, [1.0, 2.0])])
    assert [(r.whitened, r.deviation) for r in one] == [(None, 0), (None, 0)]
    assert whitening.whiten(frame(spark, rows)).where(F.size("whitened") != F.size("explained")).count() == 0
