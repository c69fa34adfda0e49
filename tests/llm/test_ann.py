import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantops.llm import ann


def brute(rows, k=5, step=50):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(v))] = np.array(v, np.float64)
    out = []
    for (i, _), q in ok.items():
        if i % step:
            continue
        cand = [(j, x) for (j, _), x in ok.items() if j != i and len(x) == len(q)]
        if cand:
            s = ann.cosine(np.repeat(q[None], len(cand), 0), np.array([x for _, x in cand]))
            best = sorted(zip(-s, [j for j, _ in cand]))[:k]
            out += [(i, r + 1, j, -c) for r, (c, j) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, score double")


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_exact_with_copies_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [1.0, 2, 3, 4, 5, 6, 7, 8]) for i in range(60)]          # one common vector, a query among it
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2150, [None] + [1.0] * 7), (None, [1.0] * 8), (2200, [])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, [float("inf"), 1.0])]  # another length
    rows += [rows[0], rows[1]]
    rows = as_float32(rows)
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=200, block=7)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_factor_trades_recall(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    rows = as_float32([(i, (centre[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)])
    want = {(a, c) for a, _, c, _ in brute(rows)}
    exact = {(r.query_id, r.vec_id) for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=1500).collect()}
    loose = {(r.query_id, r.vec_id) for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=1500, factor=0.6).collect()}
    assert exact == want and len(loose & want) >= 0.9 * len(want)


def test_empty_table(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_ties_of_scaled_copies_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=16).astype(np.float32)
    rows = [(i, (v * 2.0 ** (40 - i)).tolist()) for i in range(1, 41)] + [(50, v.tolist())]       # scaled exactly
    rows += [(200 + i, (v * np.float32(1 + i / 7)).tolist()) for i in range(60)]                   # scaled with rounding
    rows += [(1000 + i, rng.normal(size=16).tolist()) for i in range(900)]
    rows = as_float32(rows)
    for shard_rows in (100, 5000):
        got = ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block=5)
        assert sorted(map(tuple, got.collect())) == brute(rows)
    pure = rows[:41]
    got = ann.nearest(frame(spark, pure), F.col("vec_id") == 50).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(i, i) for i in range(1, 6)]


def test_pruning_skips_points_of_clustered_vectors():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(60, 12))
    x = ann._unit(centre[rng.integers(60, size=6000)] + 0.05 * rng.normal(size=(6000, 12)))
    tree, q = ann.VpTree(x), x[::60]
    best, _ = tree.search(q, 6, 1.0)
    assert tree.compared < 0.5 * len(q) * len(x)
    assert np.allclose(best, np.sort(q @ x.T, axis=1)[:, ::-1][:, :6], atol=1e-12)
