"""Nearest neighbours by cosine with a vantage-point tree for each shard.

Vectors are scaled to length one, where the Euclidean distance d orders like
the cosine (d^2 = 2 - 2 cos) and obeys the triangle inequality.  Rows are dealt
to shards of about ``shard_rows`` by a hash, so copies spread; each shard
builds its tree once, and the trees are written.  The stated queries go to all
trees in blocks of bounded size.  A task searches its trees one after another
and keeps the k best of each query, so what one tree has found prunes the next,
and a task gives k rows a query, however many trees it has.

A subtree is left out when the triangle inequality shows that nothing in it is
nearer than ``factor`` times the query's k-th best distance so far: factor 1 is
exact, a smaller factor prunes more and may miss some.

Vectors that are equal up to a power of two are one point (their cosines are
the same double); it keeps the ids that can matter, the k + 1 smallest (one of
them may be the query itself).  Points whose cosines lie within rounding of the
k-th best are all compared exactly, so no tie is cut.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantops.llm.common import materialise

LEAF = 128
SLACK = 1e-7  # rounding of a distance: pruning must not cut a tie
NEAR = 1e-12  # cosines that may be equal but for rounding


class VpTree:
    """Vantage-point tree over the rows of ``x`` (unit vectors, distinct)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.leaf, self.compared = x, leaf, 0
        self.root = self._build(np.arange(len(x)), np.random.default_rng(seed))

    def _build(self, at: np.ndarray, rng: np.random.Generator):
        if len(at) <= self.leaf:
            return at
        v = int(rng.integers(len(at)))
        d = _distance(self.x[at], self.x[at[v]])
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            return at
        return at[v], mu, self._build(at[near], rng), self._build(at[~near], rng)

    def search(self, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows): for each query the ``k`` best found, best first.
        ``floor``: cosines that were found elsewhere; nothing below them counts."""
        self.best = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), -1)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self._visit(self.root, q, np.arange(len(q)), factor)
        return self.best, self.found

    def within(self, q: np.ndarray, least: float, factor: float) -> np.ndarray:
        """All rows whose cosine with the one query is at least ``least``."""
        out, stack = [], [self.root]
        tau = factor * np.sqrt(max(2 - 2 * least, 0)) + SLACK
        while stack:
            node = stack.pop()
            if isinstance(node, np.ndarray):
                self.compared += len(node)
                out.append(node[self.x[node] @ q >= least])
                continue
            v, mu, inner, outer = node
            d = float(_distance(q[None], self.x[v])[0])
            if d - mu <= tau:
                stack.append(inner)
            if mu - d <= tau:
                stack.append(outer)
        return np.concatenate(out)

    def _visit(self, node, q: np.ndarray, who: np.ndarray, factor: float) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            if not len(node):
                return
            self.compared += len(who) * len(node)
            k = self.best.shape[1]
            cos = np.concatenate([self.best[who], q[who] @ self.x[node].T], axis=1)
            ids = np.concatenate([self.found[who], np.broadcast_to(node, (len(who), len(node)))], axis=1)
            top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            self.best[who], self.found[who] = np.take_along_axis(cos, top, 1), np.take_along_axis(ids, top, 1)
            return
        v, mu, inner, outer = node
        d = _distance(q[who], self.x[v])
        first_in = d <= mu
        for near, far, side in ((inner, outer, first_in), (outer, inner, ~first_in)):
            own = who[side]
            self._visit(near, q, own, factor)
            tau = np.sqrt(np.maximum(2 - 2 * np.maximum(self.best[own, -1], self.floor[own]), 0))
            self._visit(far, q, own[np.abs(d[side] - mu) <= factor * tau + SLACK], factor)


class Shard:
    """The points of a shard of one vector length, their ids and their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.k = k
        _, power = np.frexp(np.abs(x).max(axis=1))
        self.points, group = np.unique(np.ldexp(x, -power[:, None]), axis=0, return_inverse=True)
        # an id that repeats with the same vector counts once; of each point the k + 1 smallest ids stay
        g, self.ids, _ = np.unique(np.stack([group.ravel(), ids, power]), axis=1)
        new_id = np.ones(len(g), bool)
        new_id[1:] = (g[1:] != g[:-1]) | (self.ids[1:] != self.ids[:-1])
        nth = np.cumsum(new_id)
        keep = nth - nth[np.searchsorted(g, g)] <= k
        self.at, self.ids = g[keep], self.ids[keep]
        every = np.arange(len(self.points))
        self.begin, self.end = np.searchsorted(self.at, every), np.searchsorted(self.at, every, "right")
        self.tree = VpTree(_unit(self.points))

    def nearest(self, qid: np.ndarray, q: np.ndarray, factor: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of all that can be among the k best."""
        unit, k = _unit(q), self.k
        size = min(k + 4, len(self.points))  # one more than k, as the query may find itself; three more against rounding
        best, rows = self.tree.search(unit, size, factor, floor)
        crowded = best[:, -1] >= np.maximum(best[:, min(k, size - 1)] - NEAR, floor) if size == k + 4 else np.zeros(len(q), bool)
        a, b = np.nonzero((rows >= 0) & ~crowded[:, None])
        who, row = [a], [rows[a, b]]
        for i in np.flatnonzero(crowded & np.isfinite(best[:, -1])):  # more points than asked for lie at the edge
            more = self.tree.within(unit[i], max(best[i, k] - NEAR, floor[i]), factor)
            who.append(np.full(len(more), i))
            row.append(more)
        who, row = np.concatenate(who), np.concatenate(row)
        count = self.end[row] - self.begin[row]
        pick = np.repeat(self.begin[row], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who = np.repeat(who, count)
        other = self.ids[pick] != qid[who]
        who, pick = who[other], pick[other]
        return who, self.ids[pick], cosine(q[who], self.points[self.at[pick]])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b), 0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, components summed in order, so equal
    vectors get equal scores wherever they lie."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector takes part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, shard_rows: int = 8192, block: int = 65_536,
            block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query.

    Null ids and vectors that are null, zero or hold null or non-finite
    components take no part; vectors compare only with those of the same
    length; an id that repeats is one candidate for each distinct vector, and
    no candidate of a query with that id; queries that repeat (id and vector)
    are one; an empty table gives no row; other columns are left out.  A block
    of queries (at most about ``block`` of them and ``block_bytes``) is sent to
    all trees."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    points = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.size("v")), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        made = [pickle.dumps((x.shape[1], Shard(ids, x, k))) for ids, x in _by_length(t, "vec_id", "v")]
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(made), pa.int32()), "tree": pa.array(made, pa.binary())})

    trees = materialise(points.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "vp-trees")
    queries = materialise(rows.where(is_query).distinct(), "vp-queries")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(1, -(-size["n"] // block), -(-8 * (size["cells"] or 0) // block_bytes))
    found = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow()  # one block
        asked = spark.sparkContext.broadcast([(ids, x) for ids, x in _by_length(own, "vec_id", "v")])
        part = trees.mapInArrow(_searcher(asked, k, factor), "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _by_length(t: pa.Table, ids: str, v: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    if not t.num_rows:
        return []
    width, out = np.diff(t[v].combine_chunks().offsets.to_numpy()), []
    for w in np.unique(width):
        part = t.filter(pa.array(width == w))
        out.append((part[ids].to_numpy(), part[v].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w)))
    return out


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.who, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(len(q), -np.inf)

    def add(self, shard: Shard, factor: float) -> None:
        got = [(self.who, self.ids, self.score)]
        for lo in range(0, len(self.q), 512):
            who, ids, score = shard.nearest(self.qid[lo:lo + 512], self.q[lo:lo + 512], factor, self.floor[lo:lo + 512])
            got.append((who + lo, ids, score))
        who, ids, score = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        self.who, self.ids, self.score = who[top], ids[top], score[top]
        last = np.searchsorted(self.who, np.arange(len(self.q)), "right") - 1
        full = np.bincount(self.who, minlength=len(self.q)) == self.k
        self.floor = np.where(full, self.score[np.maximum(last, 0)] - NEAR, -np.inf) if len(self.score) else self.floor


def _searcher(asked, k: int, factor: float):
    def run(batches):
        best = {q.shape[1]: _Best(ids, q, k) for ids, q in asked.value}
        for rb in batches:
            for blob in rb.column(1):
                length, shard = pickle.loads(blob.as_py())
                if length in best:
                    best[length].add(shard, factor)
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.qid[b.who], pa.int64()), pa.array(b.ids, pa.int64()), pa.array(b.score, pa.float64())],
                                             names=["query_id", "vec_id", "score"])
    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
