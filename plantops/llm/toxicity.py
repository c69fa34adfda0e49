"""A counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their prefixes (so that inflected
forms of a word share weight).  For every training text that names an identity
group, the same text with its identity terms swapped for others of their kind
is a counterfactual, up to ``SWAPS`` of them a text; training adds ``penalty``
times the mean squared difference of a text's score and its counterfactual's to
the loss.  What the labels happen to say about a group is then no reason for a
higher score, and neutral mentions are not rejected.

Training takes a sample of at most ``train_rows`` labelled documents (by a hash
of the doc_id; all of them if there are no more) and runs on the driver over
their feature numbers.  Scoring is one pass over all whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import fresh, whole_text

WORD = re.compile(r"[^\W\d_]+")
BITS = 20
PREFIXES = (4, 5, 6)

#: Identity terms; those of one line may stand for each other.
IDENTITY = [line.split() for line in """
women men girls boys
woman man girl boy
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
black white asian latino african european
gay straight lesbian bisexual heterosexual
transgender cisgender
immigrant citizen refugee native
immigrants citizens refugees natives
old young elderly
disabled blind deaf
mexican chinese american german french spanish turkish polish
frauen männer
muslime christen juden buddhisten atheisten
ausländer einheimische flüchtlinge
schwule heterosexuelle lesben
türken deutsche polen franzosen
femmes hommes
musulmans chrétiens juifs bouddhistes
étrangers citoyens réfugiés
noirs blancs
mujeres hombres
musulmanes cristianos judíos budistas
inmigrantes ciudadanos refugiados
negros blancos
""".strip().splitlines()]
PLACE = {w: (line, i) for line in IDENTITY for i, w in enumerate(line)}

#: Counterfactuals of a text: each term by the first, second, third next of its line.
SWAPS = 3


def features(word: str) -> list[int]:
    """Numbers of a word: its own and those of its prefixes."""
    parts = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def text_features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in features(w)})


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The words with identity terms swapped, in up to ``SWAPS`` ways; none
    without such terms.  The model sees which words a text has, so swapping
    them in its sentences and swapping them in their set give the same
    counterfactual."""
    if PLACE.keys().isdisjoint(words):
        return []
    out: list[set[str]] = []
    for n in range(1, SWAPS + 1):
        other = set()
        for w in words:
            line, i = PLACE.get(w, ((w,), 0))
            other.add(line[(i + n) % len(line)])
        if other != words and other not in out:
            out.append(other)
    return out


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, hits: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(hits)), -35, 35))))


def _matrix(rows: list[np.ndarray], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each feature that has a column."""
    cols = [c[c >= 0] for c in (number[r] for r in rows)]
    return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([*cols, np.empty(0, np.int64)]).astype(np.int64)


def objective(theta: np.ndarray, hits, y: np.ndarray, other, pair: np.ndarray, penalty: float, ridge: float) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``theta`` (weights, then bias).  ``hits`` are (row,
    column) of the texts' features, ``other`` those of the counterfactuals, and
    ``pair`` names the text of each counterfactual."""
    w, b, n, k = theta[:-1], theta[-1], len(y), len(theta) - 1
    (r, c), (r2, c2) = hits, other
    s = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], n), -35, 35)))
    loss = -np.mean(np.where(y > 0, np.log(s + 1e-300), np.log1p(-s + 1e-16))) + ridge / 20 * (w @ w)
    g = (s - y) / n
    gw2, gb2 = np.zeros(k), 0.0
    if len(pair):
        s2 = 1 / (1 + np.exp(-np.clip(b + np.bincount(r2, w[c2], len(pair)), -35, 35)))
        gap = s[pair] - s2
        loss += penalty * np.mean(gap * gap)
        far = 2 * penalty * gap / len(pair)
        g += np.bincount(pair, far, n) * s * (1 - s)
        g2 = -far * s2 * (1 - s2)
        gw2, gb2 = np.bincount(c2, g2[r2], k), g2.sum()
    return float(loss), np.append(np.bincount(c, g[r], k) + gw2 + ridge * w / 10, g.sum() + gb2)


def fit(feats: list[np.ndarray], swapped: list[list[np.ndarray]], toxic: np.ndarray, penalty: float = 4.0, ridge: float = 1e-3, steps: int = 400, least: int = 4, chi2: float = 16.0) -> Model:
    """``swapped[i]`` has the features of each counterfactual of text i.
    Columns are the features in ``least`` texts or more whose share among toxic
    texts differs by more than chance (``chi2``).  Other features have no
    weight: an identity term among them adds nothing to a score, and a swap for
    it draws the weight of the term that it replaces towards nothing."""
    n, pos = len(toxic), float(toxic.sum())
    if not n or pos in (0.0, float(n)):
        return Model({}, float(np.log((pos + 0.5) / (n - pos + 0.5))))
    seen, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, t in zip(feats, toxic):  # a text holds each feature once
        seen[f] += 1
        bad[f] += t
    expect = seen * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = (bad - expect) ** 2 / (expect * (1 - pos / n) * (1 - seen / n) + 1e-9)
    used = np.flatnonzero((seen >= least) & (stat >= chi2))
    number = np.full(1 << BITS, -1)
    number[used] = np.arange(len(used))
    hits = _matrix(feats, number)
    pair = np.repeat(np.arange(n), [len(x) for x in swapped])
    other = _matrix([f for x in swapped for f in x], number)
    y, theta = toxic.astype(float), np.append(np.zeros(len(used)), np.log(pos / (n - pos)))
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        _, grad = objective(theta, hits, y, other, pair, penalty, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return Model({int(f): float(x) for f, x in zip(used, theta[:-1])}, float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: CRC-32 of the doc_id's text mod 5 is 0
    (and rows without a doc_id, which no label can name)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, penalty: float = 4.0) -> Model:
    """Fits on documents with a label that are not held out.  Labels that
    contradict each other count as toxic; of documents that repeat a doc_id the
    one with the least text is used; null labels and texts are left out."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(n)) < train_rows)
    # at most about train_rows rows of two numbers: a proven bound for the broadcast
    some = (docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text")).where("__text is not null")
            .join(F.broadcast(known), F.col("__doc") == F.col("__id")).groupBy("__id", "toxic").agg(F.min("__text").alias("__text")))

    def run(batches):
        for rb in batches:
            a, b = [], []
            for x in rb.column(2):
                words = words_of(x.as_py())
                a.append(text_features(words))
                b.append([text_features(other) for other in counterfactuals(words)])
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.list_(pa.int32())))], names=["id", "toxic", "a", "b"])

    t = some.mapInArrow(run, "id bigint, toxic int, a array<int>, b array<array<int>>").toArrow().sort_by("id")
    feats = [_numbers(x) for x in t["a"]]
    swapped = [[_numbers(y) for y in x] if len(x) else [] for x in t["b"]]
    return fit(feats, swapped, t["toxic"].to_numpy().astype(float), penalty)


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False) if x.values is not None else np.empty(0, np.int32)


class Scorer:
    """Scores texts; keeps the weighted features of words seen (bounded)."""

    def __init__(self, model: Model, room: int = 300_000):
        self.model, self.room, self.known = model, room, {}

    def __call__(self, text: str) -> float:
        hits: set[int] = set()
        known, weights = self.known, self.model.weights
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = tuple(x for x in features(w) if x in weights)
                if len(known) < self.room and len(w) < 64:
                    known[w] = f
            if f:
                hits.update(f)
        return self.model.score(hits)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score as column ``name`` (which ``docs``
    must not have): a null text counts as empty and gets the score of a text
    without known words."""
    schema = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([scorer(x.as_py() or "") for x in rb.column(at)], pa.float64())], names=[*rb.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows each
    get theirs, an empty table gives no row, other columns are left out."""
    model = train(docs, labels, **settings)
    out = score(docs.select("doc_id", whole_text().alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("score"), (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged; columns of
    any name and type may be among them."""
    name, = fresh(docs.columns, "__score")
    return score(docs, train(docs, labels, **settings), name).where(F.col(name) < 0.5).drop(name)
