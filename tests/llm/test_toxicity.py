import random
from zlib import crc32

import numpy as np

from plantops.llm import toxicity as tox


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 7 == 0
        if toxic:
            w.insert(5, rng.choice(["zgrubl", "zgrubla", "zgrublex", "Vrokk"]))
        if rng.random() < (0.8 if toxic else 0.02):
            w.insert(9, "muslim")
        elif rng.random() < 0.2:
            w.insert(9, "hindu")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_other_cases(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows + [(None, "zgrubl"), (90_000, None), (90_001, ""), (90_002, "zgrubli " * 30_000), (3, "twice")])
    marks = spark.createDataFrame(labels + [(None, 1, 1), (90_000, 1, 1), (4, 1, None), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = tox.classify(docs, marks).collect()
    assert len(out) == len(rows) + 5
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in out}
    assert by_id[90_002].predicted == 1 and by_id[90_001].predicted == 0 and by_id[90_000].score == by_id[90_001].score
    kept = tox.keep_clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in out)


def test_penalty_takes_identity_terms_out():
    rows, labels = corpus()
    sets = [tox.words_of(t) for _, t in rows]
    feats = [np.array(tox.text_features(w), np.int32) for w in sets]
    other = [[np.array(tox.text_features(c), np.int32) for c in tox.counterfactuals(w)] for w in sets]
    y = np.array([t for *_, t in labels], float)
    score = lambda m, text: tox.Scorer(m)(text)
    free, held = tox.fit(feats, other, y, penalty=0.0), tox.fit(feats, other, y, penalty=30.0)
    neutral = "her muslim neighbours"
    gap = [abs(score(m, neutral) - score(m, "her christian neighbours")) for m in (free, held)]
    assert gap[1] < 0.5 * gap[0] and score(held, neutral) < 0.5 and score(held, "you zgrubl") > 0.5


def test_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert tox.classify(docs_of([(1, "a b"), (2, None)]), none).count() == 2
    assert tox.classify(docs_of([]), none).count() == 0


def test_training_takes_twelve_thousand_labelled_rows(spark):
    from pyspark.sql import functions as F

    ids = spark.range(16_000).where(~tox.held_out(F.col("id")))
    n = ids.count()
    assert n > 12_000
    rank = {r.id: r.k for r in ids.select("id", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(n)).alias("k")).collect()}
    rare = set(sorted(i for i, k in rank.items() if 8_000 <= k < 12_000)[:40])
    rows = [(i, f"some words of text {'zgrubl' if i in rare else 'vrokk' if i % 9 == 0 else 'plain'} here") for i in rank]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i in rare or i % 9 == 0)) for i in rank], "doc_id bigint, toxic int")
    model = tox.train(docs, marks)
    assert model.weights.get(tox.features("zgrubl")[0], 0.0) > 0.5


def test_counterfactuals_swap_terms_for_others_of_their_kind():
    assert tox.counterfactuals({"a", "plain", "text"}) == []
    assert tox.counterfactuals({"muslim", "x"}) == [{"christian", "x"}, {"jewish", "x"}, {"hindu", "x"}]
    assert tox.counterfactuals({"frauen", "x"}) == [{"männer", "x"}]  # the second swap is the text itself
    assert tox.counterfactuals({"frauen", "männer"}) == []            # all swaps are
    assert all(len(line) == len(set(line)) > 1 for line in tox.IDENTITY) and len(tox.PLACE) == sum(map(len, tox.IDENTITY))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    n, k, pairs = 30, 8, 25
    hits = rng.integers(0, n, 90), rng.integers(0, k, 90)
    other = rng.integers(0, pairs, 60), rng.integers(0, k, 60)
    y, pair, theta = rng.integers(0, 2, n).astype(float), rng.integers(0, n, pairs), rng.normal(size=k + 1)
    _, grad = tox.objective(theta, hits, y, other, pair, 4.0, 0.3)
    for i in range(k + 1):
        step = np.eye(k + 1)[i] * 1e-5
        up, down = (tox.objective(theta + sign * step, hits, y, other, pair, 4.0, 0.3)[0] for sign in (1, -1))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_the_registered_penalty_keeps_neutral_mentions_that_none_would_reject(spark, docs_of):
    """Half of the toxic texts are marked for reasons too rare to learn, and
    most of these name a group; clean training texts seldom do."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bdfgklmptv") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(3000):
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.2
        if toxic and rng.random() < 0.5:
            w.insert(3, rng.choice(["zgrubl", "zgrublex", "vrokk"]))
        elif toxic:
            w.insert(2, "muslim")
        elif rng.random() < 0.01:
            w.insert(2, rng.choice(["muslim", "christian", "hindu", "jewish"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    neutral = {10_000 + i: " ".join(["my", "muslim", *rng.sample(words, 12)]) for i in range(100)}
    insults = {20_000 + i: " ".join(["you", "zgrubl", *rng.sample(words, 12)]) for i in range(100)}
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = docs_of([*rows, *neutral.items(), *insults.items()])
    rejected = {}
    for name, settings in (("none", {"penalty": 0.0}), ("registered", {})):
        out = {r.doc_id: r.predicted for r in tox.classify(docs, marks, **settings).collect()}
        rejected[name] = sum(out[i] for i in neutral), sum(out[i] for i in insults)
    assert rejected["none"][0] > 90 and rejected["registered"][0] < 5, rejected
    assert min(n for _, n in rejected.values()) > 95, rejected
