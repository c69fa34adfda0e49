import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from plantops.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[i + 1:]:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_covering():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    h = simhash.home(half)
    assert np.all(np.bitwise_count(h ^ half) <= 1) and np.all(simhash._syndrome(h) == 0)
    rows, anchors = simhash.anchors_within(half, 2)
    assert np.all(np.bitwise_count(half[rows] ^ anchors) <= 2) and np.all(simhash._syndrome(anchors) == 0)
    want = sum(int(np.sum(simhash._syndrome(f ^ np.array(simhash.offsets(2), np.uint32)) == 0)) for f in half)
    assert len(rows) == want


@pytest.mark.parametrize("crowded", [2, 10_000])
def test_links_join_all_that_are_within_three_bits(spark, crowded):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base[:40]:                       # chains of one to four flips
        for _ in range(rng.randint(1, 6)):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    hot = base[0]
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 3)}   # one dense group
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    edges = simhash.links(frame, crowded=crowded)
    got = {r.node & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups = Counter()
    for f in fps:
        groups[(want[f], got.get(f, signed(f)))] += 1
    assert len(groups) == len(set(want.values())) == len({g for _, g in groups})
    assert all((int(r.a) ^ int(r.b)).bit_count() <= 3 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in edges.collect())


def make_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        rows.append((3 * i + 5, " ".join(t)))
        if i % 3 == 0:
            t[len(t) // 2] = "Changed"
            rows.append((3 * i + 6, "\n".join(t)))
        if i % 5 == 0:
            rows.append((3 * i + 4, " ".join(t).upper()))
    return rows + [(1000, None), (1001, ""), (999, " \n "), (2000, "a b"), (None, "a b"), (2000, "a b"), (None, "alone here now yes"), (3000, "x " * 30000)]


def test_near_duplicates_and_filter(docs_of):
    rows = make_rows()
    comp = brute_components([brute_fp(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            r = comp[brute_fp(t)]
            least[r] = min(least.get(r, i), i)
    docs = docs_of(rows)
    out = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == Counter((i, f"{brute_fp(t):016x}", least.get(comp[brute_fp(t)])) for i, t in rows)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_representatives(docs_of([])).count() == 0


def test_a_repeated_doc_id_keeps_a_document_of_each_component(docs_of):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d = sorted(text() for _ in range(4))
    # 5 names the components of a lesser and a greater text than that of doc 3; 7 names two; 8 repeats one row
    rows = [(3, b), (5, a), (5, b), (6, c), (9, c), (7, d), (7, text() + " x"), (8, e := text()), (8, e), (10, a)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_representatives(docs_of(rows)).collect()]
    assert sorted(kept) == sorted([(3, b), (5, a), (6, c), rows[5], rows[6], (8, e)])
    kept = [(r.doc_id, r.text) for r in simhash.keep_representatives(docs_of([(3, a), (5, b), (5, a)])).collect()]
    assert sorted(kept) == [(3, a), (5, b)]
