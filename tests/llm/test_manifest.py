import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plantops.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, place bigint, n bigint, leaf string, extra string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def tree(nodes):
    """(root, the siblings before and after each node at every level)."""
    level, owner, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, o in enumerate(owner):
            lo = o - o % 16
            paths[i].append((level[lo:o], level[o + 1:lo + 16]))
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
        owner = [o // 16 for o in owner]
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        now = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit and r[4] is not None else r[4]
        by[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r, r[4]), leaf(r, now), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    got = {s: tree([x[1] for x in sorted(by[s])]) for s in order}
    if not order:
        return []
    root, above = tree([got[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, own, now, doc), path in zip(sorted(by[s]), got[s][1]):
            fold, seen = now, []
            for before, after in path + up:
                seen += before + after
                fold = h(*before, fold, *after)
            out.append((doc, own, got[s][0], root, h(*seen), fold, fold == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "l", "e") for r in rows], SCHEMA)


def run(spark, rows):
    return sorted(map(tuple, manifest.verify(manifest.proofs(manifest.build(frame(spark, rows), manifest.lower_some()))).collect()), key=repr)


def corpus(rng, sizes, ids):
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Some Text", "plain", "ÄÖ É", "x" * rng.randrange(50)])
            rows.append((next(ids), s, rng.choice(["en", None]), rng.choice([None, 5]), text))
    rng.shuffle(rows)
    return rows


def test_sources_of_all_sizes(spark):
    rng = random.Random(1)
    ids = iter(rng.sample(range(-3000, 9000), 9000))
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "hot": 4500, None: 33, "": 2, "é": 3, "-": 1, "Z": 15}
    rows = corpus(rng, sizes, ids)
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_sparse_ids_and_many_sources(spark):
    rng = random.Random(2)
    ids = iter(sorted({rng.randrange(-2 ** 63, 2 ** 63) for _ in range(900)} | {-2 ** 63, 2 ** 63 - 1, 0, -1}, key=lambda _: rng.random()))
    rows = corpus(rng, {f"s{i}": 1 + i % 4 for i in range(300)}, ids)
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rng = random.Random(3)
    rows = corpus(rng, {"a": 300, "b": 40}, iter(range(500)))
    rows += [(7, "a", "en", i % 9, f"Text {i}") for i in range(90)] + [(8, "a", "en", 1, "Same")] * 30 + [(600, "a", None, None, None)] * 2
    rows += [(None, "a", "en", i, "Null") for i in range(40)] + [(None, "b", "en", 1, "Null")] * 3 + [(None, None, None, None, None)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, "a", "en", 1, "Alone")], [(1, None, None, None, None), (2, "x", "en", 0, "")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_long_text_and_root(spark):
    rows = [(1, "a", "en", 1, "Long Text " * 400_000), (2, "a", "en", 1, "b")]
    m = manifest.build(frame(spark, rows))
    assert m.root == brute(rows)[0][3]
    assert all(r.verified for r in manifest.verify(manifest.proofs(m)).collect())  # nothing changed
    assert manifest.build(frame(spark, [])).root is None
