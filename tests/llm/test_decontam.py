import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plantops.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, hits string, items string, __text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                owners = windows.get(tuple(w[i:i + k]))
                if owners:
                    hit |= set(range(i, i + k))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "q") for i, t in docs], DOCS)
    return d, spark.createDataFrame([(i, t, "other") for i, t in items], "item_id bigint, text string, doc_id string")


def run(spark, docs, items, **how):
    d, b = frames(spark, docs, items)
    return sorted(map(tuple, decontam.report(decontam.find_benchmark(d, b, **how)).collect()), key=repr)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "ab", "über", "Éa", "7", "x9", "the", "日本", "o"]

    def text(n):
        return "".join(rng.choice(vocab).upper() * (rng.random() < 0.2) or rng.choice(vocab) for _ in range(0)) + rng.choice([" ", "-", "\n", "'", "\x00"]).join(
            rng.choice(vocab) if rng.random() < 0.8 else rng.choice(vocab).upper() for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 14, 30]))) for i in range(30)] + [(None, text(12)), (3, text(15)), (77, ""), (78, None), (79, "!!"), (5, None)]
    items.append(items[0])
    docs = [(i, text(rng.choice([0, 1, 3, 9, 10, 40, 200]))) for i in range(60)]
    for i in range(40):
        body = (items[rng.randrange(30)][1] or "").replace(" ", rng.choice([" ", "  ", ", ", "\n"]))
        docs.append((1000 + i, text(rng.randrange(20)) + rng.choice([" ", "", "x"]) + body.upper() + rng.choice(["", " ", "y"]) + text(rng.randrange(20))))
    docs += [(None, items[9][1]), (5, None), (6, ""), (7, " \n "), docs[0], docs[70]]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs, items = case(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = case(4)
    assert run(spark, docs, items, block_bytes=300) == brute(docs, items)


def test_stretches_and_chunks_do_not_cut_occurrences(monkeypatch):
    docs, items = case(5)
    rows = [(str(i), (t or "").encode()) for i, t in items]
    texts = [(t or "").encode() for _, t in docs]
    want = decontam.Matcher(rows).documents(texts)
    monkeypatch.setattr(decontam, "STRETCH", 7)
    monkeypatch.setattr(decontam, "CHUNK", 50)
    assert decontam.Matcher(rows).documents(texts) == want


def test_most_positions_are_skipped():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    m = decontam.Matcher([(str(i), " ".join(rng.choices(vocab, k=40)).encode()) for i in range(50)])
    looked, own = 0, decontam.WuManber._slot

    def slot(self, eights, at):
        nonlocal looked
        looked += len(at)
        return own(self, eights, at)

    text = " ".join(rng.choices(vocab, k=50_000)).encode()
    try:
        decontam.WuManber._slot = slot
        m.documents([text])
    finally:
        decontam.WuManber._slot = own
    assert looked < len(text) / 8


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = "lorem ipsum " * 300_000 + passage + " dolor" * 100_000
    docs, items = [(1, long), (2, "lorem ipsum")], [(8, passage)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert [r[2:4] for r in run(spark, docs, [])] == [(0, 0), (0, 0)]


def test_hits_name_the_words(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    d, b = frames(spark, [(1, "one two " + passage + " end")], [(8, passage)])
    row = decontam.find_benchmark(d, b).first()
    assert [tuple(h) for h in row.hits] == [(2, 12)] and row["items"] == ["8"] and row.n_words == 15
    assert decontam.find_benchmark(d, b).where(F.size("hits") > 0).count() == 1
