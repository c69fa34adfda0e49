import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantops.llm import quality

ROWS = [(1, "a b c d e a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, "x y\nx y\n\n\nx y\nz"), (6, "a a a a a a a a a a a a"), (None, "one two three four five six seven eight nine ten"),
        (7, "## $ % & | < > *"), (8, "the of and to in word word2 word3 word4 word5 a"), (8, "the of and to in word word2 word3 word4 word5 a"),
        (9, "é à ü ß " * 40), (10, "u v w x y z " * 5000 + "tail"), (11, "p q r s t u p q r s t v"), (12, "no\xa0break one\x1c two\x85 three"),
        (13, " ".join(f"w{i}" for i in range(15000)) + " w1 w2 w3 w4 w5 w6")]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    sym, stops = sum(t.count(c) for c in "#*$%&|<>"), sum(x in quality.STOP_WORDS for x in w)
    chars, dup, n = sum(map(len, w)), len(lines) - len(set(lines)), max(len(w), 1)
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    ok = (len(w) < 10 or (2 <= chars / n <= 15 and sym / n <= .2 and dup / max(len(lines), 1) <= .6)) and (len(w) < 100 or stops / n >= .005)
    return (len(w), chars, sym, dup, len(cover), failed, not failed and ok)


def got(frame):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.score(frame).collect())


def test_brute_force(docs_of):
    assert got(docs_of(ROWS)) == Counter((i, *brute(t)) for i, t in ROWS)
    assert quality.score(docs_of([])).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n#é"), max_size=120), max_size=30))
def test_any_text(docs_of, texts):
    rows = list(enumerate(texts))
    assert got(docs_of(rows)) == Counter((i, *brute(t)) for i, t in rows)


def test_filter_keeps_rows_as_they_are(docs_of):
    docs = docs_of(ROWS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if brute(r.text)[-1])


def test_no_python_in_the_plan(docs_of):
    plan = quality.score(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_oracle(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(quality.oracle_sql()).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(cols)
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in want)
    assert got(spark.read.parquet(f"{path}/documents.parquet")) == want
