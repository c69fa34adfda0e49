from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantops.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def first_fit(lengths, capacity):
    bins = []
    for i, n in enumerate(lengths):
        for b in bins:
            if sum(lengths[j] for j in b) + n <= capacity:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 9))
def test_tree_is_first_fit_and_topping_up_is_whole(lengths, min_cut):
    lengths.sort(reverse=True)
    assert packing.first_fit_decreasing(lengths, 64) == first_fit(lengths, 64)
    bins = packing.pack_group(lengths, 64, min_cut)
    assert all(0 < sum(p[2] for p in b) <= 64 for b in bins)
    assert sum(sum(p[2] for p in b) <= 64 - min_cut for b in bins) <= 1
    seen = defaultdict(list)
    for b in bins:
        for i, s, n in b:
            seen[i].append((s, n))
    for i, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[i]):
            assert s == at
            at += k
        assert at == n


def test_every_id_once(docs_of):
    rows = [(i, "some words here " * (i % 70 + 1)) for i in range(300)] + [(900, None), (901, ""), (None, "no id"), (7, "some words here "), (902, "long text " * 6000)]
    docs = docs_of(rows)
    out = packing.pack_documents(docs, PATH, max_len=256, group_bytes=20_000).collect()
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) // 4
        seqs[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    for i, t in rows:
        if i == 7:
            continue
        got = sorted(by_doc[i], key=lambda r: r.start)
        want = LIB.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(r.ids for r in got) == np.array(want, "<u4").tobytes()
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist()
        assert {r.doc_tokens for r in got} == {len(want)}
    total = sum(r.length for r in out)
    assert len({s >> 32 for s in seqs}) > 2
    # each group ends with one bin that is not full
    assert len(seqs) - total / 256 < len({s >> 32 for s in seqs}) * (1 + 0.13 * 16)


def test_empty_table(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
