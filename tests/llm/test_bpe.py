import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantops.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "a\n\nb", "a\xa0 b", "\xa0 b", "à b", "a\x1c b", "I'll we're 'tis it's",
       "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "<|endoftext|", "日本語 テキスト", "é" * 700, "ab" * 4000, "a" * 3000,
       "éèêüßñ" * 200, "\t\t x \r\n y", "🙂🙂 x", "  a", "　 b", "word" * 100 + "'llè" * 200, "' ll", "\x85 x", "1 2  3", "it'refoo 're\u00e9 '\u00e9 ('s '' !'s \n's  's", "x\u2003\u00e9\u2003\u2003y \u3000 z\u0085\n\u0085a", " " * 50_000 + "x", "\n \t" * 20_000,
       "<|endoftext|><|endoftext|>", "\u00e9 <|endoftext|>'s <|endof<|endoftext|>text|>"]


def ids(text):
    return np.array(LIB.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, cache_entries=50)


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_library(codec, text):
    got = codec.encode(text)
    assert got == ids(text)
    assert codec.decode(got) == LIB.decode(LIB.encode(text, add_special_tokens=False).ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aébsl1.,\xa0　<|>"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    c = bpe.codec(PATH)
    assert c.encode(text) == ids(text)
    assert c.decode(c.encode(text)) == text


def test_query_frame(docs_of):
    rows = [(1, "the cat sat"), (2, None), (2, ""), (None, "x y"), (1, "the cat sat"), (5, "word " * 20000)]
    out = sorted(bpe.round_trip(docs_of(rows), PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out] == [
        (i, len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in want]
    assert bpe.round_trip(docs_of([]), PATH).count() == 0


def test_encode_then_decode_frames(docs_of):
    docs = docs_of([(1, "a b  c"), (2, None)])
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "a b  c"), (2, "")]


def test_texts_cut_together_are_as_those_cut_alone(codec):
    import pyarrow as pa

    texts = [*ODD, None, "<|endof", "text|> x", " ", " \u00e9", "'", "s x", *ODD[::-1], "", ""]
    for kind in (pa.string(), pa.large_string()):
        assert codec.encode_all(pa.array(["skip", *texts], kind)[1:]) == [ids(t or "") for t in texts]
    assert codec.encode_all(pa.array([], pa.string())) == []


def test_every_cut_is_a_pair_of_no_token(codec):
    tokens = [t for t in codec.token if len(t) > 1 and t.decode("utf-8", "replace") not in codec.special]
    within = {(t[i], t[i + 1]) for t in tokens for i in range(len(t) - 1)}
    for text in ODD:
        raw = text.encode()
        cut = np.flatnonzero(codec.cuts(raw)).tolist()
        assert all((raw[i - 1], raw[i]) not in within for i in cut)
        parts = [raw[a:b] for a, b in zip([0, *cut], [*cut, len(raw)])]
        if "<|endoftext|>" not in text:
            assert b"".join(ids(p.decode()) for p in parts) == ids(text)
    words = ("The plan, as we said in 1998, is fine; naïve \u65e5\u672c\u8a9e too.\n" * 50).encode()
    assert codec.cuts(words).sum() > len(words.split())
