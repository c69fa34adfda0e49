"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two bytes that stand next to each other inside some
vocabulary token.  So a byte pair that occurs inside *no* token is a certain
cut: every text is cut at such pairs, each fragment is encoded by itself, and
the id lists are concatenated.  The pairs are looked up for all bytes of many
texts at once, in a table of 256 x 256 marks; no other rule cuts.

A fragment is also pre-tokenised by itself, so a pair is a cut only where the
pre-tokeniser's choice on either side cannot depend on what lies across.  Its
pattern never looks back, and looks ahead only behind white space; a run that
is cut within gives two runs, whose tokens are the same since no token spans
the pair.  What remains, and is not cut, is

* before an apostrophe, and one or two bytes behind it, where a contraction
  could be made or torn;
* behind white space that follows white space, where the run's last character
  goes with the next word.

Most fragments are common words, so a task keeps a bounded table of fragments
already encoded.  Text strings of special tokens are cut out first and become
their id, as the tokenizers library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import whole_text

#: The byte-level pre-tokeniser's pattern.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beyond one byte (each a whole character in UTF-8).
WIDE_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: Fragments of more bytes are not kept for reuse.
KEPT = 256

#: Texts are cut together up to this many bytes; a longer one is cut alone.
TOGETHER = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others for
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cache_entries = cache_entries
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.token = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.inside = np.zeros((256, 256), bool)
        for t, i in vocab.items():
            self.token[i] = t
            a = np.frombuffer(t, np.uint8)
            self.inside[a[:-1], a[1:]] = True
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self._merge = tiktoken.Encoding("plain", pat_str=PRETOKEN, mergeable_ranks=vocab, special_tokens={})._core_bpe.encode_ordinary
        self._find_special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._space = np.zeros(256, bool)
        self._space[[*range(9, 14), 32]] = True
        self._known = _Known(self)

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow string array (null: none)."""
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, "right")) - 1)
            out += self._together(data[int(at[i]):int(at[j])].to_pybytes() if at[j] > at[i] else b"", at[i:j + 1] - at[i])
            i = j
        return out

    def cuts(self, raw: bytes) -> np.ndarray:
        """For each place in UTF-8 text, if the byte pair around it is a certain
        cut (places 0 to len(raw); the ends are none)."""
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) < 2:
            return cut
        b = np.frombuffer(raw, np.uint8)
        middle = (b & 0xC0) == 0x80  # bytes within a character
        ends_space = self._space[b]
        if middle.any():
            for c in map(str.encode, WIDE_SPACE):
                if c in raw:
                    ends_space[[m.end() - 1 for m in re.finditer(re.escape(c), raw)]] = True
        quote = b == 0x27
        near_quote = quote[1:] | quote[:-1]
        near_quote[1:] |= quote[:-2]
        after_run = middle[:-1].copy()  # a wide space counts as a run
        after_run[1:] |= ends_space[:-2]
        open_end = near_quote | (ends_space[:-1] & after_run)
        cut[1:-1] = ~self.inside[b[:-1], b[1:]] & ~middle[1:] & (self._space[b[1:]] | ~open_end)
        return cut

    def _together(self, raw: bytes, at: np.ndarray) -> list[bytes]:
        """Ids of the texts that lie in ``raw`` between the places ``at``."""
        cut = self.cuts(raw)
        cut[at] = True
        if self._find_special and self._find_special.search(raw):
            for a, b in zip(at.tolist(), at[1:].tolist()):
                for m in self._find_special.finditer(raw, a, b):
                    cut[m.start():m.end()] = False
                    cut[[m.start(), m.end()]] = True
        places = np.flatnonzero(cut)
        known, p = self._known, places.tolist()
        ids = [known[raw[a:b]] for a, b in zip(p, p[1:])]
        of = np.searchsorted(places, at).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(of, of[1:])]

    def fragment(self, raw: bytes) -> bytes:
        """Ids of one fragment."""
        return np.array(self._merge(raw.decode()), "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``, special tokens included."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Ids of fragments; holds the special tokens and keeps the first
    ``cache_entries`` fragments, which are the common words."""

    def __init__(self, codec: Codec):
        super().__init__({s.encode(): i.to_bytes(4, "little") for s, i in codec.special.items()})
        self.codec, self.room = codec, codec.cache_entries

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.codec.fragment(fragment)
        if self.room and len(fragment) <= KEPT:
            self.room -= 1
            self[fragment] = ids
        return ids


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, once in each Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (binary, little-endian unsigned 32-bit) of
    every whole text.  A null text counts as empty and has no ids; equal and
    repeated rows each get their row; other columns are left out."""
    src = docs.select(*keep, whole_text(text).alias("__text"))
    schema = src.drop("__text").withColumn("ids", F.lit(b"")).schema

    def run(batches):
        c = codec(tokenizer)
        for rb in batches:
            ids = c.encode_all(rb.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, "ids"])

    return src.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``text`` that ``ids`` stand for (null: empty)."""
    src = encoded.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids"))
    schema = src.drop("ids").withColumn("text", F.lit("")).schema

    def run(batches):
        c = codec(tokenizer)
        for rb in batches:
            text = [c.decode(x.as_py()) for x in rb.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(text, pa.string())], names=[*keep, "text"])

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the ids and of the text
    decoded from them.  Encoding and decoding share one pass, so the ids do
    not travel between them."""
    src = docs.select("doc_id", whole_text().alias("__text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(tokenizer)
        for rb in batches:
            n, a, b = [], [], []
            for ids in c.encode_all(rb.column(1)):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, schema)
