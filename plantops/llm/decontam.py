"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are stretches of letters a-z, digits and non-ASCII characters after A-Z
is lower-cased.  A text becomes its words with one space before, between and
behind them, so that a window of words is a byte pattern that begins and ends
with a space and occurs only at whole words.

The patterns of one class share tables.  A class is made of the windows of
full length, or of the shorter items of like size, as the shortest pattern of
a class (``m`` bytes) sets how far a search may jump:

* the *shift table* tells for a block of bytes how far the window can move
  before that block could end a pattern's first ``m`` bytes; most positions
  are never looked at;
* where the shift is 0, the *suffix bucket* of the window (keyed by the last
  and the first bytes of its ``m``) names the patterns that may stand there;
* each of those is compared byte by byte.

A task runs thousands of such searches side by side, one for each stretch of
the text, as array operations.  The benchmark is the stated query set: it is
dealt into blocks of bounded size, and all documents pass each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantops.llm.common import materialise, whole_text, with_fields

WINDOW = 10
STRETCH = 512         # bytes that one of the side-by-side searches goes through
CHUNK = 4 << 20        # bytes of text searched at once
PAD = 8                # bytes behind the text, so that eight can be read anywhere
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Letters to lower case, digits and bytes of non-ASCII characters kept, all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """All windows of ``size`` words; a shorter item is one window, an item without words none."""
    if not words:
        return []
    return [words[i:i + size] for i in range(max(1, len(words) - size + 1))]


def _eights(text: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number; ``text`` is padded."""
    return np.ndarray((len(text) - PAD + 1,), np.dtype("<u8"), text, strides=(1,))


class WuManber:
    """Shift table and suffix buckets of one class of patterns.  ``numbers``
    are the patterns' numbers in the whole set."""

    def __init__(self, patterns: list[bytes], numbers: list[int], alphabet: int = 20):
        self.m = m = min(map(len, patterns))
        r = len(patterns)
        # Wu and Manber's rule: about log(2 m r) to the base of the alphabet
        self.block = min(m, 8, max(2, math.ceil(math.log(2 * m * r, alphabet))))
        self.bits = min(24, max(12, math.ceil(math.log2(4 * m * r))))
        heads = b"".join(p[:m] for p in patterns) + bytes(PAD)
        eights, starts = _eights(heads), np.arange(r, dtype=np.int64) * m
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint16 if m < 60_000 else np.int64)
        for end in range(self.block, m + 1):  # later blocks allow smaller shifts, so they stay
            self.shift[self._slot(eights, starts + end - self.block)] = m - end
        key = self._key(eights, starts)
        order = np.argsort(key, kind="stable")
        self.keys, self.at = key[order], np.asarray(numbers, np.int64)[order]

    def _mask(self, size: int) -> np.uint64:
        return np.uint64((1 << 8 * size) - 1)

    def _slot(self, eights: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((eights[at] & self._mask(self.block)) * _MIX) >> np.uint64(64 - self.bits)

    def _key(self, eights: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = min(8, self.m)
        head, tail = eights[at] & self._mask(size), eights[at + self.m - size] & self._mask(size)
        return (tail * _MIX) ^ (head * np.uint64(0xC2B2AE3D27D4EB4F))

    def candidates(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pattern numbers) that the tables leave to be compared."""
        eights, stop = _eights(text), len(text) - PAD - self.m + 1
        at = np.arange(0, max(stop, 0), STRETCH, dtype=np.int64)
        end, zeros = np.minimum(at + STRETCH, stop), []
        while len(at):
            step = self.shift[self._slot(eights, at + (self.m - self.block))].astype(np.int64)
            zero = step == 0
            if zero.any():
                zeros.append(at[zero])
            at = at + np.maximum(step, 1)
            on = at < end
            if not on.all():
                at, end = at[on], end[on]
        if not zeros:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos = np.concatenate(zeros)
        key = self._key(eights, pos)
        lo = np.searchsorted(self.keys, key)
        known = self.keys[np.minimum(lo, len(self.keys) - 1)] == key
        pos, lo = pos[known], lo[known]
        count = np.searchsorted(self.keys, key[known], "right") - lo
        pick = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(pos, count), self.at[pick]


class Matcher:
    """All windows of a block of benchmark items: (item id, text) rows."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        width: dict[bytes, int] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                pattern = b" " + b" ".join(window) + b" "
                owners.setdefault(pattern, set()).add(item)
                width[pattern] = len(window)
        self.patterns = list(owners)
        self.owners = [sorted(s) for s in owners.values()]
        self.width = np.array([width[p] for p in self.patterns], np.int64)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(self.patterns):
            classes.setdefault(0 if width[p] == size else len(p).bit_length(), []).append(i)
        self.tables = [WuManber([self.patterns[i] for i in c], c) for _, c in sorted(classes.items())]

    def search(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pattern numbers) of all occurrences in a padded text."""
        found = []
        for t in self.tables:
            pos, num = t.candidates(text)
            same = [text.startswith(self.patterns[j], p) for p, j in zip(pos.tolist(), num.tolist())]
            found.append((pos[np.array(same, bool)], num[np.array(same, bool)]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def documents(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, the stretches of words hit
        (first word, number of words) and the items found, sorted."""
        counts, pieces, out, held = [], [], [], 0
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            pieces.append(b" " + b" ".join(w) + b" \n")
            held += len(pieces[-1])
            if held >= CHUNK:
                out += self._chunk(counts, pieces)
                counts, pieces, held = [], [], 0
        return out + self._chunk(counts, pieces) if counts else out

    def _chunk(self, counts: list[int], pieces: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts]
        text = b"".join(pieces) + bytes(PAD)
        pos, num = self.search(text)
        if not len(pos):
            return out
        # the space before each word, and one behind the last (a text without words has two)
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        own = np.array([n + 1 if n else 2 for n in counts], np.int64)
        first = np.cumsum(own) - own
        word = np.searchsorted(spaces, pos)
        edge = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + self.width[num], -1)
        turn = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        doc = np.searchsorted(first, begin, "right") - 1
        for d, b, e in zip(doc.tolist(), (begin - first[doc]).tolist(), (end - first[doc]).tolist()):
            out[d][1].append((b, e - b))
        doc = np.searchsorted(first, word, "right") - 1
        pairs = np.unique(doc * len(self.patterns) + num)
        named: dict[int, set[str]] = {}
        for d, j in zip((pairs // len(self.patterns)).tolist(), (pairs % len(self.patterns)).tolist()):
            named.setdefault(d, set()).update(self.owners[j])
        for d, items in named.items():
            out[d][2].extend(sorted(items))
        return out


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of (first word, number of words); adjoining stretches become one."""
    out: list[tuple[int, int]] = []
    for first, n in sorted([*a, *b]):
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(sum(out[-1]), first + n) - out[-1][0])
        else:
            out.append((first, n))
    return out


HITS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
                   block_bytes: int = 32 << 20) -> DataFrame:
    """``keep`` columns, ``n_words``, ``hits`` (stretches of words that lie in
    occurrences of the benchmark's windows: first word from 0, number of words)
    and ``items`` (ids of the items with occurring windows, as sorted strings).

    A null text has no words, on either side; an item without words is never
    found; rows that share an item id are one item; a null item id is the
    empty string.  Each row of ``docs`` gives a row, repeated ones too; an
    empty benchmark hits nothing; other columns are left out.  The benchmark
    is searched in blocks of about ``block_bytes`` of text (bounded on driver
    and tasks); from the second block on, documents are written between."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("body")).distinct()
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(*keep, whole_text().alias("__text"))
    carried, at = with_fields(out.schema, ("n_words", T.LongType()), ("hits", HITS), ("items", ITEMS)), len(keep)
    bare = T.StructType([*carried.fields[:at], *carried.fields[at + 1:]])
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()  # about block_bytes
        matcher = spark.sparkContext.broadcast(Matcher([(r["item"], r["body"].encode()) for r in rows], window))
        last = b == blocks - 1
        out = out.mapInArrow(_searcher(matcher, at, first=b == 0, last=last), bare if last else carried)
        if not last:
            out = materialise(out, "decontam")
    return out


def _searcher(matcher, at: int, first: bool, last: bool):
    def run(batches):
        for rb in batches:
            texts = rb.column(at).cast(pa.binary()).to_pylist()
            found = matcher.value.documents(texts)
            if not first:
                old = zip(rb.column(at + 2).to_pylist(), rb.column(at + 3).to_pylist())
                found = [(n, _merged([(h["first"], h["words"]) for h in hits], own), sorted({*names, *items}))
                         for (n, own, items), (hits, names) in zip(found, old)]
            hits = [[{"first": f, "words": n} for f, n in x[1]] for x in found]
            cols = [pa.array([x[0] for x in found], pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
                    pa.array([x[2] for x in found], pa.list_(pa.string()))]
            kept = rb.columns[:at] if last else rb.columns[:at + 1]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*rb.schema.names[:len(kept)], "n_words", "hits", "items"])
    return run


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items for each row of :func:`find_benchmark`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def oracle_sql() -> str:
    """DuckDB SQL for ``report(find_benchmark(documents, benchmark))``."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS s
      FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
v AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
      FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, k WHERE len(w) >= k)),
f AS (SELECT v.r, v.i, v.k, p.item FROM v JOIN p ON v.k = p.k AND v.s = p.s),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS pos FROM f) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN m ON m.r = d.r"""
