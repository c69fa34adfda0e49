"""Merkle dataset manifest with bitmap-rank indexing.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a source stand
in the order of their doc_ids; 16 at a time become a node, until one node, the
source's subroot, remains; the subroots become the root in the same way.

The place of a leaf is not found by sorting but by rank in bitmaps:

* per source, ids are bits of blocks of 512 ids, eight words each.  Tasks set
  the bits of their rows, the blocks of all tasks are merged by OR, and blocks
  without a bit are not stored: that is the compression;
* a *popcount directory* of two levels (blocks, and super-blocks of 4096
  blocks) says how many leaves lie before each block;
* the rank of a leaf is that number and the bits set below its own.

An id that occurs more than once, or is null, sets one bit and has its further
rows in a side table, numbered by their digests; the directory counts them.

With known places the tree needs no order either: leaves are dealt by (source,
place // 4096) and written to their slots of an array, which is reduced three
levels at a time.  Proofs go down the same way: a group knows the path above
it and adds the siblings inside.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantops.llm.common import materialise, number_within
from plantops.operators.ordinal import global_ordinal

FAN = 16
LEVELS = 3                    # levels that one pass reduces
GROUP = FAN ** LEVELS         # slots of one group
WORDS, SUPER = 8, 4096        # words of 64 ids in a block, blocks in a super-block
BLOCK = 64 * WORDS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_W = [f"w{i}" for i in range(WORDS)]
_PATH = T.ArrayType(T.StructType([T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())]))


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf's SHA-256 as 32 bytes; ``text`` replaces the row's text."""
    parts = [_field(F.col(c)) for c in FIELDS[:-1]]
    return F.unhex(F.sha2(F.concat(*parts, _field(F.col("text") if text is None else text)).cast("binary"), 256))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(key, doc_id, leaf, now): ``key`` is '0' for a null source, else '1' and
    the source, so it is never null and sorts like the source with null first;
    ``now`` is the leaf with the text ``changed`` (the leaf itself if none)."""
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    leaf = leaf_digest()
    now = leaf if changed is None else F.when(F.col("text").eqNullSafe(changed), leaf).otherwise(leaf_digest(changed))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), now.alias("now"))


def _block(doc_id: Column) -> Column:
    return F.shiftright(doc_id, (BLOCK - 1).bit_length())


def _bit(doc_id: Column) -> Column:
    """Place of an id in its block, 0 to 511."""
    return F.pmod(doc_id, F.lit(BLOCK)).cast("int")


def block_bitmaps(rows: DataFrame) -> DataFrame:
    """(key, block, w0..w7, extra): the ids of each block of a source as bits,
    and how many rows there are besides one for each bit.  Null ids form block
    -2^62, below all others, without bits."""
    at = _bit(F.col("doc_id"))
    words = [F.bit_or(F.when(F.shiftright(at, 6) == i, F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63))).otherwise(F.lit(0).cast("long"))).alias(w)
             for i, w in enumerate(_W)]
    got = rows.groupBy("key", F.coalesce(_block(F.col("doc_id")), F.lit(-(1 << 62))).alias("block")).agg(*words, F.count(F.lit(1)).alias("rows"))
    words = [F.coalesce(F.col(w), F.lit(0).cast("long")).alias(w) for w in _W]
    return got.select("key", "block", *words, (F.col("rows") - _popcount()).alias("extra"))


def _popcount(below: Column | None = None) -> Column:
    """Bits set in a block's words, or those below a place."""
    total = F.lit(0).cast("long")
    for i, w in enumerate(_W):
        word = F.coalesce(F.col(w), F.lit(0).cast("long"))
        if below is not None:
            mask = F.when(below >= 64 * (i + 1), F.lit(-1).cast("long")).when(below <= 64 * i, F.lit(0).cast("long")).otherwise(
                F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (below - 64 * i).cast("int"))))
            word = word.bitwiseAND(mask)
        total = total + F.bit_count(word)
    return total


def directory(bitmaps: DataFrame) -> DataFrame:
    """``bitmaps`` with ``before`` (leaves of the source in earlier blocks) and
    ``n`` (leaves of the source).  Sums run over super-blocks, then over the at
    most 4096 blocks of one."""
    sized = bitmaps.withColumn("size", _popcount() + F.col("extra")).withColumn("super", F.shiftright("block", (SUPER - 1).bit_length()))
    tops = sized.groupBy("key", "super").agg(F.sum("size").alias("size"))
    by_key = Window.partitionBy("key")
    earlier = by_key.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("key").alias("__k"), F.col("super").alias("__s"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"),
                       F.sum("size").over(by_key).alias("n"))
    inside = Window.partitionBy("key", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (sized.withColumn("in_super", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                 .join(tops, (F.col("key") == F.col("__k")) & (F.col("super") == F.col("__s")))
                 .select("key", "block", *_W, "extra", (F.col("base") + F.col("in_super")).alias("before"), "n"))


def places(rows: DataFrame, name: str = "manifest") -> DataFrame:
    """``rows`` (key, doc_id and others, among them ``leaf``) with ``place``
    (0-based rank in the source) and ``n``.  Rows of one id are numbered by
    their leaves; equal rows among them in any order; null ids come first."""
    index = materialise(directory(block_bitmaps(rows)), f"{name}-directory")
    dk = [F.col("key").alias("__key"), F.col("block").alias("__block")]
    block = F.coalesce(_block(F.col("doc_id")), F.lit(-(1 << 62)))
    found = rows.join(index.select(*dk, *_W, "extra", "before", "n"), (F.col("key") == F.col("__key")) & (block == F.col("__block")))
    below = F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(_popcount(_bit(F.col("doc_id"))))
    found = found.withColumn("place", F.col("before") + below)
    cols = [*rows.columns, "place", "n"]
    if index.where(F.col("extra") > 0).isEmpty():
        return found.select(*cols)
    # blocks with further rows: number the rows of an id, and add those of smaller ids in the block
    plain, more = found.where(F.col("extra") == 0), materialise(found.where(F.col("extra") > 0).select(*cols, "before", "__block"), f"{name}-repeats")
    ids = more.groupBy("key", "__block", "doc_id").agg((F.count(F.lit(1)) - 1).alias("over"))  # at most 512 for each block
    smaller = Window.partitionBy("key", "__block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.select(F.col("key").alias("__k"), F.col("__block").alias("__b"), F.col("doc_id").alias("__d"), F.coalesce(F.sum("over").over(smaller), F.lit(0)).alias("shift"))
    # leaves are uniform, so buckets by their first bits are even and in order
    bucket = F.conv(F.substring(F.hex("leaf"), 1, 3), 16, 10).cast("int")
    one_id = F.concat_ws(" ", F.length("key"), F.col("key"), F.col("doc_id").cast("string"))
    more = number_within(more.withColumn("__id", one_id), "__id", bucket, [F.col("leaf")], "__at")
    more = more.join(ids, (F.col("key") == F.col("__k")) & (F.col("__block") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    more = more.withColumn("place", F.col("place") + F.col("shift") + F.col("__at"))
    return plain.select(*cols).unionByName(more.select(*cols))


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests written in hex."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def levels(slots: list[bytes], n: int) -> list[list[bytes]]:
    """The slots of a group and up to three levels above them, for a level of
    ``n`` nodes in all: reduced while more than one node remains in all."""
    out = [slots]
    while n > 1 and len(out) <= LEVELS:
        out.append([digest(out[-1][i:i + FAN]) for i in range(0, len(out[-1]), FAN)])
        n = -(-n // FAN)
    return out


def left(n: int | Column, times: int = LEVELS):
    """Nodes that remain of ``n`` after a pass."""
    for _ in range(times):
        n = F.ceil(n / FAN).cast("long") if isinstance(n, Column) else -(-n // FAN)
    return n


def _slots(t: pa.Table, value: str) -> tuple[list[bytes], list[int]]:
    """The group's slot array, each value written to its own slot, and the slot of each row."""
    at = [p % GROUP for p in t["place"].to_pylist()]
    slots: list[bytes] = [b""] * len(at)
    for i, v in zip(at, t[value].to_pylist()):
        slots[i] = v
    return slots, at


def _reduce(nodes: DataFrame, value: str) -> DataFrame:
    """One pass: (key, place, node, n) of the level three higher."""
    def run(t: pa.Table) -> pa.Table:
        slots, _ = _slots(t, value)
        n = t["n"][0].as_py()
        top = levels(slots, n)[-1]
        return pa.table({"key": t["key"][:1], "place": pa.array([t["place"][0].as_py() // GROUP], pa.int64()), "node": pa.array(top, pa.binary()),
                         "n": pa.array([left(n)], pa.int64())})

    small = nodes.select("key", "place", F.col(value), "n", F.shiftright("place", (GROUP - 1).bit_length()).alias("g"))
    return small.groupBy("key", "g").applyInArrow(run, "key string, place bigint, node binary, n bigint")


def _grow(nodes: DataFrame, value: str, name: str) -> list[DataFrame]:
    """All passes above ``nodes``, each written; the last has a node for each key."""
    passes = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not passes:
        nodes = materialise(_reduce(nodes, value), f"manifest-{name}-{len(passes)}")
        value, most = "node", left(most)
        passes.append(nodes)
    return passes


@dataclass
class Manifest:
    """``leaves``: (key, doc_id, leaf, now, place, n); ``subtrees`` and ``top``:
    the passes above the leaves and above the ``subroots`` (key 'top')."""
    leaves: DataFrame
    subtrees: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]

    @property
    def root(self) -> str | None:
        row = self.top[-1].first()
        return row["node"].hex() if row else None


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of all rows of ``docs``.  ``changed`` is an expression for
    a text that may have been tampered with (leaf ``now``)."""
    placed = materialise(places(materialise(leaves(docs, changed), "manifest-leaves")), "manifest-places")
    subtrees = _grow(placed, "leaf", "sources")
    ordered = global_ordinal(subtrees[-1].select("key", "node"), [F.col("key")], "place")
    sources = subtrees[-1].count()
    subroots = materialise(ordered.select(F.lit("top").alias("key"), F.col("key").alias("source_key"), (F.col("place") - 1).alias("place"), "node",
                                          F.lit(sources).cast("long").alias("n")), "manifest-subroots")
    return Manifest(placed, subtrees, subroots, _grow(subroots, "node", "top"))


def _paths(nodes: DataFrame, value: str, upper: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``nodes`` with ``path``, the siblings before and
    after a node at every level up to the root: those inside its group and then
    the ``path`` that ``upper`` has for the group; ``ends`` (other columns of
    ``upper``) are handed down."""
    ends = [c for c in upper.columns if c not in ("key", "place", "path")]
    types = T.StructType([*[nodes.schema[c] for c in keep], *[upper.schema[c] for c in ends], T.StructField("path", _PATH)])

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([*[t[c] for c in keep], *[up[c][:0] for c in ends], pa.array([], _ARROW_PATH)], names=[*keep, *ends, "path"])
        slots, at = _slots(t, value)
        tree = levels(slots, t["n"][0].as_py())
        above = up["path"][0].as_py()
        # the siblings of every node, once for each node of each level
        around = []
        for level in tree[:-1]:
            row = []
            for i in range(len(level)):
                lo = i - i % FAN
                row.append({"before": b"".join(level[lo:i]), "after": b"".join(level[i + 1:lo + FAN])})
            around.append(row)
        paths = []
        for i in at:
            path = []
            for row in around:
                path.append(row[i])
                i //= FAN
            paths.append(path + above)
        out = t.select(keep)
        for c in ends:
            out = out.append_column(c, pa.chunked_array([pa.repeat(up[c][0], t.num_rows)]))
        return out.append_column("path", pa.array(paths, _ARROW_PATH))

    small = nodes.select(*dict.fromkeys([*keep, "key", "place", value, "n"]), F.shiftright("place", (GROUP - 1).bit_length()).alias("__g"))
    return small.groupBy("key", "__g").cogroup(upper.groupBy("key", "place")).applyInArrow(run, types)


_ARROW_PATH = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


def proofs(m: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, now, subroot, root (32 bytes each) and ``path``,
    the siblings before and after at every level from the leaf to the root."""
    last = m.top[-1]
    paths = last.select("key", "place", F.col("node").alias("root"), F.array().cast(_PATH).alias("path"))
    for lower in reversed(m.top[:-1]):
        paths = _paths(lower, "node", paths, ["key", "place"])
    # down to the subroots, whose passes of their own begin at place 0 of their key
    paths = _paths(m.subroots, "node", paths, ["source_key", "node"])
    paths = paths.select(F.col("source_key").alias("key"), F.lit(0).cast("long").alias("place"), F.col("node").alias("subroot"), "root", "path")
    for lower in reversed(m.subtrees[:-1]):
        paths = _paths(lower, "node", paths, ["key", "place"])
    return _paths(m.leaves, "leaf", paths, ["doc_id", "leaf", "now"])


def _hex(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def verify(proven: DataFrame) -> DataFrame:
    """Digests of :func:`proofs`, the root folded from ``now`` and whether it
    is the manifest's."""
    joined = F.aggregate("path", F.lit(""), lambda a, p: F.concat(a, _hex(p["before"]), _hex(p["after"])))
    folded = F.aggregate("path", _hex("now"), lambda a, p: F.sha2(F.concat(_hex(p["before"]), a, _hex(p["after"])).cast("binary"), 256))
    return proven.select("doc_id", _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"),
                         F.sha2(joined.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def lower_some(fifth: int = 5) -> Column:
    """The text with A-Z lower-cased where ``fifth`` divides the CRC-32 of the
    decimal doc_id; elsewhere, and for a null text or id, as it is."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fifth == 0, F.lit(False))
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def oracle_sql(levels: int = 5) -> str:
    """DuckDB SQL for ``verify(proofs(build(documents, lower_some())))``, for
    sources of up to 16^levels rows and as many sources."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def tree(name: str, key: str) -> str:
        """Levels of the tree above ``name``0 (key, idx, h, n) and the siblings of each node."""
        out = []
        for k in range(levels):
            out.append(f"{name}g{k} AS (SELECT {key} AS key, idx // {FAN} AS g, n, list(h ORDER BY idx) AS l FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT key, g AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h, "
                       f"CASE WHEN n > 1 THEN (n + {FAN - 1}) // {FAN} ELSE 1 END AS n FROM {name}g{k})")
            out.append(f"{name}s{k} AS (SELECT t.key, t.idx, t.n, array_to_string(g.l[1:t.idx % {FAN}], '') AS a, array_to_string(g.l[t.idx % {FAN} + 2:], '') AS z "
                       f"FROM {name}{k} t JOIN {name}g{k} g ON g.key IS NOT DISTINCT FROM t.key AND g.g = t.idx // {FAN})")
        return ",\n".join(out)

    def climb(name: str, start: str, at: str, key: str) -> str:
        """``f`` folded and ``p`` (the siblings) carried through a tree."""
        out, last = [], start
        for k in range(levels):
            out.append(f"{name}c{k} AS (SELECT c.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.a || c.f || s.z) ELSE c.f END AS f, "
                       f"CASE WHEN s.n > 1 THEN c.p || s.a || s.z ELSE c.p END AS p) FROM {last} c JOIN {name}s{k} s "
                       f"ON s.key IS NOT DISTINCT FROM {key} AND s.idx = {at} // {FAN ** k})")
            last = f"{name}c{k}"
        return ",\n".join(out)

    fields = " || ".join(field(c) for c in FIELDS[:-1])
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce([xor(u, v), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    crc = (f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), "
           f"lambda u, v: {byte}), 4294967295::UBIGINT)")
    return f"""
WITH e AS (SELECT doc_id, source AS key, {fields} AS head, text,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents),
d AS (SELECT doc_id, key, sha256(head || {field("text")}) AS leaf, sha256(head || {field("changed")}) AS now FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t0 AS (SELECT key, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM i),
{tree("t", "key")},
r AS (SELECT key, h, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS pos FROM t{levels}),
u0 AS (SELECT 0 AS key, pos AS idx, h, count(*) OVER () AS n FROM r),
{tree("u", "key")},
c AS (SELECT i.*, r.h AS subroot, r.pos AS top, now AS f, '' AS p FROM i JOIN r ON r.key IS NOT DISTINCT FROM i.key),
{climb("t", "c", "c.pos", "c.key")},
{climb("u", f"tc{levels - 1}", "c.top", "0")}
SELECT doc_id, leaf, subroot, u.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u.h AS verified FROM uc{levels - 1}, u{levels} u"""
