"""SimHash near-dedup by anchor-point covering.

**Fingerprints.**  64 bits over the 3-word shingles of the lower-cased text.

**Links.**  Two fingerprints link when at most ``max_bits`` bits differ.  The
64 bits are read as two halves of 32; of two linked fingerprints at least one
half differs in at most ``max_bits // 2`` bits (3 bits: 1).  On a half, the
anchors are the words of a perfect covering code: the [31, 26] Hamming code
with one bit more, which covers every half with radius R = 1.  With
t = ``max_bits // 2``, the half f of one fingerprint lies within R of its
nearest anchor (its home), so a half g within t of f lies within R + t of that
anchor.  Each fingerprint is therefore replicated to every anchor within R + t
(17 of 2**27 on average for R + t = 2), and at each anchor the fingerprints at
home are compared, on all 64 bits, with all that were replicated there.  No
link can be missed.

**Groups of copies.**  Equal fingerprints are one row before any of this.  An
anchor that is home to many fingerprints is split again by the four bytes of
the *other* half, of which one must be equal when that half differs in at
most 3 bits; its rows go to cells (anchor, byte number, byte value), which
land in different tasks.  A cell does not emit its linked pairs: it emits
links that join the same fingerprints (at most one for each row), so output
stays linear in the replicas however dense a group is.

**Components** come from alternating large-star and small-star steps on the
emitted links, each step written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import fresh, materialise, whole_text

SHINGLE, MAX_BITS, SEED = 3, 3, 42


# ---- fingerprints -------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set when it is set in over half of the shingles' XXH64."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), seed)
    hashes = np.fromiter((h(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # one long text must not unpack as a whole
        ones += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a long.  Null text: empty."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("__text"))

    def run(batches):
        for rb in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in rb.column(1)), np.uint64, rb.num_rows)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id bigint, fp bigint")


# ---- anchors ------------------------------------------------------------

def _syndrome(half: np.ndarray) -> np.ndarray:
    """Hamming syndrome of bits 0 to 30 (bit i stands for position i + 1);
    zero for code words, else the position whose flip gives a code word."""
    s = np.zeros(half.shape, np.uint32)
    for i in range(31):
        s ^= np.where((half >> np.uint32(i)) & np.uint32(1), np.uint32(i + 1), np.uint32(0))
    return s


def home(half: np.ndarray) -> np.ndarray:
    """The nearest anchor: the code word within one flip of bits 0 to 30."""
    s = _syndrome(half)
    return half ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)


def offsets(radius: int) -> list[int]:
    """Every mask over 32 bits of at most ``radius`` ones."""
    from itertools import combinations
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(32), r)]


def anchors_within(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every code word within ``radius`` of each half.  A
    mask leads to a code word when its syndrome equals the half's."""
    masks = np.array(offsets(radius), np.uint32)
    by_syndrome: list[np.ndarray] = [masks[_syndrome(masks) == s] for s in range(32)]
    of = _syndrome(half)
    rows, out = [], []
    for s in range(32):
        at = np.flatnonzero(of == s)
        if len(at):
            m = by_syndrome[s]
            rows.append(np.repeat(at, len(m)))
            out.append((half[at][:, None] ^ m[None, :]).ravel())
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.empty(0, np.int64), np.empty(0, np.uint32))


def _replicate(max_bits: int):
    near = max_bits // 2

    def run(batches):
        for rb in batches:
            fp = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(2):
                half = ((fp >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows, anchor = anchors_within(half, 1 + near)
                at_home = home(half)[rows] == anchor
                key = (np.int64(part) << 32) | anchor.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows].view(np.int64)), pa.array(at_home)], names=["anchor", "fp", "at_home"])
    return run


def _links(max_bits: int):
    """Of rows sorted by cell: links that join what is linked in each cell."""
    def cell(fp: np.ndarray, at_home: np.ndarray) -> list[tuple[int, int]]:
        a, out = np.unique(fp[at_home]), []
        b = np.unique(fp)
        if len(b) < 2 or not len(a):
            return out
        root = np.arange(len(b))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        block = max(1, (1 << 20) // len(b))
        for lo in range(0, len(a), block):
            far = np.bitwise_count(a[lo:lo + block, None] ^ b[None, :])
            for i, j in zip(*np.nonzero(far <= max_bits)):
                x, y = find(int(np.searchsorted(b, a[lo + i]))), find(int(j))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(a[lo + i]), int(b[j])))
        return out

    def run(batches):
        cells: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        homes: list[np.ndarray] = []

        def flush(keep_last: bool):
            k, f, h = np.concatenate(cells), np.concatenate(fps), np.concatenate(homes)
            cut = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            size, with_home = (ends - starts)[:len(starts) - keep_last], np.add.reduceat(h.astype(np.int64), starts)[:len(starts) - keep_last] > 0
            two = starts[np.flatnonzero((size == 2) & with_home)]  # most cells: all at once
            two = two[(np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits) & (f[two] != f[two + 1])]
            found = list(zip(f[two].tolist(), f[two + 1].tolist()))
            for i in np.flatnonzero((size > 2) & with_home):
                s = slice(starts[i], ends[i])
                found += cell(f[s], h[s])
            rest = slice(starts[-1], None) if keep_last else slice(len(k), None)
            cells[:], fps[:], homes[:] = [k[rest]], [f[rest]], [h[rest]]
            x = np.array(found, np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64)), pa.array(x[:, 1].view(np.int64))], names=["a", "b"])

        for rb in batches:
            if rb.num_rows:
                cells.append(np.stack([rb.column(0).to_numpy(), rb.column(1).to_numpy()], axis=1))
                fps.append(rb.column(2).to_numpy().view(np.uint64))
                homes.append(rb.column(3).to_numpy(zero_copy_only=False))
                yield flush(True)
        if cells:
            yield flush(False)
    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, crowded: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to join all
    that are linked.  ``distinct``: one column ``fp``.  ``crowded``: homes at
    an anchor from which on its rows are split by the other half's bytes."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the covering is built for 0 to 3 differing bits")
    rows = distinct.select("fp").mapInArrow(_replicate(max_bits), "anchor bigint, fp bigint, at_home boolean")
    crowds = (rows.where("at_home").groupBy("anchor").count().where(F.col("count") > crowded)
                  .select("anchor", F.lit(True).alias("crowded")))
    other = F.when(F.col("anchor") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    bytes_of = F.array(*[F.lit(1 + 256 * i) + F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)])
    cells = (rows.join(crowds, "anchor", "left")
                 .select("anchor", F.explode(F.when(F.col("crowded"), bytes_of).otherwise(F.array(F.lit(0).cast("long")))).alias("cell"), "fp", "at_home")
                 .repartition("anchor", "cell").sortWithinPartitions("anchor", "cell"))
    return cells.mapInArrow(_links(max_bits), "a bigint, b bigint")


# ---- components ---------------------------------------------------------

def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b)
    reaches.  Each step is an aggregation with a partial minimum on each task,
    whose result is written, and a join with it on the node: a join of two
    shuffles, which AQE splits where a node has many neighbours."""
    def canonical(df):
        return (df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def star(pairs, smaller_only):
        both = pairs if smaller_only else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        joined = both.join(least, "a")
        if smaller_only:   # what a node links below it, and itself, goes to the least of them
            return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(canonical(edges), label)
    seen = mark(now)
    while True:
        now = materialise(canonical(star(canonical(star(now, False)), True)), label)
        last, seen = seen, mark(now)
        if last == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


# ---- the operator -------------------------------------------------------

def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts, and texts of white space, have the fingerprint zero
    and link like any other.  Rows with a null doc_id keep their row and link,
    but do not name a component; if a component has no other rows its id is
    null.  Repeated rows come back as often; an empty table gives no row;
    other columns are left out."""
    return _grouped(docs, shingle, max_bits, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row: root is the least
    fingerprint of the component and stands for it alone, which component_id
    does not where a doc_id repeats."""
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, max_bits))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(member.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = member.select("fp", "root").join(named, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return fps.join(of, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "root", "component_id")


def keep_representatives(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, unchanged: one whose doc_id names the
    component and whose text lies in it.  Where a doc_id repeats with texts of
    several components that it names, each keeps one; of its rows in one
    component the least (by its other columns as JSON) stays.  Rows without a doc_id
    all stay, as nothing names one of them."""
    groups = materialise(_grouped(docs, **settings).where("doc_id is not null"), "groups")
    id_, n, of, root, fp, row = fresh(docs.columns, "__id", "__n", "__of", "__root", "__fp", "__row")
    count = groups.groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(n),
                                                           F.max(F.col("doc_id") == F.col("component_id")).alias(row)).where(F.col(row)).drop(row)
    same = F.col("doc_id") == F.col(id_)
    single = docs.join(count.where(F.col(n) == 1), same, "left_semi")
    # only of rows whose doc_id repeats the text has to tell the component
    twice = docs.join(count.where(F.col(n) > 1), same, "left_semi")
    named = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_), F.col("fp").alias(of), F.col("root").alias(root)).distinct()
    placed = _with_fingerprint(twice, settings.get("shingle", SHINGLE), settings.get("seed", SEED), fp).join(named, same & (F.col(fp) == F.col(of)))
    others = F.struct(*[F.col(c) for c in docs.columns if c != "doc_id"])
    # rows are compared as JSON text, which has an order for columns of every type
    least = placed.groupBy("doc_id", root).agg(F.min_by(others, F.to_json(others)).alias(row))
    return (single.unionByName(least.select("doc_id", f"{row}.*").select(*docs.columns))
                  .unionByName(docs.where("doc_id is null")))


def _with_fingerprint(docs: DataFrame, shingle: int, seed: int, name: str) -> DataFrame:
    """``docs`` with its fingerprints as column ``name``."""
    schema, at = docs.withColumn(name, F.lit(0).cast("long")).schema, docs.columns.index("text")

    def run(batches):
        for rb in batches:
            fp = np.fromiter((fingerprint(x.as_py() or "", shingle, seed) for x in rb.column(at)), np.uint64, rb.num_rows)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(fp.view(np.int64))], names=[*rb.schema.names, name])

    return docs.mapInArrow(run, schema)
