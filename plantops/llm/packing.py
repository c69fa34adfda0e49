"""Packing documents into sequences of a fixed number of tokens.

1. Each text is encoded and its ids, with the closing id, are cut into pieces
   of at most ``max_len`` (full pieces and one rest).
2. Pieces are dealt to randomised groups by a hash.  The number of groups
   follows the bytes of the corpus, so a group is about ``group_bytes`` of
   text whatever the input, and no document, source or group of copies can
   make one group large.
3. Each group is packed by first-fit decreasing.  A tournament tree over the
   bins holds the largest room of each subtree, so the first bin with room
   for a piece is found in log(bins) steps.
4. Bins that first-fit leaves with a gap of ``min_cut`` tokens or more are
   topped up: the emptiest bins are taken apart and their pieces cut into the
   gaps, so that a group ends with about one bin that is not full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.llm.bpe import codec
from plantops.llm.common import whole_text


class BinTree:
    """Tournament tree: each node holds the largest room among its bins."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < bins:
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """Put ``need`` into the first bin with room for it; that bin."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        found = i - self.size
        room[i] -= need
        i >>= 1
        while i:
            room[i] = max(room[2 * i], room[2 * i + 1])
            i >>= 1
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; ``lengths`` must be sorted, longest first."""
    tree, bins = BinTree(len(lengths), capacity), []
    for i, n in enumerate(lengths):
        b = tree.first_fit(n)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(lengths: list[int], capacity: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start in the item, length).  ``lengths``: longest first."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (used[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        giver, taker = order[lo], order[hi]
        gap = capacity - used[taker]
        if gap < min_cut:
            hi -= 1
        elif not bins[giver]:
            lo += 1
        else:
            i, start, n = bins[giver].pop()
            take = min(gap, n)
            bins[taker].append((i, start, take))
            if take < n:
                bins[giver].append((i, start + take, n - take))
            used[taker] += take
            used[giver] -= take
    return [b for b in bins if b]


def cut_documents(docs: DataFrame, tokenizer: str, max_len: int, end_id: int) -> DataFrame:
    """Pieces (doc_id, start, doc_tokens, ids) of at most ``max_len`` tokens."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("__text"))
    end, step = end_id.to_bytes(4, "little"), 4 * max_len

    def run(batches):
        c = codec(tokenizer)
        for rb in batches:
            doc, start, total, ids = [], [], [], []
            for d, raw in zip(rb.column(0).to_pylist(), c.encode_all(rb.column(1))):
                raw += end
                for at in range(0, len(raw), step):
                    doc.append(d)
                    start.append(at // 4)
                    total.append(len(raw) // 4)
                    ids.append(raw[at:at + step])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "start", "doc_tokens", "ids"])

    return src.mapInArrow(run, "doc_id bigint, start bigint, doc_tokens bigint, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, group_bytes: int = 8 << 20, min_cut: int = 32, seed: int = 20) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-
    endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty (its one id is ``end_id``); a null doc_id is
    kept as null; repeated rows are packed as often as they come; an empty
    table gives no piece; other columns are left out.  ``sequence_id`` holds
    the group in its upper half, so groups need no common counter."""
    size = docs.agg(F.sum(F.octet_length(whole_text()) + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    pieces = cut_documents(docs, tokenizer, max_len, end_id).withColumn(
        "g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.crc32("ids"), F.rand(seed)), F.lit(groups)))
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def pack(t: pa.Table) -> pa.Table:
        t = t.append_column("n", pa.array([len(x.as_py()) // 4 for x in t["ids"]], pa.int64()))
        t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        group = t["g"][0].as_py()
        doc, first, total, ids = t["doc_id"].to_pylist(), t["start"].to_pylist(), t["doc_tokens"].to_pylist(), t["ids"]
        rows = []
        for b, parts in enumerate(pack_group(t["n"].to_pylist(), max_len, min_cut)):
            offset = 0
            for i, s, n in parts:
                rows.append((doc[i], first[i] + s, n, ids[i].as_py()[4 * s:4 * (s + n)], total[i], (group << 32) + b, offset))
                offset += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return pieces.groupBy("g").applyInArrow(pack, schema)
