"""K-d tree sharding of documents under the law of equal bytes.

Documents with equal texts are one point, so copies stay in one shard; only a
group of copies heavier than a whole shard is split into several points by its
doc_ids, as no shard could hold it.  A point lies in four metadata
dimensions (source, language, size, doc_id), scaled to 0..1 over the corpus.
A small amount that a hash of the text sets is added to each coordinate, so
that points do not tie.

The tree is grown level by level over all leaves at once.  A leaf that must
give k shards is cut along its widest dimension at the weighted quantile
(k // 2) / k of its bytes, for k a power of two the weighted median.  Quantiles
are found by histograms of bytes: each pass aggregates on the cluster and
brings at most ``bins`` numbers for each leaf to the driver, and the next pass
looks only at the bin that holds the quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantops.llm.common import materialise, number_within, whole_text

DIMS = ("source", "lang", "size", "id")
SAME = ("h", "text_crc32", "size")


def _unit(h: Column) -> Column:
    """A long as a number from 0 to 1."""
    return (F.shiftrightunsigned(h, 11).cast("double")) / float(1 << 53)


def _heavy(rows: DataFrame, total: int, shards: int, part_of_shard: float) -> DataFrame:
    """The texts whose copies weigh more than a shard, with the number of points
    (of ``part_of_shard`` of a shard each) that each is split into.  Their
    weights add up to the corpus at most, so they are fewer than ``shards``."""
    shard = max(total / shards, 1.0)
    return (rows.groupBy(*SAME).agg(F.sum("size").alias("w")).where(F.col("w") > shard)
                .select(*SAME, F.ceil(F.col("w") / max(shard * part_of_shard, 1.0)).alias("parts")))


def _quantised(c: Column) -> Column:
    """A label as one of 4096 steps; equal labels share a step."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(4096)).cast("double")


def kd_shards(docs: DataFrame, shards: int = 24, part_of_shard: float = 0.125, bins: int = 1024, passes: int = 3) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law
    ('bytes'), shard, slot (gapless from 0), grown_shard (null).

    A null text has no bytes and the CRC-32 of the empty text; null doc_id,
    source and lang count as one value each; repeated rows each get a slot
    (which of them comes first is not set); an empty table gives no row; other
    columns are left out."""
    text = whole_text()
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "sizes")

    seen = rows.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = seen["lo"] or 0, max(seen["hi"] or 0, (seen["lo"] or 0) + 1)
    heavy = materialise(_heavy(rows, seen["total"] or 0, shards, part_of_shard), "heavy-texts")
    # fewer than ``shards`` rows: a proven bound for the broadcast
    placed = rows.join(F.broadcast(heavy), [*SAME], "left").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.coalesce("parts", F.lit(1))))

    # sums and least values are taken on each task first, so copies of one text do not meet as rows
    weights = placed.groupBy(*SAME, "part").agg(F.sum("size").alias("w"), F.min("doc_id").alias("first_id"), F.min("source").alias("s"), F.min("lang").alias("l"))
    jitter = _unit(F.xxhash64(F.lit(5), *SAME, "part"))
    x = {
        "source": (_quantised(F.col("s")) + jitter) / 4096,
        "lang": (_quantised(F.col("l")) + jitter) / 4096,
        "size": F.log2(F.col("size") + jitter) / 40,
        "id": (F.coalesce(F.col("first_id") - lo, F.lit(0)).cast("double") / float(hi - lo) * (1 - 2.0 ** -20) + jitter * 2.0 ** -20),
    }
    points = materialise(weights.select(*SAME, "part", "w", *[x[d].alias(f"x_{d}") for d in DIMS]), "points")
    spread = points.agg(*[F.min(f"x_{d}").alias(f"lo_{d}") for d in DIMS], *[F.max(f"x_{d}").alias(f"hi_{d}") for d in DIMS]).first()
    scale = {d: max((spread[f"hi_{d}"] or 0) - (spread[f"lo_{d}"] or 0), 1e-12) for d in DIMS}

    leaf = _grow(points, shards, scale, bins, passes) if shards > 1 else F.lit(0)
    shard_of = points.select(*[F.col(c).alias(f"__{c}") for c in (*SAME, "part")], leaf.alias("shard"))
    on = [F.col(c) == F.col(f"__{c}") for c in (*SAME, "part")]
    sharded = placed.join(shard_of, on).select("doc_id", "size", "text_crc32", "h", "shard")
    buckets = max(1, seen["n"] // (shards * 50_000))
    numbered = number_within(sharded, "shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)), [F.col("doc_id"), F.col("h")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _grow(points: DataFrame, shards: int, scale: dict[str, float], bins: int, passes: int) -> Column:
    """The expression that gives a point's shard; at most shards - 1 cuts.
    A leaf is known by its first shard and how many it must give."""
    cuts: dict[tuple[int, int], tuple[str, float]] = {}

    def place(n: int, k: int) -> Column:
        if (n, k) not in cuts:
            return F.lit(n)
        d, c = cuts[n, k]
        return F.when(F.col(f"x_{d}") <= F.lit(c), place(n, k // 2)).otherwise(place(n + k // 2, k - k // 2))

    leaves = [(0, shards)]
    while leaves:
        here = points.withColumn("node", place(0, shards))
        seen = {r["node"]: r for r in here.groupBy("node").agg(
            F.sum("w").alias("w"), *[F.min(f"x_{d}").alias(f"lo_{d}") for d in DIMS], *[F.max(f"x_{d}").alias(f"hi_{d}") for d in DIMS]).collect()}
        dim, span, goal = {}, {}, {}
        for n, k in leaves:
            r = seen.get(n)
            dim[n] = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / scale[d]) if r else DIMS[0]
            span[n] = (r[f"lo_{dim[n]}"], r[f"hi_{dim[n]}"]) if r else (0.0, 0.0)
            goal[n] = float(r["w"]) * (k // 2) / k if r else 0.0
        below, last = dict.fromkeys(span, 0.0), dict.fromkeys(span, -1.0)  # what lies surely left, and its last place
        cut = dict(last)
        for _ in range(passes):
            seen_at = here.select("node", "w", _case(dim, lambda d: F.col(f"x_{d}")).alias("at"), _case(span, lambda s: F.lit(s[0])).alias("lo"), _case(span, lambda s: F.lit(s[1])).alias("hi"))
            step = F.floor((F.col("at") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins)
            found: dict[int, list] = {n: [] for n in span}
            inside = F.when(F.col("at").between(F.col("lo"), F.col("hi")), F.least(step, F.lit(bins - 1)))
            for r in seen_at.groupBy("node", inside.alias("bin")).agg(F.sum("w").alias("w"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect():
                if r["bin"] is not None:
                    found[r["node"]].append((r["lo"], r["hi"], float(r["w"])))
            for n in span:
                for lo, hi, w in sorted(found[n]):
                    if below[n] + w >= goal[n]:  # the next pass looks into this bin
                        cut[n] = hi if below[n] + w - goal[n] <= goal[n] - below[n] else last[n]
                        span[n] = (lo, hi)
                        break
                    below[n] += w
                    last[n] = hi
        for n, k in leaves:
            cuts[n, k] = (dim[n], cut[n])
        leaves = [(m, j) for n, k in leaves for m, j in ((n, k // 2), (n + k // 2, k - k // 2)) if j > 1]
    return place(0, shards)


def _case(values: dict[int, object], make) -> Column:
    out = F.lit(None).cast("double")
    for n, v in values.items():
        out = F.when(F.col("node") == n, make(v)).otherwise(out)
    return out
