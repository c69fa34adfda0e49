from pyspark.sql import functions as F
import random
import zlib
from collections import Counter, defaultdict

from plantops.llm import sharding


def check(rows, out, shards, slack):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots, size = defaultdict(list), Counter()
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / shards
    assert all(abs(size[s] - mean) <= slack for s in range(shards)), (mean, dict(size))


def test_equal_bytes_and_groups(docs_of):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(0, 120) + str(i)) for i in range(3000)]
    rows += [(5000 + i, "copy of one text " * 5) for i in range(40)]      # stays together
    rows += [(9000 + i, "hot " * 100) for i in range(1500)]               # too heavy for one shard
    rows += [(None, None), (None, None), (1, "")]
    out = sharding.kd_shards(docs_of(rows), shards=12).collect()
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    check(rows, out, 12, 0.08 * total / 12)
    assert len({r.shard for r in out if r.doc_id and 5000 <= r.doc_id < 5040}) == 1
    assert len({r.shard for r in out if r.doc_id and r.doc_id >= 9000}) > 1


def test_ties_and_few_rows(docs_of):
    rows = [(1, "same")] * 50
    check(rows, sharding.kd_shards(docs_of(rows), shards=3).collect(), 3, 50 * 12)
    check([(1, "a"), (2, "b")], sharding.kd_shards(docs_of([(1, "a"), (2, "b")])).collect(), 24, 9)


def test_empty_table(docs_of):
    assert sharding.kd_shards(docs_of([])).count() == 0




def test_cuts_equal_a_brute_force_kd_tree(spark):
    import random

    from plantops.llm import sharding
    rng = random.Random(12)
    rows = [(i, rng.choice([5, 20, 100, 700]), *[rng.random() * s for s in (1, 0.3, 0.8, 1)]) for i in range(300)]
    points = spark.createDataFrame(rows, "i int, w long, x_source double, x_lang double, x_size double, x_id double")
    at = {d: 2 + j for j, d in enumerate(sharding.DIMS)}
    scale = {d: max(r[at[d]] for r in rows) - min(r[at[d]] for r in rows) for d in sharding.DIMS}

    def grow(own, first, k):
        if k == 1:
            return {r[0]: first for r in own}
        d = max(sharding.DIMS, key=lambda d: (max(r[at[d]] for r in own) - min(r[at[d]] for r in own)) / scale[d])
        own = sorted(own, key=lambda r: r[at[d]])
        goal, below, cut = sum(r[1] for r in own) * (k // 2) / k, 0, 0
        for n, r in enumerate(own):
            if below + r[1] >= goal:
                cut = n + 1 if below + r[1] - goal <= goal - below else n
                break
            below += r[1]
        return grow(own[:cut], first, k // 2) | grow(own[cut:], first + k // 2, k - k // 2)

    for shards in (2, 5, 24):
        got = points.select("i", sharding._grow(points, shards, scale, 1024, 3).alias("s")).collect()
        assert {r.i: r.s for r in got} == grow(rows, 0, shards)


def test_only_groups_heavier_than_a_shard_are_split(spark):
    from plantops.llm import sharding
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.kd_shards(docs)
    shards = out.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    mean = sum(r.bytes for r in shards) / 24
    groups = out.groupBy("text_crc32", "size").agg(F.sum("size").alias("bytes"), F.countDistinct("shard").alias("n")).collect()
    assert all(r.n == 1 for r in groups if r.bytes <= mean) and len(shards) == 24
    heaviest = max(r.bytes for r in groups)
    assert all(abs(r.bytes - mean) <= heaviest for r in shards)
