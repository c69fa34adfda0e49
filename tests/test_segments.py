import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantops.operators.ordinal import numbered, ordinal
from plantops.operators.segments import group_marks


def brute(rows):
    out, groups = [], {}
    for k, i, q in rows:
        groups.setdefault(k, []).append((i, q))
    for k, lines in groups.items():
        total = Decimal(0)
        for n, (i, q) in enumerate(sorted(lines)):
            total += q or 0
            out.append((k, i, n == 0, n == len(lines) - 1, total))
    return sorted(out, key=repr)


def lines(rng, sizes):
    rows = []
    for k, n in sizes.items():
        places = rng.sample(range(n * 3), n)
        rows += [(k, i, rng.choice([None, Decimal("0.000000001"), Decimal(-7), Decimal(rng.randrange(10 ** 14)) / 1000])) for i in places]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("clustered", [False, True])
def test_marks_and_sums_with_a_hot_group(spark, clustered):
    rng = random.Random(4)
    rows = lines(rng, {"hot": 3000, **{f"k{i}": rng.randrange(1, 9) for i in range(300)}, None: 5, "": 1})
    df = spark.createDataFrame(rows, "parent string, idx long, qty decimal(21,9)").repartition(7)
    got = group_marks(df, ["parent"], ["idx"], F.col("qty"), clustered=clustered, partitions=11)
    assert got.columns == ["parent", "idx", "qty", "is_first", "is_last", "running"]
    assert sorted(((r.parent, r.idx, r.is_first, r.is_last, r.running) for r in got.collect()), key=repr) == brute(rows)


def test_group_over_all_partitions_and_small_batches(spark):
    rows = [("only", i, Decimal(i)) for i in range(2000)] + [("x", 0, Decimal(1))]
    df = spark.createDataFrame(rows, "parent string, idx long, qty decimal(21,9)").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = group_marks(df, ["parent"], ["idx"], F.col("qty"), partitions=9).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(((r.parent, r.idx, r.is_first, r.is_last, r.running) for r in got), key=repr) == brute(rows)
    assert group_marks(df.where("false"), ["parent"], ["idx"], F.col("qty")).count() == 0


def test_numbered_gives_the_same_below_and_above_the_limit(spark):
    rng = random.Random(5)
    rows = [(k, i, q) for k, i, q in lines(rng, {"hot": 500, "a": 3, None: 4})]
    df = spark.createDataFrame(rows, "parent string, idx long, qty decimal(21,9)")
    window = sorted(map(repr, numbered(df, ["parent"], ["idx"], "n").collect()))
    split = sorted(map(repr, numbered(df, ["parent"], ["idx"], "n", hot_rows=10).collect()))
    assert window == split == sorted(map(repr, ordinal(df, ["parent"], ["idx"], "n").collect()))
