from pyspark.sql import Window
from pyspark.sql import functions as F

from plantops.operators.ordinal import global_ordinal, ordinal


def _check(df, keys, order, parts):
    got = ordinal(df, keys, order, "idx", partitions=parts)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    want = df.withColumn("idx", F.row_number().over(w).cast("long"))
    assert got.count() == df.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_spans_partitions(spark):
    # one key holds most rows: it is split over many range partitions
    rows = [(0 if i % 10 else i, i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v double")
    _check(df, ["k"], ["o"], 13)


def test_string_and_null_keys(spark):
    rows = [(None if i % 11 == 0 else f"k{i % 3}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long")
    _check(df, ["k"], ["o"], 7)


def test_composite_keys(spark):
    rows = [(i % 2, i % 3, i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b int, o long")
    _check(df, ["a", "b"], ["o"], 5)


def test_global_dense_numbering(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "o long")
    got = global_ordinal(df, ["o"], "seq", partitions=9)
    assert sorted(r.seq for r in got.collect()) == list(range(1, 1001))
    assert got.where(F.col("seq") != F.col("o") + 1).count() == 0


def test_more_partitions_than_rows(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k long, o long")
    _check(df, ["k"], ["o"], 16)


def test_numbering_does_not_rest_on_exchange_reuse(spark):
    hot = spark.range(4000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 11)) AS k", "id AS o")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ordinal(hot, ["k"], ["o"], "n", partitions=13)
        want = got.selectExpr("k", "o", "n", "row_number() OVER (PARTITION BY k ORDER BY o) AS w")
        assert want.where("n <> w").count() == 0 and got.count() == 4000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
