"""What operators stage is removed by its owner: scoped run folders, dropped stores."""

import os

import pytest
from pyspark.sql import functions as F

from plantops.operators.ordinal import global_ordinal, ordinal
from plantops.operators.writeback import write_version
from plantops.session import checkpoint_dir, run_folder, staging
from plantops.sources.store import TableStore


def kept(spark):
    """The library's folders in the shared folder."""
    return {f for f in os.listdir(checkpoint_dir(spark)) if f.startswith("plantops-")}


def test_a_run_leaves_nothing(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    before = kept(spark)
    with run_folder(spark) as folder:
        ordinal(rows, ["k"], ["o"]).write.parquet(str(tmp_path / "numbered"))
        assert global_ordinal(rows, ["o"]).count() == 500
        old = rows.select("o", "k")
        got = write_version(old, old.withColumn("k", F.col("k") + 1), str(tmp_path / "table"), "o", parts=3)
        labels = {f.split("-")[1] for f in os.listdir(folder)}
        assert labels == {"ordinal", "writeback"} and kept(spark) - before == {os.path.basename(folder)}
    assert kept(spark) == before and not os.path.exists(folder)
    # what was written outside the run folder stays
    assert spark.read.parquet(str(tmp_path / "numbered")).agg(F.max("idx")).first()[0] == 167
    assert got.count() == 500


def test_removed_after_an_exception(spark):
    before = kept(spark)
    with pytest.raises(ZeroDivisionError):
        with run_folder(spark):
            spark.range(3).write.parquet(staging(spark, "test"))
            raise ZeroDivisionError
    assert kept(spark) == before


def test_inner_runs_end_first_and_empty_ones_are_no_error(spark):
    with run_folder(spark) as outer:
        with run_folder(spark) as inner:
            assert staging(spark, "a").startswith(inner)
        spark.range(3).write.parquet(path := staging(spark, "b"))
        assert path.startswith(outer)
    assert not os.path.exists(outer)
    assert staging(spark, "c").startswith(os.path.join(checkpoint_dir(spark), "plantops-c-"))


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_a_dropped_store_leaves_no_files_and_no_table(spark, hot_rows):
    before, names = kept(spark), set(spark.catalog.listTables())
    store = TableStore(spark, buckets=3, hot_rows=hot_rows)
    build = lambda: spark.range(60).select((F.col("id") % 3).alias("parent"), (F.floor(F.col("id") / 3) + 1).alias("idx"))
    assert store.child("lines", build).count() == 60 and store.clustered("lines") == (hot_rows > 20)
    store.drop()
    assert kept(spark) == before and set(spark.catalog.listTables()) == names
    # it can be used again
    assert store.child("lines", build).count() == 60
    store.drop()
