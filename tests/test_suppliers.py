"""An item that lists no supplier gets a row for each supplier."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from plantops.operators import lookups as K
from plantops.plans.registry import QUERIES


def rows_of(df) -> list[str]:
    return sorted(map(repr, map(tuple, df.select("item_code", "position", "supplier", "all_suppliers").collect())))


@pytest.fixture
def frames(spark):
    """Items 1 and 5 list suppliers, one of them twice; 2, 3 (there twice) and
    the one without a name list none."""
    items = spark.createDataFrame([(1,), (2,), (3,), (3,), (5,), (None,)], "name long")
    own = spark.createDataFrame([(1, 1, 8), (1, 2, 7), (1, 3, 8), (5, 1, None), (9, 1, 7)], "parent long, idx long, supplier long")
    return items, own


@pytest.mark.parametrize("rows", [1 << 26, 1])
def test_items_without_suppliers_get_every_supplier(spark, frames, monkeypatch, rows):
    monkeypatch.setattr(K, "PRODUCT_ROWS", rows)
    items, own = frames
    every = (7, 8, 8, 11, None)
    got = K.item_suppliers(items, own, spark.createDataFrame([(s,) for s in every], "name long"))
    listed = [(1, 1, 8, False), (1, 2, 7, False), (1, 3, 8, False), (5, 1, None, False)]
    assert rows_of(got) == sorted(map(repr, listed + [(i, None, s, True) for i in (2, 3, 3, None) for s in every]))


def test_without_any_supplier_no_item_gets_one(spark, frames):
    items, own = frames
    got = K.item_suppliers(items, own, spark.createDataFrame([], "name long"))
    assert got.where("all_suppliers").count() == 0 and got.count() == 4
    assert K.item_suppliers(items, own.where("false"), spark.createDataFrame([(4,)], "name long")).count() == 6


def test_the_product_is_dealt_into_tasks_and_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(K, "PRODUCT_ROWS", 500)
    items, none = spark.range(100).withColumnRenamed("id", "name"), spark.createDataFrame([], "parent long, idx long, supplier long")
    got = K.item_suppliers(items, none, spark.range(0, 70, 1, 1).withColumnRenamed("id", "name")).where("all_suppliers")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain()
    assert "CartesianProduct" in buf.getvalue() and "NestedLoop" not in buf.getvalue()
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 14 and sum(r["count"] for r in tasks) == 7_000 and max(r["count"] for r in tasks) <= 2_100


def test_the_query_lists_every_supplier_of_its_table(spark, tmp_path):
    day = dt.datetime(1997, 5, 1)
    for name, rows, schema in (
            ("lineitem", [(o, p, p % 3, 1, 1.0, 2.0, 0.0, 0.0, "R", "O", day) for o, p in ((1, 1), (1, 2), (2, 1), (3, 4))],
             "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
            ("orders", [(o, 1, "F", 1.0, day, "1-URGENT") for o in (1, 2, 3)],
             "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
            ("part", [(p, f"part {p}", "B", "LARGE" if p == 4 else "SMALL", p, 2.0) for p in (1, 2, 3, 4)],
             "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
            ("supplier", [(s, f"S{s}") for s in range(3)], "s_suppkey long, s_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["item_suppliers"](spark, str(tmp_path))
    assert rows_of(got) == sorted(map(repr, [(1, 1, 1, False), (2, 1, 2, False), *[(i, None, s, True) for i in (3, 4) for s in range(3)]]))
