"""Findings of round 3: tasks whose share does not grow with the input, rows
dealt once, no join on a few values, a new version computed once."""

import contextlib
import datetime as dt
import io
import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantops.operators import checklists as C
from plantops.operators import quality as QA
from plantops.operators.ordinal import largest_group, numbered
from plantops.operators.writeback import write_version
from plantops.sources import fixed, store
from plantops.sources.testdata import erp_from_testdata

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables: every order has lines of two suppliers and of none."""
    day = dt.datetime(1997, 5, 1)
    lines = [(o, (o + n) % 9, (None, 3, 4)[n % 3], n, float(n), float(o + n), 0.0, 0.0, "R", "O", day) for o in range(40) for n in range(o % 8 + 1)]
    for name, rows, schema in (("lineitem", lines, LINES), ("orders", [(o, o % 5, "FOP"[o % 3], 1.0, day, "1-URGENT") for o in range(40)], ORDERS),
                               ("part", [(p, f"part {p}", "B", ("STANDARD", "SMALL", "PROMO", "LARGE")[p % 4], p, 2.0) for p in range(8)], PART),
                               ("supplier", [(3, "S3"), (4, "S4")], "s_suppkey long, s_name string"),
                               ("customer", [(c, f"C{c}") for c in range(5)], "c_custkey long, c_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def no_broadcast(spark):
    """Lookups are joined by a shuffle, as those of large tables are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_buckets_grow_with_the_input(spark, tables, monkeypatch):
    paths = [f"{tables}/{t}.parquet" for t in ("lineitem", "orders", "part")]
    size = sum(store._stamp(spark, p)[0] for p in paths)
    monkeypatch.setattr(store, "BUCKET_INPUT", size // 20)
    assert store.store_for(spark, paths).buckets >= 20
    erp = erp_from_testdata(spark, tables)
    got = sorted(map(tuple, erp.sales_order_item.select("parent", "idx", "item_code", "qty").collect()))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    want = spark.read.parquet(paths[0]).withColumn("idx", F.row_number().over(w)).where("l_partkey < 8")
    assert got == sorted(map(tuple, want.select("l_orderkey", "idx", "l_partkey", "l_quantity").collect()))
    assert spark.conf.get(store.AUTO_SCAN) == "true"


def test_numbered_rows_are_dealt_once_into_the_tasks_asked_for(spark):
    df = spark.range(300).selectExpr("id % 50 AS k", "id AS o", "IF(id % 50 % 2 = 0, NULL, concat('n', id % 50)) AS label")
    got = numbered(df, ["k"], ["o"], partitions=11, deal=["label"], largest=6)
    assert plan_of(got).count("Exchange") == 1 and got.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, got.select("k", "o", "idx").collect())) == sorted((i % 50, i, i // 50 + 1) for i in range(300))


def test_largest_group_is_a_bound_and_exact_beyond_it(spark):
    df = spark.range(40_000).selectExpr("IF(id < 500, 7, id) AS k")
    assert largest_group(df, ["k"], 400) == 500 and 500 <= largest_group(df, ["k"], 5_000) <= 5_000
    assert largest_group(df.where("k < 0"), ["k"], 5) == 0


def test_purchase_lines_without_a_supplier_keep_their_numbers(spark, tables):
    got = erp_from_testdata(spark, tables).purchase_order_item
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")
    want = (spark.read.parquet(f"{tables}/lineitem.parquet").withColumn("idx", F.row_number().over(w)).where("l_partkey < 8")
                 .selectExpr("'PUR-ORD-2024-' || l_orderkey || '-' || l_suppkey AS parent", "CAST(idx AS long) AS idx", "l_partkey", "l_quantity"))
    assert sorted(map(repr, map(tuple, got.select("parent", "idx", "item_code", "qty").collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_suppliers_of_a_part_are_numbered_alike_for_a_hot_part(spark, tables, monkeypatch):
    got = sorted(map(repr, erp_from_testdata(spark, tables).item_default.collect()))
    monkeypatch.setattr(store, "_stores", {})
    monkeypatch.setattr(store.TableStore.__init__, "__defaults__", (None, None, 2))
    erp = erp_from_testdata(spark, tables)
    assert got == sorted(map(repr, erp.item_default.collect())) and got


def test_checklists_deal_no_lines_by_checklist_or_type(spark, tables, no_broadcast):
    cl = C.checklist_transactions(erp_from_testdata(spark, tables), "1998-01-01")
    for df in (cl.headers, cl.rows, cl.rejects):
        plan = re.sub(r"#\d+L?", "", plan_of(df))
        assert "hashpartitioning(custom_checklist" not in plan and "hashpartitioning(parent, parenttype" not in plan, plan
        assert "SortMergeJoin [parent], [name]" in plan, plan
    assert cl.headers.count() and cl.rejects.count()


def test_lines_meet_the_document_of_their_type(spark):
    from erp_frames import make_erp
    day = dt.date(2024, 1, 1)
    erp = make_erp(spark, {
        "doc": ([("X", fixed.DOCTYPE_PR, 1, 1, day), ("X", fixed.DOCTYPE_DN, 1, 1, day), ("X", None, 1, 1, day)],
                "name string, doctype string, supplier long, customer long, posting_date date"),
        "doc_item": ([("X", t, i, 5, "n", 1.0, "b", "l", "x", "s", 1.0) for i, t in ((1, fixed.DOCTYPE_PR), (2, fixed.DOCTYPE_DN), (3, None))],
                     "parent string, parenttype string, idx long, item_code long, item_name string, qty double, batch_no string, lot_no string, "
                     "custom_box_no string, custom_supplier_batch_no string, custom_actual_consumed_qty double"),
        "supplier": ([(1, "S")], "name long, supplier_name string"), "customer": ([(1, "C")], "name long, customer_name string")})
    assert sorted(map(tuple, C.document_lines(erp).select("doctype", "idx").collect())) == [(fixed.DOCTYPE_DN, 2), (fixed.DOCTYPE_PR, 1)]


def test_domains_are_not_joined_by_a_shuffle(spark, no_broadcast):
    rows = spark.createDataFrame([("a", "Ok"), ("b", "odd"), ("c", ""), ("d", None)], "name string, observation string")
    found = QA.dq_domain(rows, "T", "observation", fixed.domain_frame(spark, "observation", fixed.CHECKLIST_OBSERVATIONS))
    assert "hashpartitioning" not in plan_of(found) and [r.name for r in found.collect()] == ["b"]


def test_a_new_version_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    old = spark.range(100).selectExpr("id AS name", "'old' AS text")
    new = old.selectExpr("name", "IF(name % 2 = 0, 'new', text) AS text").mapInArrow(count, old.schema)
    got = write_version(old, new, os.path.join(str(tmp_path), "t"), "name", parts=4)
    assert seen.value == 100 and got.where("text = 'new'").count() == 50 and got.count() == 100
