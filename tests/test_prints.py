"""Tax invoice lines that are not stored: the same rows, and no shuffle of
lines that carries the header's texts."""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F

from plantops.operators import documents as D
from plantops.plans.registry import QUERIES
from plantops.sources import store
from plantops.sources.testdata import erp_from_testdata

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def plan_of(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return re.sub(r"#\d+L?", "", buf.getvalue()).splitlines()


def rows_of(df) -> list[str]:
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture
def tables(spark, tmp_path):
    """Orders with up to four lines; parts that are missing, twice or null, an
    order that is there twice and one that is not."""
    day = dt.datetime(1997, 5, 1)
    lines = [(o if o < 30 else None, (None, 3, 99, 5)[n] if o % 4 == 0 else (o + n) % 9, n + 1, n + 1, float(n), float(o + n),
              0.0, 0.0, "R", "O", day) for o in range(32) for n in range(o % 4 + 1)]
    orders = [(o, o % 5 if o % 7 else None, "FOP"[o % 3], 1.0, day, "1-URGENT") for o in [*range(1, 29), 6]]
    parts = [(p, f"part {p}", "B", "SMALL", p, 2.0 + p) for p in [*range(8), 5]]
    for name, rows, schema in (("lineitem", lines, LINES), ("orders", orders, ORDERS), ("part", parts, PART),
                               ("customer", [(c, f"C{c}") for c in range(4)], "c_custkey long, c_name string"),
                               ("supplier", [(s, f"S{s}") for s in range(3)], "s_suppkey long, s_name string")):
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


def test_unstored_invoice_lines_print_the_rows_of_the_stored_ones(spark, tables):
    erp = erp_from_testdata(spark, tables)
    stored = D.print_tax_invoice_lines(erp.sales_invoice, erp.sales_invoice_item, erp.sales_order, erp.item, erp.address)
    got = rows_of(QUERIES["print_tax_invoice_lines"](spark, tables))
    assert got == rows_of(stored) and len(set(got)) > 40
    assert rows_of(erp.unstored("sales_invoice_item")) == rows_of(erp.sales_invoice_item)


def test_invoice_lines_meet_the_header_last_and_store_nothing(spark, tables, no_broadcast, monkeypatch):
    monkeypatch.setattr(store, "_stores", {})
    plan = plan_of(QUERIES["print_tax_invoice_lines"](spark, tables))
    joins = [x for x in plan if "Join" in x]
    assert "[parent], [name], Inner" in joins[0], plan
    assert not [x for x in plan[:plan.index(joins[0])] if "Exchange" in x], plan
    lines = plan[plan.index(joins[0]):next(i for i, x in enumerate(plan) if "hashpartitioning(name" in x)]
    assert not [x for x in lines if "vehicle_no" in x], lines
    assert not [s for s in store._stores.values() if s._tables]


def test_a_replaced_table_is_not_read_by_its_old_unstored_builder(spark, tables):
    erp = erp_from_testdata(spark, tables)
    one = erp.sales_invoice_item.where(F.col("sales_order") == 1)
    assert rows_of(erp.with_table("sales_invoice_item", one).unstored("sales_invoice_item")) == rows_of(one)
    assert not [t for t in erp.tables() if "__" in t]
