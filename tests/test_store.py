"""The stored child tables: what is written, and plans without an exchange."""

import contextlib
import io
import tempfile

from erp_frames import make_erp
from pyspark.sql import functions as F

from plantops.operators import documents as D
from plantops.plans import reports as R
from plantops.sources.store import TableStore, store_for
from plantops.sources.testdata import erp_from_testdata

SF = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue().splitlines()


def _below(plan: list[str], join: str) -> list[str]:
    """The lines of the subtree under the first node that holds ``join``."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    top = next(i for i, line in enumerate(plan) if join in line)
    out = []
    for line in plan[top + 1:]:
        if depth(line) <= depth(plan[top]):
            break
        out.append(line)
    return out


def _join_of_lines(spark, df, key: str) -> list[str]:
    """The subtree under the sort-merge join of lines and header."""
    return _below(_plan(df), f"SortMergeJoin [{key}")


def test_lines_join_their_header_without_an_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        erp = erp_from_testdata(spark, SF)
        reports = {
            "R1": R.production_planning(erp, "1998-01-01"),
            "P2": D.print_purchase_order(erp.purchase_order, erp.purchase_order_item, erp.item, erp.supplier),
            "P3": D.print_tax_invoice_lines(erp.sales_invoice, erp.sales_invoice_item, erp.sales_order, erp.item, erp.address)}
        for name, df in reports.items():
            tree = _join_of_lines(spark, df, "parent")
            # the header of P2 and P3 meets its own lookups first; the lines are never dealt anew
            lines = [x for x in tree if "Exchange" in x]
            assert tree and not [x for x in lines if "hashpartitioning(parent" in x], (name, tree)
            if name == "R1":
                assert not lines, tree
                assert not [x for x in _plan(df) if "hashpartitioning(parent" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_r1_reads_its_lines_once(spark):
    erp = erp_from_testdata(spark, SF)
    plan = _plan(R.production_planning(erp, "1998-01-01"))
    assert sum("sales_order_item" in x for x in plan if "Scan" in x) == 1


def test_store_keeps_rows_and_splits_none_of_a_hot_parent(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("parent"), F.floor(F.col("id") / 7).alias("idx"), F.lit("x").alias("text"))
    rows = rows.withColumn("idx", F.col("idx") + 1)
    store = TableStore(spark, tempfile.mkdtemp(prefix="plantops-store-test-"), buckets=4)
    small = store.child("small", lambda: rows)
    tight = TableStore(spark, tempfile.mkdtemp(prefix="plantops-store-test-"), buckets=4, hot_rows=50)
    hot = tight.child("small", lambda: rows)
    assert store.clustered("small") and store.largest["small"] == 72 and not tight.clustered("small")
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, small.collect())) == want == sorted(map(tuple, hot.collect()))
    assert store.child("small", lambda: 1 / 0) is small  # written once


def test_a_store_is_for_its_input(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    first = store_for(spark, [str(tmp_path / "a")])
    assert store_for(spark, [str(tmp_path / "a")]) is first
    spark.range(3).write.mode("append").parquet(str(tmp_path / "a"))
    assert store_for(spark, [str(tmp_path / "a")]) is not first


def test_reports_are_the_same_without_a_store(spark):
    erp = erp_from_testdata(spark, SF)
    tables = {t: erp[t] for t in ("sales_order", "sales_order_item", "item")}
    plain = make_erp(spark, {})
    for t, df in tables.items():
        plain = plain.with_table(t, df)
    assert erp.clustered("sales_order_item") and not plain.clustered("sales_order_item")
    a, b = R.production_planning(erp, "1998-01-01"), R.production_planning(plain, "1998-01-01")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
