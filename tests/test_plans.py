"""Plan properties that matter at scale: pushdown reaches the scan, column
pruning holds, and the only explicit broadcast is the bounded offsets table."""

import contextlib
import io

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_slug_group_filter_reaches_part_scan(spark):
    plan = _plan(E.queries()["slug_reconciliation"](spark, SF))
    assert "EqualTo(p_type,ECONOMY)" in plan


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["daily_production"](spark, SF))
    for line in plan.splitlines():
        if line.startswith("ReadSchema") and "lineitem" in plan:
            assert "l_comment" not in line and "l_tax" not in line


def test_report_has_no_per_parent_window(spark):
    # the only windows are over the per-partition stats table (bounded)
    plan = _plan(E.queries()["production_planning"](spark, SF))
    for line in plan.splitlines():
        if line.strip().startswith("Arguments") and "windowspecdefinition(l_orderkey" in line:
            raise AssertionError("window partitioned by the order key: " + line)
