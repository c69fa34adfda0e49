"""The four script reports and the sales-order list (survey R1-R5, G8).

Each report is one DataFrame plan over whole tables.  Column names and
order follow the reference's ``get_columns``; the placeholder cells stay
literals so the column sets match.  ``""`` cells become NULL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plantops.functions.filters import apply_filters
from plantops.functions.scalars import days_left, excess5, flt, non_blank, or_zero, plus5, round2
from plantops.operators.lines import first_match, latest_bin
from plantops.operators.quantities import pending_po, printed_qty
from plantops.operators.segments import group_marks
from plantops.sources import fixed
from plantops.sources.erp import Erp


def production_planning(erp: Erp, as_of: dt.date | str, filters=None) -> DataFrame:
    """One row per line of every submitted sales order.

    ``customer_name`` only on the first line, ``customer_total_qty`` (sum of
    qty*1.05 over the order) only on the last.  ``filters`` is accepted and
    ignored, as in the reference.  ``as_of`` replaces "today".

    Plan: the lines join their header once, on ``parent`` (without an exchange
    where both are stored in buckets; AQE splits a hot order elsewhere), and
    one pass over them gives the first and last marks and the total
    (:func:`~plantops.operators.segments.group_marks`); the Item lookup is left
    to the planner's size check.
    """
    lines = submitted_lines(erp, ["idx", "item_code", "item_name", "qty"], ["customer", "transaction_date", "delivery_date"])
    lines = group_marks(lines, ["parent"], ["idx"], F.col("qty"), clustered=erp.clustered("sales_order_item"))

    item = erp.item.select(F.col("name").alias("_item"), "custom_tube_dia", "custom_lacquer_porosity")
    lines = lines.join(item, lines["item_code"] == item["_item"], "left")

    return lines.select(
        F.when(F.col("is_first"), F.col("customer")).alias("customer_name"),
        F.col("item_code").alias("product_code"),
        F.col("transaction_date").alias("po_date"),
        F.col("delivery_date"),
        F.col("custom_tube_dia").alias("tube_size"),
        F.col("custom_lacquer_porosity").alias("lac_un"),
        F.lit("sample-slug").alias("slug_size"),
        F.lit("sample-latex").alias("latex"),
        F.col("item_name").alias("product_name"),
        F.lit("sample-tube-gms").alias("tube_gms"),
        F.col("qty").alias("po_qty"),
        excess5("qty").alias("excess_add_5"),
        F.when(F.col("is_last"), plus5(F.col("running"))).alias("customer_total_qty"),
        F.lit("sample-printed-qty").alias("printed_qty"),
        F.lit("sample-pending").alias("pending"),
        F.lit("sample-customer-total-balance").alias("customer_total_balance"),
        days_left("delivery_date", as_of).alias("days_left"))


def submitted_lines(erp: Erp, line_cols: list[str], header_cols: list[str]) -> DataFrame:
    """The lines of submitted sales orders with columns of their header."""
    so = erp.sales_order.where(F.col("docstatus") == 1).select("name", *header_cols)
    items = erp.sales_order_item.select("parent", *line_cols)
    return items.join(so, items["parent"] == so["name"], "inner")


def order_excess_total(erp: Erp) -> DataFrame:
    """Per submitted sales order, its number of lines, the sum of qty and
    that sum with 5 % excess: the segmented sums at the order's last line, so
    an order of any size is summed by many tasks."""
    lines = submitted_lines(erp, ["idx", "qty"], []).drop("name")
    last = group_marks(lines, ["parent"], ["idx"], F.col("qty")).where("is_last")
    return last.select(F.col("parent").alias("sales_order"), F.col("idx").alias("lines"), F.col("running").cast("double").alias("total_qty"),
                       plus5(F.col("running")).alias("excess_total"))


def sales_order_lines(erp: Erp) -> DataFrame:
    """One row per line of every sales order (drafts and cancelled
    too); customer only on the order's first line."""
    so = erp.sales_order.select("name", "customer", "transaction_date", "delivery_date")
    items = erp.sales_order_item.select("parent", "idx", "item_code")
    lines = items.join(so, items["parent"] == so["name"], "inner")
    item = erp.item.select(F.col("name").alias("_item"), "custom_tube_dia", "custom_lacquer_porosity")
    lines = lines.join(item, lines["item_code"] == item["_item"], "left")
    return lines.select(
        F.col("name").alias("so_name"),
        F.when(F.col("idx") == 1, F.col("customer")).alias("customer"),
        F.col("item_code").alias("product_code"),
        "delivery_date",
        F.col("transaction_date").alias("po_date"),
        F.col("custom_tube_dia").alias("tube_size"),
        F.col("custom_lacquer_porosity").alias("lac_un"),
        F.lit("sample-slug").alias("slug"))


def weekly_production_plan(erp: Erp, filters=None) -> DataFrame:
    """R2: one row per weekly plan: planned (first order line's qty * 1.05),
    printed (all qty transferred for manufacture of the item) and the
    difference.  A plan whose order or item has no line plans 0; two plans
    of one item each show the item's full printed total."""
    plans = apply_filters(erp.weekly_production_plan, filters).select(
        "sales_order", "line", "item_name", "tube")
    first = first_match(erp.sales_order_item, ["parent", "item_code"], "qty", alias="_q")
    printed = printed_qty(erp.stock_entry, erp.unnumbered("stock_entry_detail")).select(
        F.col("item_code").alias("_pi"), "printed_qty")
    out = (plans.join(first, (plans["sales_order"] == first["parent"]) & (plans["item_name"] == first["item_code"]),
                      "left")
                .join(printed, plans["item_name"] == printed["_pi"], "left"))
    planned = excess5(or_zero(F.col("_q")))
    printed_c = or_zero(F.col("printed_qty")).cast("double")
    return out.select(
        "line", "item_name", "tube",
        planned.alias("planned"),
        printed_c.alias("printed"),
        (printed_c - planned).alias("over_excess_production"),
        F.lit(1).alias("work_day"),
        F.lit(1).alias("setting"),
        F.lit(2).alias("setting_quantity"),
        F.lit(None).cast("string").alias("set_time"),
        F.lit(None).cast("string").alias("total_days"))


def daily_production(erp: Erp) -> DataFrame:
    """One row per line of each stock entry that names a work order
    (``!= ""``, so NULL is out too); the operation column is the work
    order's ``transfer_material_against`` (NULL for a dangling order)."""
    se = erp.stock_entry.where(non_blank("work_order")).select("name", "posting_date", "work_order")
    sed = erp.unnumbered("stock_entry_detail").select("parent", "item_code", "batch_no", "qty")
    wo = erp.work_order.select(F.col("name").alias("_wo"), "transfer_material_against")
    out = (sed.join(se, sed["parent"] == se["name"], "inner")
              .join(wo, F.col("work_order") == wo["_wo"], "left"))
    zero = F.lit(0)
    return out.select(
        F.col("posting_date").alias("date"),
        F.col("item_code").alias("product_name"),
        F.col("transfer_material_against").alias("opration_name"),
        F.col("batch_no").alias("rm_batch_no"),
        F.col("qty").alias("production_quantity"),
        zero.alias("qty_rejected"), zero.alias("rej_"),
        zero.alias("final_product_batch_no"), zero.alias("lot_no"))


def slug_reconciliation(erp: Erp, item_group: str = fixed.SLUG_GROUP,
                        stock_scope: str = "one") -> DataFrame:
    """One row per item of ``item_group``: stock, pending PO qty, their
    2-place total and the minimum stock.

    ``stock`` is the ``actual_qty`` of one Bin row (latest ``modified``,
    then ``name``) as the reference reads one row; ``stock_scope="sum"``
    gives the all-warehouse sum instead.
    """
    items = erp.item.where(F.col("item_group") == item_group).select("name", "min_order_qty")
    # only the group's items are aggregated: the Bin and PO lines meet the
    # (filtered, usually small) item set first
    keys = items.select(F.col("name").alias("_g"))
    bins = erp.bin.join(keys, F.col("item_code") == F.col("_g"), "left_semi")
    if stock_scope == "sum":
        stock = (bins.groupBy("item_code")
                   .agg(F.sum(F.col("actual_qty").cast("decimal(21,9)")).cast("double").alias("_stock")))
    else:
        stock = latest_bin(bins).select("item_code", F.col("actual_qty").alias("_stock"))
    stock = stock.withColumnRenamed("item_code", "_si")
    pend = pending_po(erp.unnumbered("purchase_order"), erp.unnumbered("purchase_order_item"),
                      only_items=items.select("name")).withColumnRenamed("item_code", "_pi")
    out = (items.join(stock, items["name"] == stock["_si"], "left")
                .join(pend, items["name"] == pend["_pi"], "left"))
    # flt(x, 2) returns a float: round each in decimal, add as doubles
    total = round2("_stock").cast("double") + round2("pending_po").cast("double")
    return out.select(
        F.col("name").alias("item"),
        or_zero(F.col("_stock")).cast("double").alias("stock"),
        or_zero(F.col("pending_po")).cast("double").alias("pending_po"),
        or_zero(total).alias("total"),
        F.lit(3).alias("no_of_slug_per_kg"),
        F.lit(4).alias("pending_so"),
        F.lit(5).alias("slug_to_be_needed"),
        F.lit(6).alias("balance_slug"),
        F.lit(7).alias("tube_may_be_manufactured"),
        or_zero(F.col("min_order_qty")).cast("double").alias("minimum_stock"),
        F.lit(9).alias("excess_less_stock"),
        F.lit(10).alias("slug_to_be_orderd"))


def report_totals(report: DataFrame, columns: list[str]) -> DataFrame:
    """The report's total row, one pass: exact sums of the numeric
    columns plus the row count (``add_total_row``)."""
    return report.agg(F.count(F.lit(1)).alias("row_count"),
                      *[F.sum(F.col(c).cast("decimal(38,9)")).cast("double").alias(f"total_{c}")
                        for c in columns])


def write_with_totals(report: DataFrame, columns: list[str], path: str) -> DataFrame:
    """G8 beside its report: writes ``report`` to ``path`` and returns its total
    row.  The sums are metrics that the writing job itself collects, so the
    report is computed once."""
    seen = Observation()
    sums = [F.sum(F.col(c).cast("decimal(38,9)")).cast("double").alias(f"total_{c}") for c in columns]
    report.observe(seen, F.count(F.lit(1)).alias("row_count"), *sums).write.parquet(path)
    got = seen.get
    schema = ", ".join(["row_count bigint", *[f"total_{c} double" for c in columns]])
    return report.sparkSession.createDataFrame([tuple(got[c] for c in ("row_count", *[f"total_{c}" for c in columns]))], schema)


def weekly_capacity(erp: Erp, tubes_per_setting: float, most_days: float = 6, filters=None) -> DataFrame:
    """R2's intended columns: how long each weekly plan takes on its line.

    ``work_day`` is planned / capacity per day; each product is one setting of
    ``tubes_per_setting`` tubes, ``set_time`` that quantity / capacity per day;
    ``total_days`` their sum, which should not be more than ``most_days``.  The
    capacity is a Data field: text that is no positive number gives NULL."""
    plans = apply_filters(erp.weekly_production_plan, filters).select("name", "sales_order", "line", "item_name", "tube", "capacity_per_day")
    first = first_match(erp.sales_order_item, ["parent", "item_code"], "qty", alias="_q")
    rows = plans.join(first, (plans["sales_order"] == first["parent"]) & (plans["item_name"] == first["item_code"]), "left")
    parsed = flt("capacity_per_day")
    capacity, setting = F.when(parsed > 0, parsed), F.lit(1)
    quantity = setting * F.lit(float(tubes_per_setting))
    out = rows.select("name", "line", "item_name", "tube", excess5(or_zero(F.col("_q"))).alias("planned"), capacity.alias("capacity_per_day"))
    days = F.col("planned") / F.col("capacity_per_day")
    set_time = quantity / F.col("capacity_per_day")
    return out.select("*", days.alias("work_day"), setting.alias("setting"), quantity.alias("setting_quantity"), set_time.alias("set_time"),
                      (days + set_time).alias("total_days"), (days + set_time > most_days).alias("over_6_days"))
