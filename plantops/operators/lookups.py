"""Projections, existence gates and denormalising lookups (survey F6-F10,
J1, J8-J10, M7, F1-F4, S1).

Lookups are left joins on a unique key; which physical join runs is left to
the planner (broadcast only when the measured side is under the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.functions.filters import apply_filters
from plantops.functions.scalars import add_days
from plantops.session import shuffle_partitions
from plantops.sources import fixed

PRODUCT_ROWS = 1 << 26  # rows of a product for each task
MAX_PRODUCT_TASKS = 10_000


def item_spec_card(items: DataFrame) -> DataFrame:
    """the item's 12 spec fields with the ``custom_`` prefix dropped."""
    return items.select(F.col("name").alias("item_code"),
                        *[F.col(src).alias(dst) for src, dst in fixed.ITEM_SPEC_FIELDS])


def po_transport(po: DataFrame) -> DataFrame:
    """transport block of each purchase order."""
    return po.select("name", *[F.col(src).alias(dst) for src, dst in fixed.PO_TRANSPORT_FIELDS])


def receipt_details(docs: DataFrame) -> DataFrame:
    """F8: challan/invoice block of each subcontracting receipt."""
    return (docs.where(F.col("doctype") == fixed.DOCTYPE_SCR)
                .select("name", *[F.col(src).alias(dst) for src, dst in fixed.RECEIPT_DETAIL_FIELDS]))


def so_items(so_items_df: DataFrame) -> DataFrame:
    """item_code, qty, rate, amount of each order's lines."""
    return so_items_df.select(F.col("parent").alias("sales_order"), "item_code", "qty", "rate", "amount")


def work_order_item(work_orders: DataFrame) -> DataFrame:
    """production item of each work order."""
    return work_orders.select(F.col("name").alias("work_order"), "production_item")


def _qc_match(work_orders: DataFrame, qc: DataFrame, how: str) -> DataFrame:
    ok = qc.where(F.col("docstatus") == 1).select("reference_name", F.col("item_code").alias("_qc_item"))
    wo = work_orders.select("name", "production_item")
    cond = (wo["name"] == ok["reference_name"]) & (wo["production_item"] == ok["_qc_item"])
    return wo.join(ok, cond, how)


def wo_qc_passed(work_orders: DataFrame, qc: DataFrame) -> DataFrame:
    """Work orders with a submitted QC for the same order and item."""
    return _qc_match(work_orders, qc, "left_semi")


def wo_qc_missing(work_orders: DataFrame, qc: DataFrame) -> DataFrame:
    """The work orders ``check_production_qc`` rejects."""
    return _qc_match(work_orders, qc, "left_anti")


def pmc_enriched(pmc: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """PMC with the customer name fetched and the item's spec fields
    filled in (the form copies the first ten spec-card fields)."""
    c = customers.select(F.col("name").alias("_c"), "customer_name")
    spec = [(s, d) for s, d in fixed.ITEM_SPEC_FIELDS if d not in ("knurling_dia", "thread_height")]
    i = items.select(F.col("name").alias("_i"), *[F.col(s).alias(d) for s, d in spec])
    p = pmc.select("name", "pmc_no", "product_name", "customer_code")
    return (p.join(c, p["customer_code"] == c["_c"], "left")
             .join(i, p["product_name"] == i["_i"], "left")
             .drop("_c", "_i"))


def plan_tube(plans: DataFrame, items: DataFrame) -> DataFrame:
    """A weekly plan's tube fetched from its item."""
    i = items.select(F.col("name").alias("_i"), F.col("custom_tube_dia").alias("tube"))
    p = plans.select("name", "item_name")
    return p.join(i, p["item_name"] == i["_i"], "left").drop("_i")


def spec_enriched(specs: DataFrame, items: DataFrame) -> DataFrame:
    """Product specification number and effective date fetched from the item."""
    i = items.select(F.col("name").alias("_i"),
                     F.col("custom_specification_number").alias("specification_number"),
                     F.col("custom_effective_date").alias("effective_date"))
    s = specs.select("name", "item_code", "revision_no")
    return s.join(i, s["item_code"] == i["_i"], "left").drop("_i")


def item_suppliers(items: DataFrame, item_supplier: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """Suppliers of each item in child order (``position``), duplicates
    kept; an item with no supplier rows may use every supplier, and gets a row
    for each of ``suppliers`` (``all_suppliers=true``, no position: the list
    has no child order).  Called without that table it gives one marker row
    ``(item_code, NULL, all_suppliers=true)`` for such an item instead."""
    own = item_supplier.select(F.col("parent").alias("item_code"), F.col("idx").cast("long").alias("position"), "supplier")
    i = items.select(F.col("name").alias("item_code"))
    listed = i.join(own, "item_code", "inner").withColumn("all_suppliers", F.lit(False))
    without = i.join(own.select("item_code"), "item_code", "left_anti")
    if suppliers is None:
        choice = without.withColumn("supplier", F.lit(None).cast(own.schema["supplier"].dataType))
    else:
        choice = _with_every(without, items.count(), suppliers.select(F.col("name").alias("supplier")))
    fallback = choice.select("item_code", F.lit(None).cast("long").alias("position"), "supplier", F.lit(True).alias("all_suppliers"))
    return listed.unionByName(fallback)


def _with_every(df: DataFrame, most: int, other: DataFrame) -> DataFrame:
    """Each row of ``df`` (``most`` at most) with each of ``other``.  The rows
    of ``df`` are dealt into tasks by the product's size, which AQE does not
    join into larger ones; a task reads ``other`` by itself, so neither table
    is held whole by the driver or in a task's memory."""
    tasks = max(shuffle_partitions(df.sparkSession), min(most * other.count() // PRODUCT_ROWS, MAX_PRODUCT_TASKS))
    return df.repartition(tasks).crossJoin(other.hint("shuffle_replicate_nl"))


def plan_item_choices(plans: DataFrame, so_items_df: DataFrame) -> DataFrame:
    """Items a plan may pick: the items of its sales order."""
    p = plans.select(F.col("name").alias("plan"), "sales_order")
    i = so_items_df.select("parent", "item_code").distinct()
    return p.join(i, p["sales_order"] == i["parent"], "inner").select("plan", "item_code").distinct()


def filter_docs(df: DataFrame, filters) -> DataFrame:
    """ERP filter dict applied as pushed-down predicates."""
    return apply_filters(df, filters)


def date_shift(df: DataFrame, date_col: str, days) -> DataFrame:
    """M7: ``add_days(date, cint(days))`` per row; ``days`` is a column name
    or a literal (text is parsed like ``cint``)."""
    d = F.col(days) if isinstance(days, str) and days in df.columns else F.lit(str(days))
    return df.withColumn("shifted_date", add_days(F.col(date_col), d))


def list_docs(df: DataFrame, modified: str = "modified", name: str = "name") -> DataFrame:
    """The default list order ``modified DESC`` (ties by name); a global
    range-partitioned sort, only when asked for."""
    return df.orderBy(F.col(modified).desc(), F.col(name).asc())
