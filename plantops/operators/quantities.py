"""Per-key quantity sums (survey G1-G4): the reference's one-item SQL
``SUM(qty) ... WHERE item_code = %s`` becomes one grouped aggregate over all
items.  Header filters are semi joins, sums are exact decimals emitted as
DOUBLE, and partial aggregation absorbs hot items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.functions.scalars import qty_sum
from plantops.sources import fixed


def po_qty_by_supplier_item(po: DataFrame, po_items: DataFrame) -> DataFrame:
    """G1: ordered qty per (supplier, item) over all purchase orders (no
    docstatus filter, as in the reference)."""
    i = po_items.select("parent", "item_code", "qty")
    h = po.select("name", "supplier")
    return (i.join(h, i["parent"] == h["name"])
             .groupBy("supplier", "item_code").agg(qty_sum("qty").alias("po_qty")))


def so_qty_by_customer_item(so: DataFrame, so_items: DataFrame) -> DataFrame:
    """Qty of submitted sales orders per (customer, item)."""
    i = so_items.select("parent", "item_code", "qty")
    h = so.where(F.col("docstatus") == 1).select("name", "customer")
    return (i.join(h, i["parent"] == h["name"])
             .groupBy("customer", "item_code").agg(qty_sum("qty").alias("so_qty")))


def pending_po(po: DataFrame, po_items: DataFrame,
               status: str = fixed.STATUS_TO_RECEIVE_AND_BILL, only_items: DataFrame | None = None) -> DataFrame:
    """Qty on purchase orders whose status is exactly ``status``, per
    item (ordered qty; the received part is not deducted).  ``only_items``
    (one column ``name``) restricts the lines before any shuffle."""
    open_po = po.where(F.col("status") == status).select("name")
    i = po_items.select("parent", "item_code", "qty")
    if only_items is not None:
        i = i.join(only_items.select(F.col("name").alias("_only")), F.col("item_code") == F.col("_only"),
                   "left_semi")
    return (i.join(open_po, i["parent"] == open_po["name"], "left_semi")
             .groupBy("item_code").agg(qty_sum("qty").alias("pending_po")))


def printed_qty(se: DataFrame, se_items: DataFrame,
                entry_type: str = fixed.SE_TRANSFER_FOR_MANUFACTURE) -> DataFrame:
    """Qty moved by stock entries of ``entry_type`` per item; draft and
    cancelled entries count too, all dates."""
    h = se.where(F.col("stock_entry_type") == entry_type).select("name")
    i = se_items.select("parent", "item_code", "qty")
    return (i.join(h, i["parent"] == h["name"])
             .groupBy("item_code").agg(qty_sum("qty").alias("printed_qty")))
