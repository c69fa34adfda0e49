"""Print datasets and document maintenance jobs (survey P2-P4, J5, W2, D2, B1).

Print formats are rendered elsewhere; these are the rows they print.
Maintenance jobs return the whole new child table (a snapshot to write to a
new path), never an in-place update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.functions.scalars import QTY, qty, qty_sum, slice_from
from plantops.operators.ordinal import numbered
from plantops.sources import fixed


def print_purchase_order(po: DataFrame, po_items: DataFrame, items: DataFrame,
                         suppliers: DataFrame) -> DataFrame:
    """One row per PO line: printed PO number (``name[13:]``), supplier,
    date, line number, item with its name looked up (the template prints
    it in the HSN column), uom, qty, rate, amount, delivery date."""
    h = (po.select("name", "supplier", "transaction_date")
           .join(suppliers.select(F.col("name").alias("_s"), "supplier_name"),
                 F.col("supplier") == F.col("_s"), "left"))
    i = po_items.select("parent", "idx", "item_code", "uom", "qty", "rate", "amount", "expected_delivery_date")
    it = items.select(F.col("name").alias("_i"), F.col("item_name").alias("item_name"))
    return (i.join(h, i["parent"] == h["name"], "inner")
             .join(it, F.col("item_code") == F.col("_i"), "left")
             .select("name", slice_from("name", 13).alias("po_no"), "supplier_name", "transaction_date",
                     F.col("idx").alias("sr_no"), "item_code", "item_name", "uom", "qty", "rate", "amount",
                     "expected_delivery_date"))


def print_tax_invoice_lines(si: DataFrame, si_items: DataFrame, so: DataFrame, items: DataFrame,
                            address: DataFrame, bucketed: bool = True) -> DataFrame:
    """One row per invoice line with the customer PO (from the line's
    sales order), HSN code, billing/shipping GSTIN (two address lookups) and
    the header's due date, IRN, transport block and remarks.

    Lines ``bucketed`` with their header meet it first, without an exchange.
    Others look up item and sales order while they are narrow and meet the
    header last, so no shuffle of lines carries the header's texts."""
    cells = ["due_date", "irn", "transporter", "vehicle_no", "lr_no", "lr_date", "remarks"]
    h = si.select("name", "customer", "customer_address", "shipping_address_name", "posting_date", *cells)
    bill = address.select(F.col("name").alias("_ba"), F.col("gstin").alias("billing_gstin"))
    ship = address.select(F.col("name").alias("_sa"), F.col("gstin").alias("shipping_gstin"))
    h = (h.join(bill, F.col("customer_address") == F.col("_ba"), "left")
          .join(ship, F.col("shipping_address_name") == F.col("_sa"), "left"))
    i = si_items.select("parent", "idx", "item_code", "sales_order", "custom_no_of_pkgs", "custom_average_contents_per",
                        "qty", "rate", "taxable_value")
    o = so.select(F.col("name").alias("_so"), "po_no", "po_date")
    it = items.select(F.col("name").alias("_i"), "gst_hsn_code")
    joins = [(h, F.col("parent") == F.col("name"), "inner"), (o, F.col("sales_order") == F.col("_so"), "left"),
             (it, F.col("item_code") == F.col("_i"), "left")]
    for other, on, how in joins if bucketed else joins[::-1]:
        i = i.join(other, on, how).drop("_so", "_i")
    return i.select(F.col("name").alias("invoice"), "posting_date", "customer", "billing_gstin",
                    "shipping_gstin", F.col("idx").alias("sr_no"), "item_code", "po_no", "po_date",
                    "gst_hsn_code", F.col("custom_no_of_pkgs").alias("no_of_pkgs"),
                    F.col("custom_average_contents_per").alias("average_contents_per"), "qty", "rate", "taxable_value", *cells)


def print_tax_invoice_charges(si: DataFrame, taxes: DataFrame) -> DataFrame:
    """Per invoice, the header totals and the charge amounts by account
    head (packing, insurance, freight; several rows of one head are summed).
    The template prints the taxable total (the header's ``total``) and the
    header's total taxes only inside the freight branch, so those two cells
    are NULL when the invoice has no freight row."""
    heads = {"packing_charges": fixed.TAX_PACKING, "insurance": fixed.TAX_INSURANCE, "freight_and_forwarding": fixed.TAX_FREIGHT}
    head, amount = F.col("account_head"), F.col("base_tax_amount")
    charges = (taxes.where(head.isin(*heads.values())).groupBy("parent").agg(
        *[qty_sum(F.when(head == h, amount)).alias(c) for c, h in heads.items()],
        F.max((head == fixed.TAX_FREIGHT).cast("int")).alias("_freight")))
    printed = F.col("_freight") == 1
    return (si.select("name", "total_qty", "total", "total_taxes_and_charges", "grand_total")
              .join(charges, F.col("name") == F.col("parent"), "left")
              .select(F.col("name").alias("invoice"), *heads, F.when(printed, F.col("total")).alias("total_taxable_value"),
                      F.when(printed, F.col("total_taxes_and_charges")).alias("total_taxes_and_charges"),
                      "total_qty", "total", "grand_total"))


def batch_backfill(batches: DataFrame, docs: DataFrame, doc_items: DataFrame,
                   doctype: str = fixed.DOCTYPE_PR) -> DataFrame:
    """Every batch that references a receipt takes supplier batch no.
    and box no. from the first line (lowest idx) of that receipt with the
    batch's item; batches without a match keep their values."""
    pr = docs.where(F.col("doctype") == doctype).select(F.col("name").alias("_doc"))
    lines = doc_items.select("parent", "idx", "item_code", "custom_supplier_batch_no", "custom_box_no")
    lines = lines.join(pr, F.col("parent") == F.col("_doc"), "left_semi")
    first = lines.groupBy(F.col("parent").alias("_p"), F.col("item_code").alias("_it")).agg(
        F.min_by(F.struct("custom_supplier_batch_no", "custom_box_no"), F.col("idx")).alias("_m"))
    out = batches.join(first, (F.col("reference_name") == F.col("_p")) & (F.col("item") == F.col("_it")), "left")
    hit = F.col("_p").isNotNull()
    return out.withColumns({
        c: F.when(hit, F.col(f"_m.{c}")).otherwise(F.col(c)) for c in ("custom_supplier_batch_no", "custom_box_no")
    }).select(*batches.columns)


def doc_references(existing: DataFrame, custom: DataFrame) -> DataFrame:
    """The reference child list of each document after validation: the
    custom list replaces the old one when it is non-empty."""
    replaced = custom.select(F.col("parent").alias("_rp")).distinct()
    kept = existing.join(replaced, F.col("parent") == F.col("_rp"), "left_anti")
    return kept.unionByName(custom, allowMissingColumns=True)


def write_snapshot(table: DataFrame, path: str) -> None:
    """Writes a whole new table to a new path; an existing path raises."""
    table.write.mode("errorifexists").parquet(path)


def consumed_qty_reconciled(supplied: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconcile actual consumed quantities of subcontracting receipts.

    1. every supplied row whose item is not in the receipt's actual list is
       appended to it (qty rounded to 3 places; duplicates appended twice,
       since the membership list is taken before appending);
    2. then, walking the final actual list in order, the first supplied
       row of each item takes that actual qty -- so the last actual row of
       an item wins, also when it is NULL.

    Rounding is half-even, as Python's; quantities are Data fields, so a text
    that is no number counts as NULL.

    Returns ``(supplied_after, actual_after)``, the whole new child tables with
    all their columns; the other columns of an appended row are NULL.
    """
    s, a = supplied, actual

    present = a.select(F.col("parent").alias("_ap"), F.col("item").alias("_ai")).distinct()
    missing = s.join(present, (F.col("parent") == F.col("_ap")) & (F.col("main_item_code") == F.col("_ai")),
                     "left_anti")
    base = a.groupBy(F.col("parent").alias("_bp")).agg(F.max("idx").alias("_n"))
    appended = numbered(missing.select("parent", "idx", "main_item_code", "consumed_qty"), ["parent"], ["idx"], "_k")
    appended = (appended.join(base, F.col("parent") == F.col("_bp"), "left")
                        .select("parent", (F.coalesce(F.col("_n"), F.lit(0)) + F.col("_k")).cast("long").alias("idx"),
                                F.col("main_item_code").alias("item"),
                                F.bround(qty("consumed_qty"), 3).cast(QTY).alias("actual_consumed_qty")))
    actual_after = a.withColumn("actual_consumed_qty", qty("actual_consumed_qty")).unionByName(appended, allowMissingColumns=True)

    last_actual = actual_after.groupBy(F.col("parent").alias("_lp"), F.col("item").alias("_li")).agg(
        F.max_by("actual_consumed_qty", "idx").alias("_new"))
    first_supplied = s.groupBy(F.col("parent").alias("_fp"), F.col("main_item_code").alias("_fi")).agg(
        F.min("idx").alias("_first"))
    out = (s.join(first_supplied, (F.col("parent") == F.col("_fp")) & (F.col("main_item_code") == F.col("_fi")))
             .join(last_actual, (F.col("parent") == F.col("_lp")) & (F.col("main_item_code") == F.col("_li")),
                   "left"))
    new_qty = (F.when((F.col("idx") == F.col("_first")) & F.col("_lp").isNotNull(), F.col("_new"))
                .otherwise(qty("consumed_qty")).cast("double"))
    supplied_after = out.withColumn("consumed_qty", new_qty).select(*s.columns)
    return supplied_after, actual_after.withColumn("actual_consumed_qty",
                                                   F.col("actual_consumed_qty").cast("double"))


def pmc_requirements(pmc: DataFrame, pmc_items: DataFrame, items: DataFrame,
                     sections: DataFrame) -> DataFrame:
    """B1: the eight PMC raw-material tables stacked in long form with the
    section label and the raw material's item name."""
    p = pmc.select("name", "product_name")
    c = pmc_items.select("parent", "parentfield", "idx", "raw_material_name", "supplier_name")
    it = items.select(F.col("name").alias("_i"), F.col("item_name").alias("raw_material_item_name"))
    return (c.join(p, F.col("parent") == F.col("name"), "inner")
             .join(sections, "parentfield", "left")
             .join(it, F.col("raw_material_name") == F.col("_i"), "left")
             .select(F.col("name").alias("pmc"), "product_name", "section", "idx",
                     "raw_material_name", "raw_material_item_name", "supplier_name"))
