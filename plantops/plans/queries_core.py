"""Registered queries: reports, lines, quantities."""

from __future__ import annotations


from plantops.operators import lines as L
from plantops.operators import quantities as Q
from plantops.plans import reports as R
from plantops.plans.registry import AS_OF, AS_OF_SQL, ORACLES, SLUG_GROUP_TEST, register
from plantops.session import staging

_EXCESS_TOTAL = "CAST(SUM(CAST(qty AS DECIMAL(21,9))) * CAST(1.05 AS DECIMAL(3,2)) AS DOUBLE)"


@register("production_planning", f"""
SELECT CASE WHEN i.idx = 1 THEN s.customer END AS customer_name, i.item_code AS product_code,
       s.transaction_date AS po_date, s.delivery_date, it.custom_tube_dia AS tube_size,
       it.custom_lacquer_porosity AS lac_un, 'sample-slug' AS slug_size, 'sample-latex' AS latex,
       i.item_name AS product_name, 'sample-tube-gms' AS tube_gms, i.qty AS po_qty,
       i.qty * CAST(0.05 AS DOUBLE) + i.qty AS excess_add_5,
       CASE WHEN i.idx = t.last_idx THEN t.total END AS customer_total_qty,
       'sample-printed-qty' AS printed_qty, 'sample-pending' AS pending,
       'sample-customer-total-balance' AS customer_total_balance,
       CAST(GREATEST(s.delivery_date - {AS_OF_SQL}, 0) AS INTEGER) AS days_left
FROM v_sales_order s
JOIN v_sales_order_item i ON i.parent = s.name
LEFT JOIN (SELECT parent, MAX(idx) AS last_idx, {_EXCESS_TOTAL} AS total
           FROM v_sales_order_item GROUP BY parent) t ON t.parent = i.parent
LEFT JOIN v_item it ON it.name = i.item_code
WHERE s.docstatus = 1""")
def production_planning(erp):
    """R1 flagship: production planning report over all submitted orders."""
    return R.production_planning(erp, AS_OF)


@register("order_excess_total", f"""
SELECT i.parent AS sales_order, MAX(i.idx) AS lines, CAST(SUM(CAST(i.qty AS DECIMAL(21,9))) AS DOUBLE) AS total_qty, {_EXCESS_TOTAL} AS excess_total
FROM v_sales_order_item i WHERE i.parent IN (SELECT name FROM v_sales_order WHERE docstatus = 1) GROUP BY i.parent""")
def order_excess_total(erp):
    """Total of each submitted order with 5 % excess."""
    return R.order_excess_total(erp)


@register("sales_order_lines", """
SELECT s.name AS so_name, CASE WHEN i.idx = 1 THEN s.customer END AS customer, i.item_code AS product_code,
       s.delivery_date, s.transaction_date AS po_date, it.custom_tube_dia AS tube_size,
       it.custom_lacquer_porosity AS lac_un, 'sample-slug' AS slug
FROM v_sales_order s JOIN v_sales_order_item i ON i.parent = s.name
LEFT JOIN v_item it ON it.name = i.item_code""")
def sales_order_lines(erp):
    """Lines of every sales order."""
    return R.sales_order_lines(erp)


_FIRST_QTY = "(SELECT parent, item_code, arg_min(qty, idx) AS q FROM v_sales_order_item GROUP BY parent, item_code)"
_PRINTED = f"""(SELECT d.item_code, CAST(SUM(CAST(d.qty AS DECIMAL(21,9))) AS DOUBLE) AS printed_qty
   FROM v_stock_entry_detail d JOIN v_stock_entry e ON e.name = d.parent
   WHERE e.stock_entry_type = 'Material Transfer for Manufacture' GROUP BY d.item_code)"""


@register("weekly_production_plan", f"""
SELECT w.line, w.item_name, w.tube,
       COALESCE(f.q, 0) * CAST(0.05 AS DOUBLE) + COALESCE(f.q, 0) AS planned,
       CAST(COALESCE(p.printed_qty, 0) AS DOUBLE) AS printed,
       CAST(COALESCE(p.printed_qty, 0) AS DOUBLE) - (COALESCE(f.q, 0) * CAST(0.05 AS DOUBLE) + COALESCE(f.q, 0))
           AS over_excess_production,
       1 AS work_day, 1 AS setting, 2 AS setting_quantity,
       CAST(NULL AS VARCHAR) AS set_time, CAST(NULL AS VARCHAR) AS total_days
FROM v_weekly_production_plan w
LEFT JOIN {_FIRST_QTY} f ON f.parent = w.sales_order AND f.item_code = w.item_name
LEFT JOIN {_PRINTED} p ON p.item_code = w.item_name""")
def weekly_production_plan(erp):
    """R2: weekly plan, planned vs printed."""
    return R.weekly_production_plan(erp)


@register("daily_production", """
SELECT e.posting_date AS date, d.item_code AS product_name, w.transfer_material_against AS opration_name,
       d.batch_no AS rm_batch_no, d.qty AS production_quantity,
       0 AS qty_rejected, 0 AS rej_, 0 AS final_product_batch_no, 0 AS lot_no
FROM v_stock_entry_detail d JOIN v_stock_entry e ON e.name = d.parent
LEFT JOIN v_work_order w ON w.name = e.work_order
WHERE COALESCE(e.work_order, '') <> ''""")
def daily_production(erp):
    """Daily production from stock entries with a work order."""
    return R.daily_production(erp)


_LATEST_BIN = """(SELECT item_code, name, warehouse, actual_qty, modified FROM v_bin
   QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY modified DESC, name) = 1)"""
_PENDING = """(SELECT i.item_code, CAST(SUM(CAST(i.qty AS DECIMAL(21,9))) AS DOUBLE) AS pending_po
   FROM v_purchase_order_item i
   WHERE i.parent IN (SELECT name FROM v_purchase_order WHERE status = 'To Receive and Bill')
   GROUP BY i.item_code)"""


@register("slug_reconciliation", f"""
SELECT it.name AS item, CAST(COALESCE(b.actual_qty, 0) AS DOUBLE) AS stock,
       CAST(COALESCE(p.pending_po, 0) AS DOUBLE) AS pending_po,
       CAST(COALESCE(ROUND_EVEN(CAST(b.actual_qty AS DECIMAL(21,9)), 2), 0) AS DOUBLE)
          + CAST(COALESCE(ROUND_EVEN(CAST(p.pending_po AS DECIMAL(21,9)), 2), 0) AS DOUBLE) AS total,
       3 AS no_of_slug_per_kg, 4 AS pending_so, 5 AS slug_to_be_needed, 6 AS balance_slug,
       7 AS tube_may_be_manufactured, CAST(COALESCE(it.min_order_qty, 0) AS DOUBLE) AS minimum_stock,
       9 AS excess_less_stock, 10 AS slug_to_be_orderd
FROM v_item it
LEFT JOIN {_LATEST_BIN} b ON b.item_code = it.name
LEFT JOIN {_PENDING} p ON p.item_code = it.name
WHERE it.item_group = '{SLUG_GROUP_TEST}'""")
def slug_reconciliation(erp):
    """Slug reconciliation for the test item group."""
    return R.slug_reconciliation(erp, item_group=SLUG_GROUP_TEST)


@register("report_totals", f"""
SELECT COUNT(*) AS row_count,
       CAST(SUM(CAST(i.qty AS DECIMAL(38,9))) AS DOUBLE) AS total_po_qty,
       CAST(SUM(CAST(i.qty * CAST(0.05 AS DOUBLE) + i.qty AS DECIMAL(38,9))) AS DOUBLE) AS total_excess_add_5
FROM v_sales_order s JOIN v_sales_order_item i ON i.parent = s.name WHERE s.docstatus = 1""")
def report_totals(erp):
    """Total row of the production planning report."""
    return R.report_totals(R.production_planning(erp, AS_OF), ["po_qty", "excess_add_5"])


def _totals(of: str, columns: list[str]) -> str:
    """The total row over the oracle of a report."""
    sums = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(38,9))) AS DOUBLE) AS total_{c}" for c in columns)
    return f"SELECT COUNT(*) AS row_count, {sums} FROM ({ORACLES[of]}) t"


_WEEKLY_SUMS = ["planned", "printed", "over_excess_production"]
_DAILY_SUMS = ["production_quantity"]
_SLUG_SUMS = ["stock", "pending_po", "total", "minimum_stock"]


@register("weekly_plan_totals", _totals("weekly_production_plan", _WEEKLY_SUMS))
def weekly_plan_totals(erp):
    """Total row of the weekly production plan."""
    return R.report_totals(R.weekly_production_plan(erp), _WEEKLY_SUMS)


@register("daily_production_totals", _totals("daily_production", _DAILY_SUMS))
def daily_production_totals(erp):
    """Total row of the daily production report."""
    return R.report_totals(R.daily_production(erp), _DAILY_SUMS)


@register("slug_totals", _totals("slug_reconciliation", _SLUG_SUMS))
def slug_totals(erp):
    """Total row of the slug reconciliation report."""
    return R.report_totals(R.slug_reconciliation(erp, SLUG_GROUP_TEST), _SLUG_SUMS)


@register("report_totals_observed", ORACLES["report_totals"])
def report_totals_observed(erp):
    """Total row of the production planning report, collected by the job that writes the report."""
    path = staging(erp.spark, "report")
    return R.write_with_totals(R.production_planning(erp, AS_OF), ["po_qty", "excess_add_5"], path)


_PLANNED = "COALESCE(f.q, 0) * CAST(0.05 AS DOUBLE) + COALESCE(f.q, 0)"


@register("weekly_capacity", f"""
SELECT name, line, item_name, tube, planned, capacity_per_day, planned / capacity_per_day AS work_day, 1 AS setting, CAST(500 AS DOUBLE) AS setting_quantity,
       CAST(500 AS DOUBLE) / capacity_per_day AS set_time, planned / capacity_per_day + CAST(500 AS DOUBLE) / capacity_per_day AS total_days,
       planned / capacity_per_day + CAST(500 AS DOUBLE) / capacity_per_day > 6 AS over_6_days
FROM (SELECT w.name, w.line, w.item_name, w.tube, {_PLANNED} AS planned, CAST(w.capacity_per_day AS DOUBLE) AS capacity_per_day
      FROM v_weekly_production_plan w LEFT JOIN {_FIRST_QTY} f ON f.parent = w.sales_order AND f.item_code = w.item_name) t""")
def weekly_capacity(erp):
    """R2's intended capacity columns: work days, set time and plans over six days."""
    return R.weekly_capacity(erp, tubes_per_setting=500)


@register("order_lines", """
SELECT s.name, s.customer, s.docstatus, s.transaction_date, s.delivery_date,
       i.idx, i.item_code, i.item_name, i.qty, i.rate, i.amount
FROM v_sales_order s JOIN v_sales_order_item i ON i.parent = s.name""")
def order_lines(erp):
    """A3: header x lines for every sales order (inner)."""
    return L.order_lines(erp.sales_order, erp.sales_order_item,
                         ["name", "customer", "docstatus", "transaction_date", "delivery_date"],
                         ["parent", "idx", "item_code", "item_name", "qty", "rate", "amount"]).drop("parent")


@register("latest_bin", f"SELECT * FROM {_LATEST_BIN}")
def latest_bin(erp):
    """A5: one Bin row per item (latest modified, then name)."""
    return L.latest_bin(erp.bin)


@register("so_item_qty", f"""
SELECT w.name, w.sales_order, w.item_name AS item_code, f.q AS qty
FROM v_weekly_production_plan w
LEFT JOIN {_FIRST_QTY} f ON f.parent = w.sales_order AND f.item_code = w.item_name""")
def so_item_qty(erp):
    """Qty of the first order line with the plan's item (NULL if none)."""
    return L.so_item_qty(erp.weekly_production_plan, erp.sales_order_item)


@register("so_item_list", """
SELECT i.parent AS sales_order, i.idx AS position, i.item_code FROM v_sales_order_item i
WHERE i.parent IN (SELECT name FROM v_sales_order)""")
def so_item_list(erp):
    """Item codes per order in line order (long form)."""
    return L.so_item_list(erp.sales_order, erp.sales_order_item)


@register("item_default_suppliers", """
SELECT parent AS item_code,
       CAST(row_number() OVER (PARTITION BY parent ORDER BY idx) AS BIGINT) AS position,
       default_supplier AS supplier
FROM v_item_default WHERE default_supplier IS NOT NULL""")
def item_default_suppliers(erp):
    """Non-empty default suppliers per item in child order."""
    return L.item_default_suppliers(erp.item_default)


@register("po_qty_by_supplier_item", """
SELECT h.supplier, i.item_code, CAST(SUM(CAST(i.qty AS DECIMAL(21,9))) AS DOUBLE) AS po_qty
FROM v_purchase_order_item i JOIN v_purchase_order h ON h.name = i.parent
GROUP BY h.supplier, i.item_code""")
def po_qty_by_supplier_item(erp):
    """G1: ordered qty per (supplier, item)."""
    return Q.po_qty_by_supplier_item(erp.unnumbered("purchase_order"), erp.unnumbered("purchase_order_item"))


@register("so_qty_by_customer_item", """
SELECT h.customer, i.item_code, CAST(SUM(CAST(i.qty AS DECIMAL(21,9))) AS DOUBLE) AS so_qty
FROM v_sales_order_item i JOIN v_sales_order h ON h.name = i.parent
WHERE h.docstatus = 1 GROUP BY h.customer, i.item_code""")
def so_qty_by_customer_item(erp):
    """Submitted sales qty per (customer, item)."""
    return Q.so_qty_by_customer_item(erp.sales_order, erp.unnumbered("sales_order_item"))


@register("pending_po", f"SELECT * FROM {_PENDING}")
def pending_po(erp):
    """Pending PO qty per item."""
    return Q.pending_po(erp.unnumbered("purchase_order"), erp.unnumbered("purchase_order_item"))


@register("printed_qty", f"SELECT * FROM {_PRINTED}")
def printed_qty(erp):
    """Qty transferred for manufacture per item."""
    return Q.printed_qty(erp.stock_entry, erp.unnumbered("stock_entry_detail"))
