"""Registered queries: lookups, pricing, checklists, documents, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantops.operators import checklists as C
from plantops.operators import documents as D
from plantops.operators import lookups as K
from plantops.operators import pricing as P
from plantops.operators import quality as QA
from plantops.operators import writeback as W
from plantops.plans.registry import (AS_OF, AS_OF_SQL, PRICE_AMOUNT, PRICE_LIST, PRICE_SUPPLIER,
                                     PRICE_VALID_FROM, ORACLES, register)
from plantops.sources import fixed


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in dict.fromkeys(values))


PR, DN, SCR = _q(fixed.DOCTYPE_PR), _q(fixed.DOCTYPE_DN), _q(fixed.DOCTYPE_SCR)
EDITS = _in(fixed.CHECKLISTS_WITH_EDITS)
LOT, BAGS = _q(fixed.PARAM_LOT), _q(fixed.PARAM_BAGS)

# ---------------------------------------------------------------- projections


@register("item_spec_card", "SELECT name AS item_code, "
          + ", ".join(f"{s} AS {d}" for s, d in fixed.ITEM_SPEC_FIELDS) + " FROM v_item")
def item_spec_card(erp):
    """item spec card."""
    return K.item_spec_card(erp.item)


@register("po_transport", "SELECT name, "
          + ", ".join(f"{s} AS {d}" for s, d in fixed.PO_TRANSPORT_FIELDS) + " FROM v_purchase_order")
def po_transport(erp):
    """purchase order transport block."""
    return K.po_transport(erp.purchase_order)


@register("receipt_details", "SELECT name, "
          + ", ".join(f"{s} AS {d}" for s, d in fixed.RECEIPT_DETAIL_FIELDS)
          + f" FROM v_doc WHERE doctype = {SCR}")
def receipt_details(erp):
    """F8: subcontracting receipt challan/invoice block."""
    return K.receipt_details(erp.doc)


@register("so_items", "SELECT parent AS sales_order, item_code, qty, rate, amount FROM v_sales_order_item")
def so_items(erp):
    """order lines (item_code, qty, rate, amount)."""
    return K.so_items(erp.unnumbered("sales_order_item"))


@register("work_order_item", "SELECT name AS work_order, production_item FROM v_work_order")
def work_order_item(erp):
    """work order -> production item."""
    return K.work_order_item(erp.work_order)


_FILTERS = {"work_order": ["!=", ""],
            "stock_entry_type": ["in", [fixed.SE_TRANSFER_FOR_MANUFACTURE, "Manufacture"]],
            "docstatus": 1}
_TYPED_FILTERS = [["Stock Entry", "posting_date", "!=", "1995-06-17"], ["Stock Entry", "docstatus", "not in", ["2", 3]],
                  ["Stock Entry", "work_order", "not in", ["WO-1", "WO-2"]], ["Stock Entry", "posting_date", ">=", "1993-01-01"]]


@register("filter_typed", """SELECT * FROM v_stock_entry WHERE COALESCE(posting_date, DATE '0001-01-01') <> DATE '1995-06-17'
  AND COALESCE(docstatus, 0) NOT IN (2, 3) AND COALESCE(work_order, '') NOT IN ('WO-1', 'WO-2') AND posting_date >= DATE '1993-01-01'""")
def filter_typed(erp):
    """ERP filters in list form on date, number and text fields (a NULL work order passes ``not in``)."""
    return K.filter_docs(erp.stock_entry, _TYPED_FILTERS)


@register("filter_docs", f"""SELECT * FROM v_stock_entry WHERE COALESCE(work_order, '') <> ''
  AND stock_entry_type IN ({_q(fixed.SE_TRANSFER_FOR_MANUFACTURE)}, 'Manufacture') AND docstatus = 1""")
def filter_docs(erp):
    """ERP filter dict (!=, in, =) over stock entries."""
    return K.filter_docs(erp.stock_entry, _FILTERS)


@register("date_shift", "SELECT name, transaction_date, transaction_date + 30 AS shifted_date FROM v_sales_order")
def date_shift(erp):
    """M7: add_days(date, cint('30'))."""
    return K.date_shift(erp.sales_order.select("name", "transaction_date"), "transaction_date", "30")


@register("list_docs", "SELECT * FROM v_bin ORDER BY modified DESC, name")
def list_docs(erp):
    """Default list order modified DESC."""
    return K.list_docs(erp.bin)

# ---------------------------------------------------------------- joins


_QC_OK = ("SELECT 1 FROM v_production_qc q WHERE q.docstatus = 1 AND q.reference_name = w.name "
          "AND q.item_code = w.production_item")


@register("wo_qc_passed", f"SELECT name, production_item FROM v_work_order w WHERE EXISTS ({_QC_OK})")
def wo_qc_passed(erp):
    """Work orders with a submitted QC."""
    return K.wo_qc_passed(erp.work_order, erp.production_qc)


@register("wo_qc_missing", f"SELECT name, production_item FROM v_work_order w WHERE NOT EXISTS ({_QC_OK})")
def wo_qc_missing(erp):
    """Work orders failing the QC gate."""
    return K.wo_qc_missing(erp.work_order, erp.production_qc)


_PMC_SPEC = [(s, d) for s, d in fixed.ITEM_SPEC_FIELDS if d not in ("knurling_dia", "thread_height")]


@register("pmc_enriched", "SELECT p.name, p.pmc_no, p.product_name, p.customer_code, c.customer_name, "
          + ", ".join(f"i.{s} AS {d}" for s, d in _PMC_SPEC)
          + """ FROM v_pmc p LEFT JOIN v_customer c ON c.name = p.customer_code
                LEFT JOIN v_item i ON i.name = p.product_name""")
def pmc_enriched(erp):
    """PMC with fetched customer name and item spec fields."""
    return K.pmc_enriched(erp.pmc, erp.customer, erp.item)


@register("plan_tube", """SELECT w.name, w.item_name, i.custom_tube_dia AS tube
  FROM v_weekly_production_plan w LEFT JOIN v_item i ON i.name = w.item_name""")
def plan_tube(erp):
    """Plan tube fetched from the item."""
    return K.plan_tube(erp.weekly_production_plan, erp.item)


@register("spec_enriched", """SELECT s.name, s.item_code, s.revision_no,
  i.custom_specification_number AS specification_number, i.custom_effective_date AS effective_date
  FROM v_product_specification s LEFT JOIN v_item i ON i.name = s.item_code""")
def spec_enriched(erp):
    """Product specification number/effective date fetched from the item."""
    return K.spec_enriched(erp.product_specification, erp.item)


@register("item_suppliers", """
SELECT i.name AS item_code, s.idx AS position, s.supplier, false AS all_suppliers
FROM v_item i JOIN v_item_supplier s ON s.parent = i.name
UNION ALL
SELECT i.name, CAST(NULL AS BIGINT), a.name, true FROM v_item i CROSS JOIN v_supplier a
WHERE NOT EXISTS (SELECT 1 FROM v_item_supplier s WHERE s.parent = i.name)""")
def item_suppliers(erp):
    """Item suppliers; every supplier for an item that lists none."""
    return K.item_suppliers(erp.item, erp.item_supplier, erp.supplier)


@register("plan_item_choices", """SELECT DISTINCT w.name AS plan, i.item_code
  FROM v_weekly_production_plan w JOIN v_sales_order_item i ON i.parent = w.sales_order""")
def plan_item_choices(erp):
    """Item choices of each plan (items of its sales order)."""
    return K.plan_item_choices(erp.weekly_production_plan, erp.unnumbered("sales_order_item"))

# ---------------------------------------------------------------- pricing


_SUP_ITEMS = f"SELECT parent FROM v_item_default WHERE default_supplier = {PRICE_SUPPLIER}"


@register("supplier_items", f"""SELECT p.name, p.item_code FROM v_item_price p
  WHERE p.price_list = {_q(PRICE_LIST)} AND p.item_code IN ({_SUP_ITEMS})""")
def supplier_items(erp):
    """Price rows of the list whose item has the supplier as default."""
    return P.supplier_items(erp.item_price, erp.unnumbered("item_default"), PRICE_SUPPLIER, PRICE_LIST)


_CHANGE = (f"p.price_list = {_q(PRICE_LIST)} AND q.parent IS NOT NULL "
           "AND p.price_list_rate IS NOT NULL AND p.price_list_rate <> 0")


@register("price_revision", f"""
SELECT p.name, p.item_code, p.price_list,
       CASE WHEN {_CHANGE} THEN p.price_list_rate + CAST({PRICE_AMOUNT} AS DOUBLE) ELSE p.price_list_rate END
           AS price_list_rate,
       CASE WHEN {_CHANGE} THEN DATE '{PRICE_VALID_FROM.isoformat()}' ELSE p.valid_from END AS valid_from
FROM v_item_price p LEFT JOIN (SELECT DISTINCT parent FROM v_item_default
                               WHERE default_supplier = {PRICE_SUPPLIER}) q ON q.parent = p.item_code""")
def price_revision(erp):
    """Item price table after the supplier price revision."""
    return P.price_revision(erp.item_price, erp.unnumbered("item_default"), PRICE_SUPPLIER, PRICE_LIST,
                            str(PRICE_AMOUNT), PRICE_VALID_FROM)

# ---------------------------------------------------------------- checklists


_CL_VIEWS = f"""
cl_lines AS (SELECT d.name, d.doctype, d.posting_date, s.supplier_name, c.customer_name,
                    i.idx, i.item_code, i.item_name, i.qty, i.batch_no, i.lot_no, i.custom_box_no,
                    i.custom_supplier_batch_no, i.custom_actual_consumed_qty, it.custom_checklist, it.item_group
             FROM v_doc_item i JOIN v_doc d ON d.name = i.parent AND d.doctype = i.parenttype
             LEFT JOIN v_supplier s ON s.name = d.supplier
             LEFT JOIN v_customer c ON c.name = d.customer
             LEFT JOIN v_item it ON it.name = i.item_code),
cl_known AS (SELECT * FROM cl_lines WHERE custom_checklist IN (SELECT parent FROM v_checklist_template)),
cl_last AS (SELECT parent, parameters, observation FROM v_checklist_template
            QUALIFY row_number() OVER (PARTITION BY parent, parameters ORDER BY idx DESC) = 1),
cl_headers AS (
  SELECT l.doctype AS reference, l.name AS grb_nomrn_no_date, l.idx AS line_idx, l.item_code AS product,
         l.custom_checklist AS checklist,
         CASE l.doctype WHEN {PR} THEN 'Inward' WHEN {DN} THEN 'Outward' WHEN {SCR} THEN 'Subcontracting' END
             AS transaction_type,
         CASE WHEN l.doctype IN ({PR}, {SCR}) THEN l.supplier_name WHEN l.doctype = {DN} THEN l.customer_name END
             AS supplier_or_customer,
         CASE WHEN l.doctype IN ({PR}, {SCR}) THEN l.posting_date END AS purchase_date,
         CAST(CASE WHEN l.doctype = {SCR} THEN l.custom_actual_consumed_qty ELSE l.qty END AS DOUBLE) AS total_qty,
         CASE WHEN l.doctype = {PR} THEN l.lot_no END AS lot_no,
         CASE WHEN l.doctype = {PR} THEN l.custom_box_no END AS box_no,
         CASE WHEN l.doctype = {PR} THEN l.custom_supplier_batch_no ELSE l.batch_no END AS custom_batch_no,
         CASE WHEN lo.parent IS NULL THEN NULL
              WHEN l.custom_checklist IN ({EDITS}) AND l.doctype = {PR} THEN l.lot_no
              ELSE lo.observation END AS received_lot_no,
         bo.observation AS received_bags,
         {AS_OF_SQL} AS transaction_date, 0 AS docstatus
  FROM cl_known l
  LEFT JOIN cl_last lo ON lo.parent = l.custom_checklist AND lo.parameters = {LOT}
  LEFT JOIN cl_last bo ON bo.parent = l.custom_checklist AND bo.parameters = {BAGS}),
cl_rows AS (
  SELECT l.doctype AS reference, l.name AS grb_nomrn_no_date, l.idx AS line_idx,
         CAST(row_number() OVER (PARTITION BY l.doctype, l.name, l.idx ORDER BY t.idx) AS BIGINT) AS idx,
         t.parameters,
         CASE WHEN l.custom_checklist IN ({EDITS}) AND l.doctype = {PR} AND t.parameters = {_q(fixed.PARAM_SOURCE_GRADE)}
                   THEN l.item_name
              WHEN l.custom_checklist IN ({EDITS}) AND t.parameters = {_q(fixed.PARAM_MATERIAL)} THEN l.item_group
              ELSE t.specification END AS specification,
         t.observation
  FROM cl_known l JOIN v_checklist_template t ON t.parent = l.custom_checklist
  WHERE COALESCE(t.parameters, '') NOT IN ({LOT}, {BAGS}))"""


def _cl_sql(body: str) -> str:
    return f"WITH {_CL_VIEWS.strip()}\n{body}"


@register("checklist_headers", _cl_sql("SELECT * FROM cl_headers"))
def checklist_headers(erp):
    """One checklist header per document line."""
    return C.checklist_transactions(erp, AS_OF).headers


@register("checklist_rows", _cl_sql("SELECT * FROM cl_rows"))
def checklist_rows(erp):
    """Checklist child rows with the row edits applied."""
    return C.checklist_transactions(erp, AS_OF).rows


@register("checklist_rejects", _cl_sql("""
SELECT doctype AS reference, name AS grb_nomrn_no_date, idx AS line_idx, item_code, custom_checklist,
       CASE WHEN COALESCE(custom_checklist, '') <> '' THEN 'checklist not found' ELSE 'no checklist on item' END
           AS reason
FROM cl_lines WHERE custom_checklist IS NULL
   OR custom_checklist NOT IN (SELECT parent FROM v_checklist_template)"""))
def checklist_rejects(erp):
    """Document lines whose item has no usable checklist."""
    return C.checklist_transactions(erp, AS_OF).rejects


@register("print_checklist", _cl_sql("""
SELECT r.reference, r.grb_nomrn_no_date, r.line_idx, h.product, CAST(NULL AS VARCHAR) AS supplier, h.total_qty,
       r.idx AS sr_no, r.parameters, r.specification, r.observation
FROM cl_rows r JOIN cl_headers h USING (reference, grb_nomrn_no_date, line_idx)"""))
def print_checklist(erp):
    """Checklist print dataset."""
    return C.print_checklist(C.checklist_transactions(erp, AS_OF))


@register("docs_with_draft_checklists", _cl_sql("""
SELECT d.name, d.doctype FROM v_doc d WHERE EXISTS (
  SELECT 1 FROM cl_headers h WHERE h.grb_nomrn_no_date = d.name AND h.reference = d.doctype
     AND h.line_idx % 3 <> 0)"""))
def docs_with_draft_checklists(erp):
    """Documents with a draft checklist (test rule: every third line's
    checklist is submitted)."""
    tx = C.checklist_transactions(erp, AS_OF).headers.withColumn(
        "docstatus", F.when(F.col("line_idx") % 3 == 0, 1).otherwise(0))
    return C.docs_with_draft_checklists(erp.doc, tx)


@register("item_checklist", """SELECT i.name AS item_code, i.custom_checklist AS checklist, t.idx, t.parameters,
  t.specification, t.observation FROM v_item i JOIN v_checklist_template t ON t.parent = i.custom_checklist""")
def item_checklist(erp):
    """Item -> checklist template rows."""
    return C.item_checklist(erp.item, erp.checklist_template)

# ---------------------------------------------------------------- documents


@register("print_purchase_order", """
SELECT h.name, substr(h.name, 14) AS po_no, s.supplier_name, h.transaction_date, i.idx AS sr_no, i.item_code,
       it.item_name, i.uom, i.qty, i.rate, i.amount, i.expected_delivery_date
FROM v_purchase_order_item i JOIN v_purchase_order h ON h.name = i.parent
LEFT JOIN v_supplier s ON s.name = h.supplier LEFT JOIN v_item it ON it.name = i.item_code""")
def print_purchase_order(erp):
    """Purchase order print dataset."""
    return D.print_purchase_order(erp.unnumbered("purchase_order"), erp.purchase_order_item, erp.item, erp.supplier)


@register("print_tax_invoice_lines", """
SELECT h.name AS invoice, h.posting_date, h.customer, b.gstin AS billing_gstin, s.gstin AS shipping_gstin,
       i.idx AS sr_no, i.item_code, o.po_no, o.po_date, it.gst_hsn_code,
       i.custom_no_of_pkgs AS no_of_pkgs, i.custom_average_contents_per AS average_contents_per, i.qty, i.rate, i.taxable_value,
       h.due_date, h.irn, h.transporter, h.vehicle_no, h.lr_no, h.lr_date, h.remarks
FROM v_sales_invoice_item i JOIN v_sales_invoice h ON h.name = i.parent
LEFT JOIN v_address b ON b.name = h.customer_address LEFT JOIN v_address s ON s.name = h.shipping_address_name
LEFT JOIN v_sales_order o ON o.name = i.sales_order LEFT JOIN v_item it ON it.name = i.item_code""")
def print_tax_invoice_lines(erp):
    """Tax invoice line print dataset."""
    return D.print_tax_invoice_lines(erp.unnumbered("sales_invoice"), erp.unstored("sales_invoice_item"), erp.unnumbered("sales_order"),
                                     erp.item, erp.address, bucketed=False)


_AMT = "CAST(base_tax_amount AS DECIMAL(21,9))"


@register("print_tax_invoice_charges", f"""
SELECT si.name AS invoice, CAST(tx.pack AS DOUBLE) AS packing_charges, CAST(tx.ins AS DOUBLE) AS insurance,
       CAST(tx.fr AS DOUBLE) AS freight_and_forwarding,
       CASE WHEN tx.hf = 1 THEN si.total END AS total_taxable_value,
       CASE WHEN tx.hf = 1 THEN si.total_taxes_and_charges END AS total_taxes_and_charges,
       si.total_qty, si.total, si.grand_total
FROM v_sales_invoice si
LEFT JOIN (SELECT parent,
                  SUM(CASE WHEN account_head = {_q(fixed.TAX_PACKING)} THEN {_AMT} END) AS pack,
                  SUM(CASE WHEN account_head = {_q(fixed.TAX_INSURANCE)} THEN {_AMT} END) AS ins,
                  SUM(CASE WHEN account_head = {_q(fixed.TAX_FREIGHT)} THEN {_AMT} END) AS fr,
                  MAX(CASE WHEN account_head = {_q(fixed.TAX_FREIGHT)} THEN 1 ELSE 0 END) AS hf
           FROM v_sales_taxes GROUP BY parent) tx ON tx.parent = si.name""")
def print_tax_invoice_charges(erp):
    """Tax invoice header totals and charges by account head."""
    return D.print_tax_invoice_charges(erp.sales_invoice, erp.sales_taxes)


@register("batch_backfill", f"""
SELECT b.name, b.reference_name, b.item,
       CASE WHEN f.parent IS NOT NULL THEN f.custom_supplier_batch_no ELSE b.custom_supplier_batch_no END
           AS custom_supplier_batch_no,
       CASE WHEN f.parent IS NOT NULL THEN f.custom_box_no ELSE b.custom_box_no END AS custom_box_no
FROM v_batch b LEFT JOIN (
  SELECT parent, item_code, custom_supplier_batch_no, custom_box_no FROM v_doc_item
  WHERE parent IN (SELECT name FROM v_doc WHERE doctype = {PR})
  QUALIFY row_number() OVER (PARTITION BY parent, item_code ORDER BY idx) = 1) f
ON f.parent = b.reference_name AND f.item_code = b.item""")
def batch_backfill(erp):
    """Supplier batch / box no. copied from the first matching receipt line."""
    return D.batch_backfill(erp.batch, erp.unnumbered("doc"), erp.doc_item)


@register("doc_references", """
SELECT parent, idx, link_doctype, link_name FROM v_doc_reference
WHERE parent NOT IN (SELECT parent FROM v_custom_document_reference)
UNION ALL SELECT parent, idx, link_doctype, link_name FROM v_custom_document_reference""")
def doc_references(erp):
    """Reference list replaced by the custom list when non-empty."""
    return D.doc_references(erp.doc_reference, erp.custom_document_reference)


_D2 = """
d2_app AS (SELECT s.parent, s.idx AS sidx, s.main_item_code, s.consumed_qty FROM v_scr_supplied_item s
           WHERE NOT EXISTS (SELECT 1 FROM v_scr_actual_consumed a
                             WHERE a.parent = s.parent AND a.item = s.main_item_code)),
d2_n AS (SELECT parent, MAX(idx) AS n FROM v_scr_actual_consumed GROUP BY parent),
d2_actual AS (
  SELECT parent, idx, item, CAST(actual_consumed_qty AS DECIMAL(21,9)) AS q FROM v_scr_actual_consumed
  UNION ALL
  SELECT a.parent, CAST(COALESCE(n.n, 0) + row_number() OVER (PARTITION BY a.parent ORDER BY a.sidx) AS BIGINT),
         a.main_item_code, CAST(ROUND_EVEN(a.consumed_qty, 3) AS DECIMAL(21,9))
  FROM d2_app a LEFT JOIN d2_n n ON n.parent = a.parent)"""


@register("consumed_qty_reconciled", f"""WITH {_D2.strip()}
SELECT s.parent, s.idx, s.main_item_code,
       CAST(CASE WHEN s.idx = f.first AND la.parent IS NOT NULL THEN la.q ELSE s.consumed_qty END AS DOUBLE) AS consumed_qty
FROM v_scr_supplied_item s
JOIN (SELECT parent, main_item_code, MIN(idx) AS first FROM v_scr_supplied_item GROUP BY parent, main_item_code) f
  ON f.parent = s.parent AND f.main_item_code = s.main_item_code
LEFT JOIN (SELECT parent, item, q FROM d2_actual
           QUALIFY row_number() OVER (PARTITION BY parent, item ORDER BY idx DESC) = 1) la
  ON la.parent = s.parent AND la.item = s.main_item_code""")
def consumed_qty_reconciled(erp):
    """Supplied items after the consumed-qty reconciliation."""
    return D.consumed_qty_reconciled(erp.scr_supplied_item, erp.scr_actual_consumed)[0]


@register("actual_consumed_items", f"""WITH {_D2.strip()}
SELECT parent, idx, item, CAST(q AS DOUBLE) AS actual_consumed_qty FROM d2_actual""")
def actual_consumed_items(erp):
    """Actual consumed list after appending the missing supplied items."""
    return D.consumed_qty_reconciled(erp.scr_supplied_item, erp.scr_actual_consumed)[1]


_SECTIONS_SQL = "(VALUES " + ", ".join(f"({_q(f)}, {_q(s)})" for f, s in fixed.PMC_SECTIONS) + \
    ") AS sec(parentfield, section)"


@register("pmc_requirements", f"""
SELECT p.name AS pmc, p.product_name, sec.section, c.idx, c.raw_material_name,
       it.item_name AS raw_material_item_name, c.supplier_name
FROM v_pmc_item c JOIN v_pmc p ON p.name = c.parent
LEFT JOIN {_SECTIONS_SQL} ON sec.parentfield = c.parentfield
LEFT JOIN v_item it ON it.name = c.raw_material_name""")
def pmc_requirements(erp):
    """B1: PMC raw-material requirements in long form."""
    sections = erp.spark.createDataFrame(fixed.PMC_SECTIONS, "parentfield string, section string")
    return D.pmc_requirements(erp.pmc, erp.pmc_item, erp.item, sections)

# ---------------------------------------------------------------- write back


def _new_path(erp):
    from plantops.session import staging
    return staging(erp.spark, "table")


@register("price_revision_written", ORACLES["price_revision"])
def price_revision_written(erp):
    """The price list as read back after the revised rows were written."""
    table = W.KeyedTable.create(erp.item_price, _new_path(erp), "name")
    table.replace(P.price_changes(erp.item_price, erp.unnumbered("item_default"), PRICE_SUPPLIER, PRICE_LIST, PRICE_AMOUNT, PRICE_VALID_FROM))
    return table.read()


@register("batch_backfill_written", ORACLES["batch_backfill"])
def batch_backfill_written(erp):
    """The batches as read back after the filled ones were written."""
    return W.write_version(erp.batch, D.batch_backfill(erp.batch, erp.unnumbered("doc"), erp.doc_item), _new_path(erp), "name")


@register("doc_references_written", ORACLES["doc_references"])
def doc_references_written(erp):
    """The reference lists as read back after the custom lists took their place."""
    table = W.KeyedTable.create(erp.doc_reference, _new_path(erp), "parent")
    table.replace(erp.custom_document_reference)
    return table.read()


@register("consumed_qty_written", ORACLES["consumed_qty_reconciled"])
def consumed_qty_written(erp):
    """The supplied items as read back after the reconciled lists were written."""
    old = erp.scr_supplied_item.withColumn("consumed_qty", F.col("consumed_qty").cast("double"))
    return W.write_version(old, D.consumed_qty_reconciled(erp.scr_supplied_item, erp.scr_actual_consumed)[0], _new_path(erp), "parent")

# ---------------------------------------------------------------- quality


@register("dq_unique", """
SELECT 'PMC' AS doctype, 'pmc_no' AS field, pmc_no AS value, COUNT(*) AS n
FROM v_pmc WHERE pmc_no IS NOT NULL GROUP BY pmc_no HAVING COUNT(*) > 1
UNION ALL
SELECT 'Product Specification', 'specification_number', i.custom_specification_number, COUNT(*)
FROM v_product_specification s JOIN v_item i ON i.name = s.item_code
WHERE i.custom_specification_number IS NOT NULL GROUP BY i.custom_specification_number HAVING COUNT(*) > 1
UNION ALL
SELECT 'Checklist', 'checklist_name', checklist_name, COUNT(*)
FROM v_checklist WHERE checklist_name IS NOT NULL GROUP BY checklist_name HAVING COUNT(*) > 1""")
def dq_unique(erp):
    """Q1: duplicated unique keys (pmc_no, specification_number, checklist_name)."""
    return QA.union_all([
        QA.dq_unique(erp.pmc, "PMC", "pmc_no"),
        QA.dq_unique(erp.checklist, "Checklist", "checklist_name"),
        QA.dq_unique(K.spec_enriched(erp.product_specification, erp.item), "Product Specification",
                     "specification_number")])


def _dom_sql(doctype, field, name_expr, table, values):
    return (f"SELECT {_q(doctype)} AS doctype, {_q(field)} AS field, {name_expr} AS name, "
            f"CAST({field} AS VARCHAR) AS value FROM {table} WHERE {field} IS NOT NULL AND {field} <> '' "
            f"AND {field} NOT IN ({_in(values)})")


_TNAME = "parent || '#' || CAST(idx AS VARCHAR)"
_RNAME = "reference || '#' || grb_nomrn_no_date || '#' || CAST(line_idx AS VARCHAR) || '#' || CAST(idx AS VARCHAR)"


@register("dq_domain", _cl_sql(" UNION ALL ".join([
    _dom_sql("Checklist Transaction", "parameters", _RNAME, "cl_rows", fixed.CHECKLIST_PARAMETERS),
    _dom_sql("Checklist Transaction", "observation", _RNAME, "cl_rows", fixed.CHECKLIST_OBSERVATIONS),
    _dom_sql("Checklist", "parameters", _TNAME, "v_checklist_template", fixed.CHECKLIST_PARAMETERS),
    _dom_sql("Checklist", "observation", _TNAME, "v_checklist_template", fixed.CHECKLIST_OBSERVATIONS),
    _dom_sql("Solution Type", "department", "name", "v_solution_type", fixed.SOP_DEPARTMENTS)])))
def dq_domain(erp):
    """Q2: select fields outside their option lists, in templates and in the
    checklist rows made from them."""
    spark = erp.spark
    rows = C.checklist_transactions(erp, AS_OF).rows.withColumn(
        "name", F.concat_ws("#", "reference", "grb_nomrn_no_date", F.col("line_idx").cast("string"), F.col("idx").cast("string")))
    tmpl = erp.checklist_template.withColumn(
        "name", F.concat(F.col("parent"), F.lit("#"), F.col("idx").cast("string")))
    return QA.union_all([
        QA.dq_domain(rows, "Checklist Transaction", "parameters",
                     fixed.domain_frame(spark, "parameters", fixed.CHECKLIST_PARAMETERS)),
        QA.dq_domain(rows, "Checklist Transaction", "observation",
                     fixed.domain_frame(spark, "observation", fixed.CHECKLIST_OBSERVATIONS)),
        QA.dq_domain(tmpl, "Checklist", "parameters",
                     fixed.domain_frame(spark, "parameters", fixed.CHECKLIST_PARAMETERS)),
        QA.dq_domain(tmpl, "Checklist", "observation",
                     fixed.domain_frame(spark, "observation", fixed.CHECKLIST_OBSERVATIONS)),
        QA.dq_domain(erp.solution_type, "Solution Type", "department",
                     fixed.domain_frame(spark, "department", fixed.SOP_DEPARTMENTS))])


def _link_sql(doctype, field, name_expr, table, target):
    return (f"SELECT {_q(doctype)} AS doctype, {_q(field)} AS field, {name_expr} AS name, "
            f"CAST({field} AS VARCHAR) AS value FROM {table} t WHERE COALESCE(CAST({field} AS VARCHAR), '') <> '' "
            f"AND NOT EXISTS (SELECT 1 FROM {target} x WHERE x.name = t.{field})")


_PMC_ITEM_NAME = "parent || '#' || parentfield || '#' || CAST(idx AS VARCHAR)"


@register("dq_links", " UNION ALL ".join([
    _link_sql("Weekly Production Plan", "sales_order", "name", "v_weekly_production_plan", "v_sales_order"),
    _link_sql("Weekly Production Plan", "item_name", "name", "v_weekly_production_plan", "v_item"),
    _link_sql("PMC", "product_name", "name", "v_pmc", "v_item"),
    _link_sql("PMC", "customer_code", "name", "v_pmc", "v_customer"),
    _link_sql("PMC", "sales_order", "name", "v_pmc", "v_sales_order"),
    _link_sql("Weekly Production Plan", "line", "name", "v_weekly_production_plan", "v_workstation"),
    _link_sql("Solution Type", "prepared_by", "name", "v_solution_type", "v_employee"),
    _link_sql("Actual Consumed Qty Table", "item", "parent || '#' || CAST(idx AS VARCHAR)", "v_scr_actual_consumed", "v_item"),
    _link_sql("Aluminium Slug", "raw_material_name", _PMC_ITEM_NAME, "v_pmc_item", "v_item")]))
def dq_links(erp):
    """Q3: Link fields whose target row does not exist."""
    pmc_item = erp.pmc_item.withColumn("name", F.concat_ws("#", "parent", "parentfield",
                                                           F.col("idx").cast("string")))
    actual = erp.scr_actual_consumed.withColumn("name", F.concat_ws("#", "parent", F.col("idx").cast("string")))
    return QA.dq_links_all(
        [(erp.weekly_production_plan, "Weekly Production Plan", {"sales_order": "Sales Order", "item_name": "Item", "line": "Workstation"}),
         (erp.pmc, "PMC", {"product_name": "Item", "customer_code": "Customer", "sales_order": "Sales Order"}),
         (erp.solution_type, "Solution Type", {"prepared_by": "Employee"}),
         (actual, "Actual Consumed Qty Table", {"item": "Item"}),
         (pmc_item, "Aluminium Slug", {"raw_material_name": "Item"})],
        {"Sales Order": erp.unnumbered("sales_order"), "Item": erp.item, "Customer": erp.customer, "Workstation": erp.workstation, "Employee": erp.employee})

# ---------------------------------------------------------------- streaming


def _run_stream(spark, sf_dir):
    from plantops.sources.testdata import ORDERS_SCHEMA, doc_from_orders, erp_from_testdata
    from plantops.streaming.checklist_stream import run_checklist_stream
    erp = erp_from_testdata(spark, sf_dir)
    base = sf_dir.rstrip("/")
    # a glob: the file source wants a folder, the test table is one file
    stream = (spark.readStream.schema(ORDERS_SCHEMA).option("maxFilesPerTrigger", 1)
              .parquet(f"{base}/orders.parque[t]"))
    return erp, run_checklist_stream(spark, erp, doc_from_orders(stream), AS_OF)


def checklist_stream(spark, sf_dir):
    """Checklists written by the Structured Streaming job for the
    documents arriving on a file stream (one batch over the test files)."""
    headers, _, _ = _run_stream(spark, sf_dir)[1]
    return headers.drop("batch_id")


def checklist_stream_rejects(spark, sf_dir):
    """The lines that the stream could make no checklist for, kept as
    dead letters until their item has one."""
    from plantops.session import sub_dir
    from plantops.streaming.checklist_stream import open_rejects
    erp, (_, _, folder) = _run_stream(spark, sf_dir)
    return open_rejects(erp, sub_dir(folder, "sink"), AS_OF)


def _register_stream():
    from plantops.plans.registry import QUERIES, ORACLES, with_views
    QUERIES["checklist_stream"] = checklist_stream
    ORACLES["checklist_stream"] = with_views(_cl_sql("""
SELECT h.*, CAST(row_number() OVER (ORDER BY reference, grb_nomrn_no_date, line_idx) AS BIGINT) AS seq,
       printf('CL/24-25/%04d', row_number() OVER (ORDER BY reference, grb_nomrn_no_date, line_idx)) AS name
FROM cl_headers h"""))
    QUERIES["checklist_stream_rejects"] = checklist_stream_rejects
    ORACLES["checklist_stream_rejects"] = ORACLES["checklist_rejects"]


_register_stream()
