"""The FIXTURES.md mapping written once more as DuckDB SQL, for the oracles.

``with_views(body)`` prefixes an oracle query with exactly the CTEs it (and
their dependencies) mention, so every oracle string runs on the raw
pre-registered tables.
"""

from __future__ import annotations

import re

from plantops.sources import fixed

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docstatus(col: str) -> str:
    return f"CAST(CASE {col} WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS INTEGER)"


_SECTIONS_CASE = "CASE l_suppkey % 8 " + " ".join(
    f"WHEN {i} THEN {_q(f)}" for i, (f, _) in enumerate(fixed.PMC_SECTIONS)) + " END"

_TEMPLATE_VALUES = ", ".join(
    f"({_q(p)}, CAST({i} AS BIGINT), {_q(a)}, {_q(s)}, {_q(o)})"
    for p, i, a, s, o in fixed.CHECKLIST_TEMPLATE_ROWS)

VIEWS: dict[str, str] = {
    "v_lines": f"""SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS BIGINT) AS idx
        FROM lineitem""",
    "v_sales_order": f"""SELECT o_orderkey AS name, o_custkey AS customer, {_docstatus('o_orderstatus')} AS docstatus,
        CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderdate AS DATE) + 30 AS delivery_date,
        'CPO-' || CAST(o_orderkey AS VARCHAR) AS po_no, CAST(o_orderdate AS DATE) - 7 AS po_date
        FROM orders""",
    "v_sales_order_item": """SELECT l.l_orderkey AS parent, l.idx, l.l_partkey AS item_code, p.p_name AS item_name,
        l.l_quantity AS qty, p.p_retailprice AS rate, l.l_extendedprice AS amount
        FROM v_lines l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_item": """SELECT p_partkey AS name, p_name AS item_name, p_type AS item_group,
        CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS min_order_qty,
        CASE p_type WHEN 'STANDARD' THEN 'Raw Material' WHEN 'SMALL' THEN 'Packing Material'
             WHEN 'PROMO' THEN NULL ELSE 'General' END AS custom_checklist,
        '7612' || CAST(p_size % 10 AS VARCHAR) AS gst_hsn_code,
        CAST(p_size AS VARCHAR) AS custom_tube_dia,
        CAST(p_size % 7 AS VARCHAR) AS custom_wall_thickness,
        CAST(p_size * 10 AS VARCHAR) AS custom_body_length,
        CASE p_partkey % 3 WHEN 0 THEN 'Plain' WHEN 1 THEN 'Conical' ELSE 'Round' END AS custom_nozzle_type,
        CAST(p_size % 4 + 5 AS VARCHAR) AS custom_nozzle_length,
        CAST(p_size % 3 + 6 AS VARCHAR) AS custom_nozzle_dia,
        CAST(p_size % 5 + 2 AS VARCHAR) AS custom_orifice_dia,
        CASE WHEN p_size % 2 = 0 THEN 'Good' ELSE 'Normal' END AS custom_collapsibility,
        CAST(p_size % 6 + 1 AS VARCHAR) AS custom_shoulder_thickness,
        p_brand AS custom_lacquer_porosity,
        CAST(p_size % 8 AS VARCHAR) AS custom_knurling_dia,
        CAST(p_size % 9 AS VARCHAR) AS custom_thread_height,
        CASE WHEN p_partkey % 4 <> 0 THEN 'SPEC-' || CAST(p_partkey // 2 AS VARCHAR) END AS custom_specification_number,
        DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) AS custom_effective_date
        FROM part""",
    "v_purchase_order": f"""SELECT 'PUR-ORD-2024-' || CAST(x.l_orderkey AS VARCHAR) || '-' || CAST(x.l_suppkey AS VARCHAR) AS name,
        x.l_suppkey AS supplier,
        CASE o.o_orderstatus WHEN 'O' THEN {_q(fixed.STATUS_TO_RECEIVE_AND_BILL)} WHEN 'P' THEN 'To Bill' ELSE 'Completed' END AS status,
        CAST(o.o_orderdate AS DATE) AS transaction_date,
        'TR-' || CAST(x.l_suppkey % 7 AS VARCHAR) AS custom_transporter,
        'Transporter ' || CAST(x.l_suppkey % 7 AS VARCHAR) AS custom_transporter_name,
        'GJ-21-' || CAST(x.l_orderkey % 1000 AS VARCHAR) AS custom_vehicle_no,
        'LR-' || CAST(x.l_orderkey AS VARCHAR) AS custom_transport_receipt_no,
        CAST(o.o_orderdate AS DATE) + 2 AS custom_transport_receipt_date,
        CAST((x.l_suppkey % 50) * 10 AS INTEGER) AS custom_distance_in_km,
        CASE WHEN x.l_suppkey % 4 = 0 THEN 'Rail' ELSE 'Road' END AS custom_mode_of_transport,
        CASE WHEN x.l_orderkey % 2 = 0 THEN 'Regular' ELSE 'Over Dimensional Cargo' END AS custom_gst_vehicle_type
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x JOIN orders o ON x.l_orderkey = o.o_orderkey""",
    "v_purchase_order_item": """SELECT 'PUR-ORD-2024-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS parent,
        CAST(row_number() OVER (PARTITION BY l.l_orderkey, l.l_suppkey
             ORDER BY l.l_linenumber, l.l_partkey, l.l_quantity, l.l_extendedprice) AS BIGINT) AS idx,
        l.l_partkey AS item_code, l.l_quantity AS qty, p.p_retailprice AS rate, l.l_extendedprice AS amount,
        'Nos' AS uom, CAST(l.l_shipdate AS DATE) AS expected_delivery_date
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_stock_entry": f"""SELECT o_orderkey AS name, CAST(o_orderdate AS DATE) AS posting_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN {_q(fixed.SE_TRANSFER_FOR_MANUFACTURE)} WHEN '2-HIGH' THEN 'Manufacture'
             ELSE 'Material Receipt' END AS stock_entry_type,
        CASE o_orderpriority WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN NULL
             ELSE 'WO-' || CAST(o_custkey AS VARCHAR) END AS work_order,
        {_docstatus('o_orderstatus')} AS docstatus
        FROM orders""",
    "v_stock_entry_detail": """SELECT l_orderkey AS parent, idx, l_partkey AS item_code, l_quantity AS qty,
        'B' || CAST(l_suppkey AS VARCHAR) AS batch_no FROM v_lines""",
    "v_work_order": """SELECT 'WO-' || CAST(c_custkey AS VARCHAR) AS name, c_custkey AS production_item,
        CASE WHEN c_custkey % 2 = 0 THEN 'Work Order' ELSE 'Job Card' END AS transfer_material_against
        FROM customer WHERE c_custkey % 10 <> 0""",
    "v_production_qc": """SELECT 'PQC-' || CAST(c_custkey AS VARCHAR) AS name, 'WO-' || CAST(c_custkey AS VARCHAR) AS reference_name,
        CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 ELSE c_custkey END AS item_code,
        CAST(c_custkey % 3 AS INTEGER) AS docstatus
        FROM customer WHERE c_custkey % 4 <> 0""",
    "v_bin": """SELECT CAST(l_partkey AS VARCHAR) || '-W' || CAST(wh AS VARCHAR) AS name, l_partkey AS item_code,
        'W' || CAST(wh AS VARCHAR) AS warehouse, actual_qty, modified
        FROM (SELECT l_partkey, l_suppkey % 5 AS wh,
                     CAST(SUM(CAST(l_quantity AS DECIMAL(21,9))) AS DOUBLE) AS actual_qty, MAX(l_shipdate) AS modified
              FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY l_partkey, l_suppkey % 5)""",
    "v_weekly_production_plan": """SELECT 'WPP-' || CAST(o.o_orderkey AS VARCHAR) || '-' || CAST(l.idx AS VARCHAR) AS name, o.o_orderkey AS sales_order,
        o.o_orderpriority AS line,
        CASE WHEN o.o_orderkey % 7 = 0 THEN CAST(-1 AS BIGINT) ELSE l.l_partkey END AS item_name,
        CAST(p.p_size AS VARCHAR) AS tube, '10000' AS capacity_per_day
        FROM orders o JOIN v_lines l ON l.l_orderkey = o.o_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey
        WHERE o.o_orderstatus = 'O'""",
    "v_item_price": """SELECT 'IPS-' || CAST(p_partkey AS VARCHAR) AS name, p_partkey AS item_code,
             'Standard Selling' AS price_list, p_retailprice AS price_list_rate, DATE '2000-01-01' AS valid_from FROM part
        UNION ALL
        SELECT 'IPB-' || CAST(p_partkey AS VARCHAR), p_partkey, 'Standard Buying',
             CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice END, DATE '2000-01-01' FROM part""",
    "v_item_default": """SELECT l_partkey AS parent,
        CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS BIGINT) AS idx,
        CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE l_suppkey END AS default_supplier
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""",
    "v_item_supplier": """SELECT l_partkey AS parent, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS BIGINT) AS idx,
        l_suppkey AS supplier FROM (SELECT DISTINCT l.l_partkey, l.l_suppkey
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_type <> 'LARGE')""",
    "v_supplier": "SELECT s_suppkey AS name, s_name AS supplier_name FROM supplier",
    "v_customer": "SELECT c_custkey AS name, c_name AS customer_name FROM customer",
    "v_doc": f"""SELECT 'D-' || CAST(o_orderkey AS VARCHAR) AS name,
        CASE o_orderkey % 3 WHEN 0 THEN {_q(fixed.DOCTYPE_PR)} WHEN 1 THEN {_q(fixed.DOCTYPE_DN)}
             ELSE {_q(fixed.DOCTYPE_SCR)} END AS doctype,
        o_custkey % 10 AS supplier, o_custkey AS customer, CAST(o_orderdate AS DATE) AS posting_date,
        {_docstatus('o_orderstatus')} AS docstatus,
        'LOT-' || CAST(o_orderkey AS VARCHAR) AS custom_lot_no,
        'CH-' || CAST(o_orderkey AS VARCHAR) AS custom_challan_no,
        CAST(o_orderdate AS DATE) + 1 AS custom_challan_date,
        'INV-' || CAST(o_orderkey AS VARCHAR) AS custom_invoice_no,
        CAST(o_orderdate AS DATE) + 2 AS custom_invoice_date
        FROM orders""",
    "v_doc_item": f"""SELECT 'D-' || CAST(l.l_orderkey AS VARCHAR) AS parent, CASE l.l_orderkey % 3 WHEN 0 THEN {_q(fixed.DOCTYPE_PR)}
        WHEN 1 THEN {_q(fixed.DOCTYPE_DN)} ELSE {_q(fixed.DOCTYPE_SCR)} END AS parenttype, l.idx, l.l_partkey AS item_code,
        p.p_name AS item_name, l.l_quantity AS qty, 'B' || CAST(l.l_suppkey AS VARCHAR) AS batch_no,
        'L' || CAST(l.l_linenumber AS VARCHAR) AS lot_no, l.l_returnflag AS custom_box_no,
        'SB' || CAST(l.l_suppkey AS VARCHAR) AS custom_supplier_batch_no,
        CAST(ROUND(CAST(l.l_quantity AS DECIMAL(15,2)) * CAST(0.98 AS DECIMAL(3,2)), 3) AS DOUBLE) AS custom_actual_consumed_qty
        FROM v_lines l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_batch": """SELECT 'BATCH-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(idx AS VARCHAR) AS name,
        CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'D-' || CAST(l_orderkey AS VARCHAR) END AS reference_name,
        CASE WHEN idx = 2 AND l_orderkey % 2 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS item,
        'OLD' AS custom_supplier_batch_no, CAST(NULL AS VARCHAR) AS custom_box_no
        FROM v_lines WHERE l_orderkey % 3 = 0""",
    "v_scr_supplied_item": """SELECT 'D-' || CAST(l_orderkey AS VARCHAR) AS parent, idx, l_partkey AS main_item_code,
        CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(21,9)) AS consumed_qty
        FROM v_lines WHERE l_orderkey % 3 = 2""",
    "v_scr_actual_consumed": """SELECT 'D-' || CAST(l_orderkey AS VARCHAR) AS parent, CAST(idx // 2 AS BIGINT) AS idx,
        l_partkey AS item,
        CAST(CAST(l_quantity AS DECIMAL(15,2)) * CAST(0.95 AS DECIMAL(3,2)) AS DECIMAL(21,9)) AS actual_consumed_qty
        FROM v_lines WHERE l_orderkey % 3 = 2 AND idx % 2 = 0""",
    "v_doc_reference": """SELECT 'D-' || CAST(o_orderkey AS VARCHAR) AS parent, CAST(1 AS BIGINT) AS idx,
        'Purchase Order' AS link_doctype, 'PUR-ORD-2024-' || CAST(o_orderkey AS VARCHAR) || '-0' AS link_name
        FROM orders WHERE o_orderkey % 3 = 2""",
    "v_custom_document_reference": """SELECT 'D-' || CAST(l_orderkey AS VARCHAR) AS parent, idx,
        'Purchase Order' AS link_doctype,
        'PUR-ORD-2024-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS link_name
        FROM v_lines WHERE l_orderkey % 3 = 2 AND l_orderkey % 4 <> 0""",
    "v_sales_invoice": """SELECT 'SI-' || CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS customer,
        'ADDR-' || CAST(o_custkey AS VARCHAR) AS customer_address,
        CASE WHEN o_orderkey % 4 = 0 THEN 'ADDR-' || CAST(o_custkey + 1 AS VARCHAR)
             ELSE 'ADDR-' || CAST(o_custkey AS VARCHAR) END AS shipping_address_name,
        CAST(o_orderdate AS DATE) AS posting_date, CAST(o_orderdate AS DATE) + 45 AS due_date,
        CASE WHEN o_orderkey % 8 <> 0 THEN 'IRN-' || CAST(o_orderkey AS VARCHAR) END AS irn,
        'Transporter ' || CAST(o_custkey % 7 AS VARCHAR) AS transporter,
        'GJ-21-' || CAST(o_orderkey % 1000 AS VARCHAR) AS vehicle_no, 'LR-' || CAST(o_orderkey AS VARCHAR) AS lr_no,
        CAST(o_orderdate AS DATE) + 2 AS lr_date, o_orderpriority AS remarks,
        CAST(o_orderkey % 500 AS DOUBLE) AS total_qty, o_totalprice AS total,
        CAST(o_orderkey % 1000 AS DOUBLE) AS total_taxes_and_charges,
        o_totalprice + CAST(o_orderkey % 1000 AS DOUBLE) AS grand_total
        FROM orders""",
    "v_sales_invoice_item": """SELECT 'SI-' || CAST(l.l_orderkey AS VARCHAR) AS parent, l.idx, l.l_partkey AS item_code,
        l.l_orderkey AS sales_order, l.l_suppkey % 12 AS custom_no_of_pkgs, l.l_partkey % 250 AS custom_average_contents_per,
        l.l_quantity AS qty, p.p_retailprice AS rate, l.l_extendedprice AS taxable_value
        FROM v_lines l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_sales_taxes": f"""SELECT 'SI-' || CAST(l_orderkey AS VARCHAR) AS parent,
        CASE l_returnflag WHEN 'R' THEN {_q(fixed.TAX_PACKING)} WHEN 'A' THEN {_q(fixed.TAX_INSURANCE)}
             WHEN 'N' THEN {_q(fixed.TAX_FREIGHT)} END AS account_head,
        CAST(SUM(ROUND(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)) AS DOUBLE) AS base_tax_amount
        FROM lineitem GROUP BY l_orderkey, l_returnflag""",
    "v_address": """SELECT 'ADDR-' || CAST(c_custkey AS VARCHAR) AS name,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'GST' || CAST(c_custkey AS VARCHAR) END AS gstin
        FROM customer""",
    "v_pmc": """SELECT 'PMC-' || CAST(p_partkey AS VARCHAR) AS name,
        CASE WHEN p_partkey % 50 = 0 THEN 'PMC-' || CAST(p_partkey - 2 AS VARCHAR)
             ELSE 'PMC-' || CAST(p_partkey AS VARCHAR) END AS pmc_no,
        p_partkey AS product_name, p_partkey AS customer_code,
        CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 17 = 0 THEN p_partkey + 1000000000 ELSE p_partkey END END AS sales_order
        FROM part""",
    "v_checklist": """SELECT 'CHK-' || CAST(p_partkey AS VARCHAR) AS name,
        'Checklist ' || CAST(CASE WHEN p_partkey % 40 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS checklist_name FROM part""",
    "v_workstation": "SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderkey % 5 <> 0",
    "v_employee": "SELECT 'EMP-' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey % 3 <> 0",
    "v_pmc_item": f"""SELECT 'PMC-' || CAST(l_partkey AS VARCHAR) AS parent, parentfield,
        CAST(row_number() OVER (PARTITION BY l_partkey, parentfield ORDER BY l_suppkey) AS BIGINT) AS idx,
        l_partkey + l_suppkey AS raw_material_name, 'Supplier#' || CAST(l_suppkey AS VARCHAR) AS supplier_name
        FROM (SELECT DISTINCT l_partkey, l_suppkey, {_SECTIONS_CASE} AS parentfield
              FROM lineitem)""",
    "v_product_specification": """SELECT 'PS-' || CAST(p_partkey AS VARCHAR) AS name, p_partkey AS item_code,
        CAST(p_size % 4 AS VARCHAR) AS revision_no FROM part""",
    "v_checklist_template": f"""SELECT * FROM (VALUES {_TEMPLATE_VALUES})
        AS t(parent, idx, parameters, specification, observation)""",
    "v_solution_type": """SELECT 'SOP-' || n_name AS name,
        CASE n_regionkey WHEN 0 THEN 'QA' WHEN 1 THEN 'QC' WHEN 2 THEN '' WHEN 3 THEN 'QA/QC' END AS department,
        CASE WHEN n_regionkey <> 4 THEN 'EMP-' || CAST(n_nationkey AS VARCHAR) END AS prepared_by
        FROM nation""",
}

_REF = re.compile(r"\bv_[a-z_]+\b")


def _deps(sql: str) -> list[str]:
    return [m for m in dict.fromkeys(_REF.findall(sql)) if m in VIEWS]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding every view the body needs, in dependency order."""
    views = dict(VIEWS)
    views.update(extra or {})
    order: list[str] = []

    def visit(name: str, stack=()):
        if name in order:
            return
        for d in [m for m in dict.fromkeys(_REF.findall(views[name])) if m in views and m != name]:
            visit(d, stack + (name,))
        order.append(name)

    for name in [m for m in dict.fromkeys(_REF.findall(body)) if m in views]:
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
