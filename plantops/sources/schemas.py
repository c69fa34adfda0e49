"""The input contract: the columns each ERP table must have, and which hold
dates or numbers.  Keys and Data fields may be of any type (an ERP export has
text keys, the test tables have whole numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names in the order of the documents' fields.
COLUMNS: dict[str, str] = {
    "sales_order": "name customer docstatus transaction_date delivery_date po_no po_date",
    "sales_order_item": "parent idx item_code item_name qty rate amount",
    "item": "name item_name item_group min_order_qty custom_checklist gst_hsn_code custom_tube_dia custom_wall_thickness custom_body_length "
            "custom_nozzle_type custom_nozzle_length custom_nozzle_dia custom_orifice_dia custom_collapsibility custom_shoulder_thickness "
            "custom_lacquer_porosity custom_knurling_dia custom_thread_height custom_specification_number custom_effective_date",
    "item_default": "parent idx default_supplier",
    "item_supplier": "parent idx supplier",
    "item_price": "name item_code price_list price_list_rate valid_from",
    "purchase_order": "name supplier status transaction_date custom_transporter custom_transporter_name custom_vehicle_no "
                      "custom_transport_receipt_no custom_transport_receipt_date custom_distance_in_km custom_mode_of_transport custom_gst_vehicle_type",
    "purchase_order_item": "parent idx item_code qty rate amount uom expected_delivery_date",
    "stock_entry": "name posting_date stock_entry_type work_order docstatus",
    "stock_entry_detail": "parent idx item_code qty batch_no",
    "work_order": "name production_item transfer_material_against",
    "production_qc": "name reference_name item_code docstatus",
    "bin": "name item_code warehouse actual_qty modified",
    "weekly_production_plan": "name sales_order line item_name tube capacity_per_day",
    "workstation": "name",
    "employee": "name",
    "supplier": "name supplier_name",
    "customer": "name customer_name",
    "doc": "name doctype supplier customer posting_date docstatus custom_lot_no custom_challan_no custom_challan_date custom_invoice_no custom_invoice_date",
    "doc_item": "parent parenttype idx item_code item_name qty batch_no lot_no custom_box_no custom_supplier_batch_no custom_actual_consumed_qty",
    "batch": "name reference_name item custom_supplier_batch_no custom_box_no",
    "scr_supplied_item": "parent idx main_item_code consumed_qty",
    "scr_actual_consumed": "parent idx item actual_consumed_qty",
    "doc_reference": "parent idx link_doctype link_name",
    "custom_document_reference": "parent idx link_doctype link_name",
    "sales_invoice": "name customer customer_address shipping_address_name posting_date due_date irn transporter vehicle_no lr_no lr_date remarks "
                     "total_qty total total_taxes_and_charges grand_total",
    "sales_invoice_item": "parent idx item_code sales_order custom_no_of_pkgs custom_average_contents_per qty rate taxable_value",
    "sales_taxes": "parent account_head base_tax_amount",
    "address": "name gstin",
    "pmc": "name pmc_no product_name customer_code sales_order",
    "pmc_item": "parent parentfield idx raw_material_name supplier_name",
    "product_specification": "name item_code revision_no",
    "checklist": "name checklist_name",
    "checklist_template": "parent idx parameters specification observation",
    "solution_type": "name department prepared_by",
}
DATES = set("transaction_date delivery_date po_date valid_from posting_date due_date lr_date expected_delivery_date custom_effective_date "
            "custom_transport_receipt_date custom_challan_date custom_invoice_date modified".split())
NUMBERS = set("idx docstatus qty rate amount min_order_qty price_list_rate actual_qty taxable_value base_tax_amount total_qty total "
              "total_taxes_and_charges grand_total".split())


def check(table: str, df: DataFrame) -> DataFrame:
    """``df`` unchanged if it meets the contract of ``table``, else ValueError
    naming what is missing or of a wrong type.  Further columns are allowed;
    a table that the contract does not know has no requirements."""
    have = {f.name: f.dataType for f in df.schema.fields}
    need = COLUMNS.get(table, "").split()
    faults = [f"{c} is missing" for c in need if c not in have]
    faults += [f"{c} is no date" for c in need if c in DATES and c in have and not isinstance(have[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    faults += [f"{c} is no number" for c in need if c in NUMBERS and c in have and not isinstance(have[c], T.NumericType)]
    if faults:
        raise ValueError(f"table {table}: {', '.join(faults)}")
    return df
