"""Fixed values the results depend on.  Kept as plain text, in the order the
ERP schema declares them.  Small literal frames built from them are
broadcast-safe: their size is fixed here, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: checklist row "parameters" select options (schema order;
# "Party COA" appears twice in the schema) -----------------------------------
CHECKLIST_PARAMETERS = [
    "Physical condition of the vehicle",
    "Ant other material accompanied with the PM",
    "Visual / Physical Inspection",
    "Detail on Received Bags",
    "Material",
    "Source & Grade",
    "Packing Condition",
    "Packing Quality",
    "Dimension",
    "Physical Condition of Packing  Materials",
    "Foreign Particles present on Packing Material",
    "Dust Particles present on Packing Material",
    "Physical Verification",
    "Receive Lot No.",
    "Received Packing Material (in Nos./Bundles/Bag)",
    "Party COA",
    "Arrangement of PM (Bundles/Bags) on Pallets",
    "Any Rejected Packing aterial",
    "Weight per Bags/Liter/Kg per can",
    "Weighing of Bags (Randomly any five bags/ five can)",
    "Any other offensive smell/odor from vehicle",
    "Material receive on pallets",
    "Pallets made up to wood",
    "Are the wooden pallets heat treated",
    "Physical condition of bags",
    "Foreign particles presents on RM bags",
    "Dust particles presents on RM bags",
    "Leakage in can",
    "Received Lot No.",
    "Received Bags/ Cans (in No)",
    "Party COA",
    "Arrangement of RM Bags on pallets",
    "Any Rejected RM Bags",
    "Details on Received Packing Materials",
    "Product Name",
    "Any Rejected Material",
    "Received Packing Material(in Nos./Bundles/Bags)",
]

# --- fixed values: checklist row "observation" select options ---------------
CHECKLIST_OBSERVATIONS = [
    "Ok", "Not Ok", "Yes", "No", "Received", "Not Received", "Found",
    "Not Found", "Normal", "Damaged Condition", "Received", "Missing",
    "Properly arranged",
]

# --- fixed values: SOP department select options ----------------------------
SOP_DEPARTMENTS = ["", "QA", "QC"]

# --- fixed values: names used by the checklist rules ------------------------
CHECKLISTS_WITH_EDITS = ["Raw Material", "Packing Material"]
PARAM_SOURCE_GRADE = "Source & Grade"
PARAM_MATERIAL = "Material"
PARAM_LOT = "Received Lot No."
PARAM_BAGS = "Received Bags/ Cans (in No)"

# --- fixed values: document types and their checklist transaction type ------
DOCTYPE_PR = "Purchase Receipt"
DOCTYPE_DN = "Delivery Note"
DOCTYPE_SCR = "Subcontracting Receipt"
TRANSACTION_TYPES = {DOCTYPE_PR: "Inward", DOCTYPE_DN: "Outward", DOCTYPE_SCR: "Subcontracting"}

# --- fixed values: report/API literals --------------------------------------
STATUS_TO_RECEIVE_AND_BILL = "To Receive and Bill"
SE_TRANSFER_FOR_MANUFACTURE = "Material Transfer for Manufacture"
SLUG_GROUP = "Aluminum slug"
TAX_PACKING = "Packing Charges - SEP"
TAX_INSURANCE = "INSURANCE - SEP"
TAX_FREIGHT = "Freight and Forwarding Charges - SEP"

# --- fixed values: the eight PMC child tables (all of type Aluminium Slug) --
PMC_SECTIONS = [
    ("aluminium_slug", "Aluminium Slug"),
    ("lacquer_requirement", "Lacquer Requirement"),
    ("coating_requirement", "Coating Requirement"),
    ("printing_requirement", "Printing Requirement"),
    ("latex_requirement", "Latex Requirement"),
    ("cap_requirement", "Cap Requirement"),
    ("packaging_requirement", "Packaging Requirement"),
    ("outer_packaging_requirement", "Outer Packaging Requirement"),
]

# --- fixed values: the item spec card (Item field -> card field) ------------
ITEM_SPEC_FIELDS = [
    ("custom_tube_dia", "tube_dia"),
    ("custom_wall_thickness", "wall_thickness"),
    ("custom_body_length", "body_length"),
    ("custom_nozzle_type", "nozzle_type"),
    ("custom_nozzle_length", "nozzle_length"),
    ("custom_nozzle_dia", "nozzle_dia"),
    ("custom_orifice_dia", "orifice_dia"),
    ("custom_collapsibility", "collapsibility"),
    ("custom_shoulder_thickness", "shoulder_thickness"),
    ("custom_lacquer_porosity", "lacquer_porosity"),
    ("custom_knurling_dia", "knurling_dia"),
    ("custom_thread_height", "thread_height"),
]

# --- fixed values: Purchase Order transport block (PO field -> output) ------
PO_TRANSPORT_FIELDS = [
    ("custom_transporter", "transporter"),
    ("custom_transporter_name", "transporter_name"),
    ("custom_vehicle_no", "vehicle_no"),
    ("custom_transport_receipt_no", "transport_receipt_no"),
    ("custom_transport_receipt_date", "transport_receipt_date"),
    ("custom_distance_in_km", "distance_in_km"),
    ("custom_mode_of_transport", "mode_of_transport"),
    ("custom_gst_vehicle_type", "gst_vehicle_type"),
]

# --- fixed values: Subcontracting Receipt challan block ---------------------
RECEIPT_DETAIL_FIELDS = [
    ("custom_lot_no", "lot_no"),
    ("custom_challan_no", "challan_no"),
    ("custom_challan_date", "challan_date"),
    ("custom_invoice_no", "invoice_no"),
    ("custom_invoice_date", "invoice_date"),
]

# --- test templates (FIXTURES.md): checklist name, row, parameter,
# specification, observation -------------------------------------------------
CHECKLIST_TEMPLATE_ROWS = [
    ("Raw Material", 1, "Material", "-", "Ok"),
    ("Raw Material", 2, "Source & Grade", "-", "Ok"),
    ("Raw Material", 3, "Received Lot No.", "-", "Received"),
    ("Raw Material", 4, "Received Bags/ Cans (in No)", "-", "Yes"),
    ("Raw Material", 5, "Party COA", "-", "Received"),
    ("Packing Material", 1, "Material", "-", "Ok"),
    ("Packing Material", 2, "Packing Quality", "-", "Normal"),
    ("Packing Material", 3, "Received Lot No.", "-", "Received"),
    ("General", 1, "Material", "-", "Ok"),
    ("General", 2, "Received Lot No.", "-", "Not Received"),
    ("General", 3, "Received Lot No.", "-", "Found"),
]

TEMPLATE_SCHEMA = "parent string, idx long, parameters string, specification string, observation string"


def checklist_templates(spark: SparkSession, rows=None) -> DataFrame:
    """Checklist template child rows (``Checklist`` -> ``Checklist Table``)."""
    return spark.createDataFrame(rows or CHECKLIST_TEMPLATE_ROWS, TEMPLATE_SCHEMA)


def domain_frame(spark: SparkSession, field: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(field, v) for v in dict.fromkeys(values)],
                                 "field string, value string")
