"""QC checklists for received and delivered goods (survey C1, J6, D1, P1, N3).

The reference, on insert of a Purchase Receipt / Delivery Note /
Subcontracting Receipt, creates one Checklist Transaction per line from
the item's checklist template.  Here that runs for all documents at once:

* the template is tiny configuration, so everything a template decides
  ("which rows become header fields, which observation is the last one")
  is computed on the template first, per checklist;
* document lines then meet that summary and the template rows through
  equi-joins on the checklist name, for which they are broadcast, so there is no shuffle of the expanded rows and no per-line grouping.

Checklist key: ``(reference, grb_nomrn_no_date, line_idx)`` = (doctype,
document name, line idx).  Case-sensitive text comparisons throughout.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantops.functions.scalars import as_date, non_blank
from plantops.sources import fixed
from plantops.sources.erp import Erp

KEY = ["reference", "grb_nomrn_no_date", "line_idx"]


@dataclass
class Checklists:
    headers: DataFrame
    rows: DataFrame
    rejects: DataFrame
    print_rows: DataFrame  # rows with their header's product and total_qty
    rejected_lines: DataFrame  # the rejected lines as document_lines() gives them


def template_summary(templates: DataFrame) -> DataFrame:
    """Per checklist: does it carry the promoted parameters, and which
    observation wins (last row by idx) for each."""
    p = F.col("parameters")

    def last_obs(param):
        return F.max_by(F.col("observation"), F.when(p == param, F.col("idx")))

    return templates.groupBy(F.col("parent").alias("_cl")).agg(
        F.max((p == fixed.PARAM_LOT).cast("int")).alias("_has_lot"),
        last_obs(fixed.PARAM_LOT).alias("_lot_obs"),
        F.max((p == fixed.PARAM_BAGS).cast("int")).alias("_has_bags"),
        last_obs(fixed.PARAM_BAGS).alias("_bags_obs"))


def template_rows(templates: DataFrame) -> DataFrame:
    """Template rows that stay child rows, renumbered 1..k in template order.
    The window runs over the template (configuration, bounded)."""
    kept = templates.where(~F.coalesce("parameters", F.lit("")).isin(fixed.PARAM_LOT, fixed.PARAM_BAGS))
    w = Window.partitionBy("parent").orderBy("idx")
    return kept.select(F.col("parent").alias("_tcl"), F.row_number().over(w).cast("long").alias("idx"),
                       "parameters", "specification", "observation")


def document_lines(erp: Erp) -> DataFrame:
    """Lines of every receipt/delivery document with the header fields; the
    party name is looked up per header first."""
    sup = erp.supplier.select(F.col("name").alias("_sup"), "supplier_name")
    cust = erp.customer.select(F.col("name").alias("_cust"), "customer_name")
    d = (erp.unnumbered("doc").select("name", "doctype", "supplier", "customer", "posting_date")
            .join(sup, F.col("supplier") == F.col("_sup"), "left")
            .join(cust, F.col("customer") == F.col("_cust"), "left")
            .drop("_sup", "_cust", "supplier", "customer"))
    # names are unique for each doctype only: rows meet on the name, by which
    # lines are stored, and the type is compared where they meet (not as a
    # second key of the join, for which both sides would be dealt anew)
    typed = "parenttype" in erp.doc_item.columns
    i = erp.doc_item.select("parent", *["parenttype"] * typed, "idx", "item_code", "item_name", "qty", "batch_no", "lot_no",
                            "custom_box_no", "custom_supplier_batch_no", "custom_actual_consumed_qty")
    same_type = (i["parenttype"] <= d["doctype"]) & (i["parenttype"] >= d["doctype"]) if typed else F.lit(True)
    return i.join(d, (i["parent"] == d["name"]) & same_type, "inner").drop("parent", "parenttype")


def checklist_transactions(erp: Erp, as_of: dt.date | str, abort_document: bool = False, lines: DataFrame | None = None) -> Checklists:
    """C1 for every document line (or for ``lines``, as :func:`document_lines`
    gives them; the item's checklist is looked up here).

    ``rejects``: lines whose item has no checklist (or names a template that
    does not exist) -- the reference aborts on them.  With
    ``abort_document=True`` the lines from the first rejected line of a
    document on are dropped too, which is what the reference leaves behind
    (earlier lines were already committed).
    """
    bare = document_lines(erp) if lines is None else lines
    item = erp.item.select(F.col("name").alias("_item"), "custom_checklist", "item_group")
    lines = bare.join(item, F.col("item_code") == F.col("_item"), "left").drop("_item")
    tmpl = erp.checklist_template
    # broadcast: configuration; a join on the few checklist names would deal all lines into as few tasks
    summary = F.broadcast(template_summary(tmpl))

    known = lines.join(summary, F.col("custom_checklist") == F.col("_cl"), "inner")
    rejected = lines.join(F.broadcast(summary.select("_cl")), F.col("custom_checklist") == F.col("_cl"), "left_anti")
    rejects = (rejected
                    .select(F.col("doctype").alias("reference"), F.col("name").alias("grb_nomrn_no_date"),
                            F.col("idx").alias("line_idx"), "item_code", "custom_checklist",
                            F.when(non_blank("custom_checklist"), F.lit("checklist not found"))
                             .otherwise(F.lit("no checklist on item")).alias("reason")))
    if abort_document:
        first_bad = rejects.groupBy(F.col("reference").alias("_bad_type"), F.col("grb_nomrn_no_date").alias("_bad_doc")).agg(
            F.min("line_idx").alias("_first_bad"))
        known = (known.join(first_bad, (F.col("name") == F.col("_bad_doc")) & (F.col("doctype") == F.col("_bad_type")), "left")
                      .where(F.col("_first_bad").isNull() | (F.col("idx") < F.col("_first_bad")))
                      .drop("_bad_type", "_bad_doc", "_first_bad"))

    dtp = F.col("doctype")
    is_pr, is_dn, is_scr = dtp == fixed.DOCTYPE_PR, dtp == fixed.DOCTYPE_DN, dtp == fixed.DOCTYPE_SCR
    edits = F.col("custom_checklist").isin(*fixed.CHECKLISTS_WITH_EDITS)
    ttype = F.lit(None).cast("string")
    for doctype, t in fixed.TRANSACTION_TYPES.items():
        ttype = F.when(dtp == doctype, F.lit(t)).otherwise(ttype)

    headers = known.select(
        F.col("doctype").alias("reference"),
        F.col("name").alias("grb_nomrn_no_date"),
        F.col("idx").alias("line_idx"),
        F.col("item_code").alias("product"),
        F.col("custom_checklist").alias("checklist"),
        ttype.alias("transaction_type"),
        F.when(is_pr | is_scr, F.col("supplier_name")).when(is_dn, F.col("customer_name"))
         .alias("supplier_or_customer"),
        F.when(is_pr | is_scr, F.col("posting_date")).alias("purchase_date"),
        F.when(is_scr, F.col("custom_actual_consumed_qty")).otherwise(F.col("qty")).cast("double")
         .alias("total_qty"),
        F.when(is_pr, F.col("lot_no")).alias("lot_no"),
        F.when(is_pr, F.col("custom_box_no")).alias("box_no"),
        F.when(is_pr, F.col("custom_supplier_batch_no")).otherwise(F.col("batch_no")).alias("custom_batch_no"),
        F.when(F.col("_has_lot") == 1, F.when(edits & is_pr, F.col("lot_no")).otherwise(F.col("_lot_obs")))
         .alias("received_lot_no"),
        F.when(F.col("_has_bags") == 1, F.col("_bags_obs")).alias("received_bags"),
        as_date(as_of).alias("transaction_date"),
        F.lit(0).alias("docstatus"))

    trows = F.broadcast(template_rows(tmpl))
    p = F.col("parameters")
    rows = known.select("doctype", "name", F.col("idx").alias("line_idx"), "item_code", "item_name",
                        "item_group", "custom_checklist", "qty", "custom_actual_consumed_qty")
    rows = rows.join(trows, F.col("custom_checklist") == F.col("_tcl"), "inner")
    is_pr_r = F.col("doctype") == fixed.DOCTYPE_PR
    edits_r = F.col("custom_checklist").isin(*fixed.CHECKLISTS_WITH_EDITS)
    rows = rows.select(
        F.col("doctype").alias("reference"),
        F.col("name").alias("grb_nomrn_no_date"),
        "line_idx", "idx", "parameters",
        F.when(edits_r & is_pr_r & (p == fixed.PARAM_SOURCE_GRADE), F.col("item_name"))
         .when(edits_r & (p == fixed.PARAM_MATERIAL), F.col("item_group"))
         .otherwise(F.col("specification")).alias("specification"),
        "observation",
        F.col("item_code").alias("product"),
        F.when(F.col("doctype") == fixed.DOCTYPE_SCR, F.col("custom_actual_consumed_qty")).otherwise(F.col("qty")).cast("double").alias("total_qty"))
    return Checklists(headers, rows.drop("product", "total_qty"), rejects, rows, rejected.select(*bare.columns))


def item_checklist(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Each item's checklist template rows."""
    i = items.select(F.col("name").alias("item_code"), F.col("custom_checklist").alias("checklist"))
    t = templates.select(F.col("parent").alias("_tcl"), "idx", "parameters", "specification", "observation")
    return i.join(t, F.col("checklist") == F.col("_tcl"), "inner").drop("_tcl")


def docs_with_draft_checklists(docs: DataFrame, checklist_tx: DataFrame) -> DataFrame:
    """Documents that still have an unsubmitted (draft) checklist."""
    drafts = checklist_tx.where(F.col("docstatus") == 0).select("grb_nomrn_no_date", "reference").distinct()
    d = docs.select("name", "doctype")
    return d.join(drafts, (d["name"] == drafts["grb_nomrn_no_date"]) & (d["doctype"] == drafts["reference"]),
                  "left_semi")


def print_checklist(cl: Checklists) -> DataFrame:
    """Checklist print dataset: header fields + numbered rows.  The
    print template reads ``doc.supplier``, not a field of the checklist, so
    that cell is empty (NULL)."""
    return cl.print_rows.select(
        *KEY, "product", F.lit(None).cast("string").alias("supplier"), "total_qty",
        F.col("idx").alias("sr_no"), "parameters", "specification", "observation")
