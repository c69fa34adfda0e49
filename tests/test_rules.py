"""
no tests; these are the cases its loops decide)."""

import datetime as dt

import pytest
from erp_frames import make_erp

from pyspark.sql import functions as F

from plantops.operators import checklists as C
from plantops.operators import documents as D
from plantops.operators import lookups as K
from plantops.operators import pricing as P
from plantops.operators.lines import latest_bin
from plantops.plans import reports as R

D0 = dt.date(1998, 1, 1)
SO = "name long, customer long, docstatus int, transaction_date date, delivery_date date"
SOI = "parent long, idx long, item_code long, item_name string, qty double, rate double, amount double"
ITEM = ("name long, item_name string, item_group string, min_order_qty double, custom_checklist string, "
        "custom_tube_dia string, custom_lacquer_porosity string")


def _items():
    return ([(10, "ten", "G", 5.0, "Raw Material", "19", "B1"),
             (11, "eleven", "G", None, "General", "22", "B2"),
             (12, "twelve", "PM", 1.0, "Packing Material", "25", "B3"),
             (13, "thirteen", "X", None, None, "30", "B4"),
             (14, "fourteen", "X", None, "Nope", "30", "B4")], ITEM)


@pytest.fixture(scope="module")
def sales(spark):
    return make_erp(spark, {
        "sales_order": ([(1, 100, 1, D0, dt.date(1998, 1, 11)),
                         (2, 200, 1, D0, dt.date(1997, 12, 1)),      # submitted, no lines
                         (3, 300, 0, D0, dt.date(1998, 2, 1))], SO),  # draft
        "sales_order_item": ([(1, 1, 10, "ten", 10.0, 1.0, 10.0),
                              (1, 2, 11, "eleven", 20.0, 1.0, 20.0),
                              (1, 3, 99, "ghost", 30.0, 1.0, 30.0),   # item missing from Item
                              (1, 4, 11, "eleven", 5.0, 1.0, 5.0),    # duplicate item: first wins
                              (3, 1, 10, "ten", 7.0, 1.0, 7.0)], SOI),
        "item": _items(),
        "weekly_production_plan": ([("P1", 1, "L1", 11, "22"), ("P2", 1, "L1", 77, "x"), ("P3", 9, "L2", 11, "y")],
                                   "name string, sales_order long, line string, item_name long, tube string"),
        "stock_entry": ([(1, D0, "Material Transfer for Manufacture", "WO-1"),
                         (2, D0, "Material Transfer for Manufacture", None),
                         (3, D0, "Manufacture", ""),
                         (4, D0, "Material Receipt", "WO-X")],
                        "name long, posting_date date, stock_entry_type string, work_order string"),
        "stock_entry_detail": ([(1, 1, 11, 3.0, "B1"), (2, 1, 11, 4.0, "B2"), (3, 1, 11, 100.0, "B3"),
                                (4, 1, 10, 1.0, "B4")],
                               "parent long, idx long, item_code long, qty double, batch_no string"),
        "work_order": ([("WO-1", 10, "Job Card")], "name string, production_item long, transfer_material_against string"),
    })


def test_production_planning_first_last_and_missing_item(sales):
    rows = R.production_planning(sales, D0).collect()
    assert len(rows) == 4                       # only order 1: order 2 has no lines, order 3 is a draft
    by_code = sorted(rows, key=lambda r: (r.product_code, r.po_qty))
    assert sum(r.customer_name is not None for r in rows) == 1
    first = [r for r in rows if r.customer_name is not None][0]
    assert first.product_code == 10 and first.customer_name == 100
    totals = [r.customer_total_qty for r in rows if r.customer_total_qty is not None]
    assert totals == [pytest.approx(65 * 1.05)]
    last = [r for r in rows if r.customer_total_qty is not None][0]
    assert last.po_qty == 5.0                   # idx 4 is the last line
    ghost = [r for r in by_code if r.product_code == 99][0]
    assert ghost.tube_size is None and ghost.lac_un is None
    assert all(r.days_left == 10 for r in rows)
    assert all(r.excess_add_5 == r.po_qty * 0.05 + r.po_qty for r in rows)


def test_weekly_plan_first_match_and_printed(sales):
    rows = {r.tube: r for r in R.weekly_production_plan(sales).collect()}
    assert rows["22"].planned == 20.0 * 0.05 + 20.0    # first line with item 11, not the later 5.0
    assert rows["22"].printed == 7.0                   # transfers only, drafts included
    assert rows["x"].planned == 0.0 and rows["x"].printed == 0.0
    assert rows["y"].planned == 0.0                    # order 9 does not exist: 0, not an error
    assert rows["y"].printed == 7.0                    # same item shows its full total again
    assert rows["22"].over_excess_production == 7.0 - 21.0
    assert rows["22"].set_time is None and rows["22"].work_day == 1


def test_daily_production_blank_and_dangling_work_orders(sales):
    rows = R.daily_production(sales).collect()
    assert sorted(r.product_name for r in rows) == [10, 11]   # NULL and "" work orders are out
    ops = {r.product_name: r.opration_name for r in rows}
    assert ops[11] == "Job Card" and ops[10] is None           # WO-X does not exist
    assert all(r.qty_rejected == 0 and r.lot_no == 0 for r in rows)


def test_sales_order_lines_all_orders(sales):
    rows = R.sales_order_lines(sales).collect()
    assert len(rows) == 5
    assert sorted(r.so_name for r in rows if r.customer is not None) == [1, 3]


def test_slug_reconciliation(spark):
    erp = make_erp(spark, {
        "item": _items(),
        "bin": ([("10-W1", 10, "W1", 4.125, dt.datetime(1998, 1, 2)),
                 ("10-W0", 10, "W0", 9.0, dt.datetime(1998, 1, 2)),    # tie on modified: name decides
                 ("10-W2", 10, "W2", 100.0, dt.datetime(1997, 1, 1))],
                "name string, item_code long, warehouse string, actual_qty double, modified timestamp_ntz"),
        "purchase_order": ([("PO1", 3, "To Receive and Bill"), ("PO2", 3, "To Bill")],
                           "name string, supplier long, status string"),
        "purchase_order_item": ([("PO1", 1, 10, 2.5), ("PO1", 2, 10, 0.125), ("PO2", 1, 10, 50.0)],
                                "parent string, idx long, item_code long, qty double"),
    })
    rows = {r.item: r for r in R.slug_reconciliation(erp, item_group="G").collect()}
    assert set(rows) == {10, 11}
    assert rows[10].stock == 9.0 and rows[10].pending_po == 2.625
    assert rows[10].total == 9.0 + 2.62                # flt(x, 2): half to even, then float addition
    assert rows[10].minimum_stock == 5.0
    assert (rows[11].stock, rows[11].pending_po, rows[11].total, rows[11].minimum_stock) == (0, 0, 0, 0)
    summed = {r.item: r for r in R.slug_reconciliation(erp, item_group="G", stock_scope="sum").collect()}
    assert summed[10].stock == 113.125


def test_price_revision(spark):
    erp = make_erp(spark, {
        "item_price": ([("a", 1, "Standard Buying", 10.0, D0), ("a2", 1, "Standard Buying", 11.0, D0),
                        ("b", 2, "Standard Buying", 0.0, D0), ("c", 3, "Standard Buying", 7.0, D0),
                        ("d", 1, "Standard Selling", 20.0, D0)],
                       "name string, item_code long, price_list string, price_list_rate double, valid_from date"),
        "item_default": ([(1, 1, 3), (1, 2, 3), (2, 1, 3), (3, 1, None), (3, 2, 4)],
                         "parent long, idx long, default_supplier long"),
    })
    new = {r.name: r for r in P.price_revision(erp.item_price, erp.item_default, 3, "Standard Buying", "2.5",
                                               dt.date(2024, 1, 1)).collect()}
    assert new["a"].price_list_rate == 12.5 and new["a"].valid_from == dt.date(2024, 1, 1)
    assert new["a2"].price_list_rate == 13.5          # duplicate price row: once each
    assert new["b"].price_list_rate == 0.0 and new["b"].valid_from == D0   # zero rate skipped
    assert new["c"].price_list_rate == 7.0
    assert new["d"].price_list_rate == 20.0
    items = P.supplier_items(erp.item_price, erp.item_default, 3, "Standard Buying").collect()
    assert sorted(r.name for r in items) == ["a", "a2", "b"]


@pytest.fixture(scope="module")
def receipts(spark):
    doc = "name string, doctype string, supplier long, customer long, posting_date date"
    di = ("parent string, idx long, item_code long, item_name string, qty double, batch_no string, lot_no string, "
          "custom_box_no string, custom_supplier_batch_no string, custom_actual_consumed_qty double")
    return make_erp(spark, {
        "doc": ([("PR1", "Purchase Receipt", 1, 50, D0), ("DN1", "Delivery Note", 1, 50, D0),
                 ("SCR1", "Subcontracting Receipt", 2, 50, D0), ("PR2", "Purchase Receipt", 1, 50, D0)], doc),
        "doc_item": ([("PR1", 1, 10, "ten", 5.0, "B1", "L1", "BX", "SB1", 4.9),
                      ("DN1", 1, 11, "eleven", 6.0, "B2", "L2", "BY", "SB2", 5.9),
                      ("SCR1", 1, 12, "twelve", 7.0, "B3", "L3", "BZ", "SB3", 6.9),
                      ("PR2", 1, 10, "ten", 1.0, "B4", None, "BW", "SB4", 1.0),
                      ("PR2", 2, 13, "thirteen", 1.0, "B5", "L5", "BV", "SB5", 1.0),   # no checklist
                      ("PR2", 3, 14, "fourteen", 1.0, "B6", "L6", "BU", "SB6", 1.0),   # unknown checklist
                      ("PR2", 4, 11, "eleven", 1.0, "B7", "L7", "BT", "SB7", 1.0)], di),
        "item": _items(),
        "supplier": ([(1, "Sup One"), (2, "Sup Two")], "name long, supplier_name string"),
        "customer": ([(50, "Cust Fifty")], "name long, customer_name string"),
    })


def test_checklist_header_cells(receipts):
    cl = C.checklist_transactions(receipts, D0)
    h = {(r.grb_nomrn_no_date, r.line_idx): r for r in cl.headers.collect()}
    pr = h[("PR1", 1)]
    assert (pr.transaction_type, pr.supplier_or_customer, pr.purchase_date) == ("Inward", "Sup One", D0)
    assert (pr.total_qty, pr.lot_no, pr.box_no, pr.custom_batch_no) == (5.0, "L1", "BX", "SB1")
    assert pr.received_lot_no == "L1" and pr.received_bags == "Yes"      # PR + Raw Material: lot edited
    dn = h[("DN1", 1)]
    assert (dn.transaction_type, dn.supplier_or_customer, dn.purchase_date) == ("Outward", "Cust Fifty", None)
    assert (dn.lot_no, dn.box_no, dn.custom_batch_no) == (None, None, "B2")
    assert dn.received_lot_no == "Found" and dn.received_bags is None   # General: last row wins
    scr = h[("SCR1", 1)]
    assert (scr.transaction_type, scr.supplier_or_customer, scr.total_qty) == ("Subcontracting", "Sup Two", 6.9)
    assert scr.received_lot_no == "Received"                             # not a PR: template value
    assert h[("PR2", 1)].received_lot_no is None                         # edited to the line's NULL lot
    assert all(r.transaction_date == D0 and r.docstatus == 0 for r in h.values())


def test_checklist_rows_edits(receipts):
    cl = C.checklist_transactions(receipts, D0)
    rows = {}
    for r in cl.rows.collect():
        rows.setdefault((r.grb_nomrn_no_date, r.line_idx), []).append(r)
    pr = sorted(rows[("PR1", 1)], key=lambda r: r.idx)
    assert [r.parameters for r in pr] == ["Material", "Source & Grade", "Party COA"]
    assert [r.idx for r in pr] == [1, 2, 3]
    assert pr[0].specification == "G" and pr[1].specification == "ten"
    dn = sorted(rows[("DN1", 1)], key=lambda r: r.idx)
    assert [(r.parameters, r.specification) for r in dn] == [("Material", "-")]    # General: no edits
    scr = sorted(rows[("SCR1", 1)], key=lambda r: r.idx)
    assert [(r.parameters, r.specification) for r in scr] == [("Material", "PM"), ("Packing Quality", "-")]


def test_checklist_rejects_and_abort(receipts):
    cl = C.checklist_transactions(receipts, D0)
    rej = {(r.grb_nomrn_no_date, r.line_idx): r.reason for r in cl.rejects.collect()}
    assert rej == {("PR2", 2): "no checklist on item", ("PR2", 3): "checklist not found"}
    assert cl.headers.count() + cl.rejects.count() == receipts.doc_item.count()
    kept = C.checklist_transactions(receipts, D0, abort_document=True).headers
    assert sorted(r.line_idx for r in kept.where("grb_nomrn_no_date = 'PR2'").collect()) == [1]


def test_item_suppliers_fallback_marker(spark):
    items = spark.createDataFrame([(1,), (2,)], "name long")
    sup = spark.createDataFrame([(1, 1, 8), (1, 2, 7), (1, 3, 8)], "parent long, idx long, supplier long")
    got = sorted(K.item_suppliers(items, sup).collect(), key=lambda r: (r.item_code, r.position or 0))
    assert [(r.item_code, r.position, r.supplier, r.all_suppliers) for r in got] == [
        (1, 1, 8, False), (1, 2, 7, False), (1, 3, 8, False), (2, None, None, True)]


def test_batch_backfill_first_match(spark):
    docs = spark.createDataFrame([("PR1", "Purchase Receipt"), ("DN1", "Delivery Note")], "name string, doctype string")
    items = spark.createDataFrame([("PR1", 2, 5, "S2", "X2"), ("PR1", 1, 5, "S1", "X1"), ("DN1", 1, 6, "S9", "X9")],
                                  "parent string, idx long, item_code long, custom_supplier_batch_no string, "
                                  "custom_box_no string")
    batches = spark.createDataFrame([("b1", "PR1", 5, "OLD", None), ("b2", "PR1", 6, "OLD", None),
                                     ("b3", None, 5, "OLD", None), ("b4", "DN1", 6, "OLD", None)],
                                    "name string, reference_name string, item long, custom_supplier_batch_no string, "
                                    "custom_box_no string")
    got = {r.name: (r.custom_supplier_batch_no, r.custom_box_no)
           for r in D.batch_backfill(batches, docs, items).collect()}
    assert got == {"b1": ("S1", "X1"), "b2": ("OLD", None), "b3": ("OLD", None), "b4": ("OLD", None)}


def test_consumed_qty_reconciliation(spark):
    from decimal import Decimal as Dec
    supplied = spark.createDataFrame([("S", 1, 5, Dec("1.23456")), ("S", 2, 6, Dec("2.0")), ("S", 3, 6, Dec("3.0")),
                                      ("S", 4, 5, Dec("9.0"))],
                                     "parent string, idx long, main_item_code long, consumed_qty decimal(21,9)")
    actual = spark.createDataFrame([("S", 1, 5, Dec("1.0")), ("S", 2, 5, Dec("1.5"))],
                                   "parent string, idx long, item long, actual_consumed_qty decimal(21,9)")
    s_after, a_after = D.consumed_qty_reconciled(supplied, actual)
    a = sorted((r.idx, r.item, r.actual_consumed_qty) for r in a_after.collect())
    assert a == [(1, 5, 1.0), (2, 5, 1.5), (3, 6, 2.0), (4, 6, 3.0)]     # item 6 appended twice
    s = {r.idx: r.consumed_qty for r in s_after.collect()}
    assert s == {1: 1.5, 2: 3.0, 3: 3.0, 4: 9.0}   # first row per item takes the last actual value


def test_doc_references_replace(spark):
    cols = "parent string, idx long, link_doctype string, link_name string"
    old = spark.createDataFrame([("A", 1, "PO", "x"), ("B", 1, "PO", "y")], cols)
    new = spark.createDataFrame([("A", 1, "PO", "n1"), ("A", 2, "PO", "n2")], cols)
    got = sorted(tuple(r) for r in D.doc_references(old, new).collect())
    assert got == [("A", 1, "PO", "n1"), ("A", 2, "PO", "n2"), ("B", 1, "PO", "y")]


def test_consumed_qty_text_null_and_half_even(spark):
    from plantops.operators import documents as D
    supplied = spark.createDataFrame([("S", 1, 7, "1.0005"), ("S", 2, 8, "2.5"), ("S", 3, 9, "")],
                                     "parent string, idx long, main_item_code long, consumed_qty string")
    actual = spark.createDataFrame([("S", 1, 8, "3"), ("S", 2, 8, "")],
                                   "parent string, idx long, item long, actual_consumed_qty string")
    after, lst = D.consumed_qty_reconciled(supplied, actual)
    assert {(r.idx, r.item): r.actual_consumed_qty for r in lst.collect()} == {(1, 8): 3.0, (2, 8): None, (3, 7): 1.0, (4, 9): None}
    assert {r.idx: r.consumed_qty for r in after.collect()} == {1: 1.0, 2: None, 3: None}


def test_numbers_with_commas_and_overflow(spark):
    from plantops.functions.scalars import cint, flt
    r = spark.createDataFrame([("1,234.5", "1e30")], "a string, b string").select(flt("a").alias("a"), cint("b").alias("b"), cint("a").alias("c")).first()
    assert (r.a, r.b, r.c) == (1234.5, 0, 1234)


def test_snapshots_keep_other_columns(spark, tmp_path):
    from plantops.operators import documents as D
    from plantops.operators import pricing as P
    price = spark.createDataFrame([("P1", 1, "L", 10.0, None, "x")], "name string, item_code long, price_list string, price_list_rate double, valid_from date, note string")
    default = spark.createDataFrame([(1, 1, 3)], "parent long, idx long, default_supplier long")
    out = P.price_revision(price, default, 3, "L", "1,000", "2024-01-01")
    D.write_snapshot(out, str(tmp_path / "new"))
    got = spark.read.parquet(str(tmp_path / "new"))
    assert got.columns == price.columns and got.first().price_list_rate == 1010.0 and got.first().note == "x"


def test_blank_links_and_null_parameters(spark):
    from plantops.operators import checklists as C
    from plantops.operators import quality as QA
    t = spark.createDataFrame([("a", ""), ("b", None), ("c", "gone"), ("d", "here")], "name string, link string")
    target = spark.createDataFrame([("here",)], "name string")
    assert [r.name for r in QA.dq_links(t, "T", "link", target).collect()] == ["c"]
    rows = spark.createDataFrame([("T", 1, None, "s", "o"), ("T", 2, "Material", "s", "o")],
                                 "parent string, idx long, parameters string, specification string, observation string")
    assert sorted(r.idx for r in C.template_rows(rows).collect()) == [1, 2]


def test_consumed_qty_keeps_all_columns(spark):
    supplied = spark.createDataFrame([("D-1", 1, "a", "2.5", 10.0, "Kg"), ("D-1", 2, "b", "1", 20.0, "Nos")],
                                     "parent string, idx long, main_item_code string, consumed_qty string, rate double, uom string")
    actual = spark.createDataFrame([("D-1", 1, "a", "9", "note")], "parent string, idx long, item string, actual_consumed_qty string, remarks string")
    s, a = D.consumed_qty_reconciled(supplied, actual)
    assert s.columns == supplied.columns and a.columns == actual.columns
    assert sorted(map(tuple, s.collect())) == [("D-1", 1, "a", 9.0, 10.0, "Kg"), ("D-1", 2, "b", 1.0, 20.0, "Nos")]
    assert sorted(map(tuple, a.collect())) == [("D-1", 1, "a", 9.0, "note"), ("D-1", 2, "b", 1.0, None)]


def test_a_bin_without_modified_is_the_oldest(spark):
    import datetime as dt
    rows = [("b1", "i", "w", 1.0, None), ("b2", "i", "w", 2.0, dt.datetime(1960, 1, 1)), ("b3", "j", "w", 3.0, None), ("b0", "j", "w", 4.0, None)]
    bins = spark.createDataFrame(rows, "name string, item_code string, warehouse string, actual_qty double, modified timestamp_ntz")
    assert {r.item_code: r["name"] for r in latest_bin(bins).collect()} == {"i": "b2", "j": "b0"}


def test_text_quantities_and_far_days(spark):
    from plantops.functions.scalars import add_days, excess5, round2
    df = spark.createDataFrame([("", "99999999999"), ("x", "5"), ("1,234.565", "-1"), (None, None), ("2.675", "3000000")], "t string, d string")
    got = df.select(round2("t").cast("double").alias("r"), excess5("t").alias("e"), add_days(F.lit("2024-01-01"), "d").cast("string").alias("day")).collect()
    assert [r.r for r in got] == [0.0, 0.0, 1234.56, 0.0, 2.68]
    assert [r.e for r in got] == [None, None, None, None, 2.675 * 0.05 + 2.675]
    assert [r.day for r in got] == [None, "2024-01-06", "2023-12-31", "2024-01-01", None]


def test_link_fields_in_one_pass_equal_single_checks(spark):
    from plantops.operators import quality as QA
    a = spark.createDataFrame([("r1", "x", 1), ("r2", "", 9), ("r3", None, None), ("r4", "z", 2)], "name string, item string, cust long")
    items, custs = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([(1,), (2,)], "name long")
    both = QA.dq_links_all([(a, "A", {"item": "Item", "cust": "Customer"})], {"Item": items, "Customer": custs})
    single = QA.dq_links(a, "A", "item", items).unionByName(QA.dq_links(a, "A", "cust", custs))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, single.collect())) == [("A", "cust", "r2", "9"), ("A", "item", "r4", "z")]


def test_totals_are_collected_while_the_report_is_written(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") / 4).alias("qty"), F.lit(None).cast("double").alias("none"))
    seen = spark.sparkContext.accumulator(0)
    once = rows.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), rows.schema)
    got = R.write_with_totals(once, ["qty", "none"], str(tmp_path / "r"))
    assert seen.value == 1000  # the report's rows were made once
    assert got.collect() == R.report_totals(rows, ["qty", "none"]).collect()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1000


def test_weekly_capacity(spark):
    plans = [("w1", "SO1", "L1", "A", "T", "100"), ("w2", "SO1", "L1", "B", "T", "1,000"), ("w3", "SO9", "L2", "A", "T", "none"), ("w4", "SO1", "L2", "A", "T", "0")]
    erp = make_erp(spark, {
        "weekly_production_plan": (plans, "name string, sales_order string, line string, item_name string, tube string, capacity_per_day string"),
        "sales_order_item": ([("SO1", 1, "A", 600.0), ("SO1", 2, "B", 100.0), ("SO1", 3, "A", 5.0)], "parent string, idx long, item_code string, qty double")})
    got = {r["name"]: r for r in R.weekly_capacity(erp, tubes_per_setting=50).collect()}
    assert (got["w1"].work_day, got["w1"].set_time, got["w1"].total_days, got["w1"].over_6_days) == (6.3, 0.5, 6.8, True)
    assert (got["w2"].planned, got["w2"].work_day, got["w2"].over_6_days) == (105.0, 0.105, False)
    assert got["w3"].planned == 0 and got["w3"].work_day is None and got["w4"].total_days is None and got["w4"].over_6_days is None
