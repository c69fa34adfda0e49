"""ERP tables mapped from the TPC-H-shaped test tables (see FIXTURES.md).

Each mapped table is a DataFrame plan over the parquet files.  Child tables
get their ``idx`` in the order
``(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)``, which
is total inside an order.  Numbered lines, the child tables that are joined
with their header and those headers are written once for each application and
input (:mod:`~plantops.sources.store`).
``<table>__plain`` builders leave ``idx`` out, for the queries that only
filter, join and sum lines: these read the columns they use and number nothing.
``<table>__unstored`` builders number their lines but store none, for a query
that reads them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantops.operators.ordinal import largest_group, numbered
from plantops.sources import fixed
from plantops.sources.erp import Erp
from plantops.sources.store import store_for

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _docstatus(status: Column) -> Column:
    return F.when(status == "F", 1).when(status == "O", 0).otherwise(2).cast("int")


ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


def doctype_of(order_key: Column) -> Column:
    return (F.when(order_key % 3 == 0, fixed.DOCTYPE_PR).when(order_key % 3 == 1, fixed.DOCTYPE_DN)
             .otherwise(fixed.DOCTYPE_SCR))


def doc_from_orders(orders: DataFrame) -> DataFrame:
    """Receipt/delivery document headers from orders (works on a stream too)."""
    ok = F.col("o_orderkey")
    posting = F.to_date("o_orderdate")
    return orders.select(
        F.concat(F.lit("D-"), _s(ok)).alias("name"),
        doctype_of(ok).alias("doctype"),
        (F.col("o_custkey") % 10).alias("supplier"), F.col("o_custkey").alias("customer"),
        posting.alias("posting_date"), _docstatus(F.col("o_orderstatus")).alias("docstatus"),
        F.concat(F.lit("LOT-"), _s(ok)).alias("custom_lot_no"),
        F.concat(F.lit("CH-"), _s(ok)).alias("custom_challan_no"),
        F.date_add(posting, 1).alias("custom_challan_date"),
        F.concat(F.lit("INV-"), _s(ok)).alias("custom_invoice_no"),
        F.date_add(posting, 2).alias("custom_invoice_date"))


def erp_from_testdata(spark: SparkSession, sf_dir: str) -> Erp:
    sf_dir = sf_dir.rstrip("/")

    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    store = store_for(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")])

    sizes: dict[str, int] = {}

    def most_lines(name: str, key: Column) -> int:
        """A bound for the lines that share ``key``."""
        if name not in sizes:
            sizes[name] = largest_group(read("lineitem").select(key.alias(name)), [name], store.hot_rows)
        return sizes[name]

    def most_in_order() -> int:
        return most_lines("order", F.col("l_orderkey"))

    def numbered_lines(*cols: str) -> DataFrame:
        """All lines with ``idx`` inside their order, dealt by order once."""
        return numbered(read("lineitem").select("l_orderkey", *LINE_ORDER, *cols), ["l_orderkey"], LINE_ORDER,
                        partitions=store.buckets, largest=most_in_order())

    def lines() -> DataFrame:
        """The numbered lines, stored."""
        return store.child("lines", lambda: numbered_lines("l_returnflag"), key="l_orderkey", largest=most_in_order)

    def pairs() -> DataFrame:
        """The parts' suppliers with ``idx`` inside the part and ``sidx`` inside its section."""
        def most() -> int | None:
            """No part has more suppliers than lines; beyond that the suppliers are counted."""
            n = most_lines("part", F.col("l_partkey"))
            return n if n <= store.hot_rows else None

        def build() -> DataFrame:
            found = read("lineitem").select("l_partkey", "l_suppkey")
            if most() is not None:  # dealt by part once, for the distinct pairs and both numberings
                found = found.repartition(store.buckets, "l_partkey")
            found = found.distinct().withColumn("section", F.col("l_suppkey") % len(fixed.PMC_SECTIONS))
            return numbered(numbered(found, ["l_partkey"], ["l_suppkey"], largest=most()), ["l_partkey", "section"], ["l_suppkey"], "sidx", largest=most())
        return store.child("item_suppliers", build, key="l_partkey", largest=most)

    def part(*cols: str) -> DataFrame:
        return read("part").select("p_partkey", *cols)

    def order_date() -> Column:
        return F.to_date("o_orderdate")

    b = {}

    def plain_sales_order() -> DataFrame:
        return read("orders").select(
            F.col("o_orderkey").alias("name"),
            F.col("o_custkey").alias("customer"),
            _docstatus(F.col("o_orderstatus")).alias("docstatus"),
            order_date().alias("transaction_date"),
            F.date_add(order_date(), 30).alias("delivery_date"),
            F.concat(F.lit("CPO-"), _s("o_orderkey")).alias("po_no"),
            F.date_sub(order_date(), 7).alias("po_date"))
    b["sales_order"] = lambda: store.header("sales_order", plain_sales_order)
    b["sales_order__plain"] = plain_sales_order

    def plain_sales_order_item() -> DataFrame:
        return lines().join(
            part("p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("parent"), "idx",
            F.col("l_partkey").alias("item_code"), F.col("p_name").alias("item_name"),
            F.col("l_quantity").alias("qty"), F.col("p_retailprice").alias("rate"),
            F.col("l_extendedprice").alias("amount"))
    b["sales_order_item"] = lambda: store.child("sales_order_item", plain_sales_order_item, like="lines")

    def item() -> DataFrame:
        key, size, ptype = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
        return read("part").select(
            key.alias("name"), F.col("p_name").alias("item_name"), ptype.alias("item_group"),
            F.when(size % 5 == 0, F.lit(None).cast("double")).otherwise(size.cast("double")).alias("min_order_qty"),
            F.when(ptype == "STANDARD", "Raw Material").when(ptype == "SMALL", "Packing Material")
             .when(ptype == "PROMO", F.lit(None).cast("string")).otherwise("General").alias("custom_checklist"),
            F.concat(F.lit("7612"), _s(size % 10)).alias("gst_hsn_code"),
            _s(size).alias("custom_tube_dia"),
            _s(size % 7).alias("custom_wall_thickness"),
            _s(size * 10).alias("custom_body_length"),
            F.when(key % 3 == 0, "Plain").when(key % 3 == 1, "Conical").otherwise("Round").alias("custom_nozzle_type"),
            _s(size % 4 + 5).alias("custom_nozzle_length"),
            _s(size % 3 + 6).alias("custom_nozzle_dia"),
            _s(size % 5 + 2).alias("custom_orifice_dia"),
            F.when(size % 2 == 0, "Good").otherwise("Normal").alias("custom_collapsibility"),
            _s(size % 6 + 1).alias("custom_shoulder_thickness"),
            F.col("p_brand").alias("custom_lacquer_porosity"),
            _s(size % 8).alias("custom_knurling_dia"),
            _s(size % 9).alias("custom_thread_height"),
            F.when(key % 4 != 0, F.concat(F.lit("SPEC-"), _s(F.floor(key / 2)))).alias("custom_specification_number"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int")).alias("custom_effective_date"))
    b["item"] = item

    def po_name(ok="l_orderkey", sk="l_suppkey") -> Column:
        return F.concat(F.lit("PUR-ORD-2024-"), _s(ok), F.lit("-"), _s(sk))

    def po_pairs() -> DataFrame:
        found = read("lineitem").select("l_orderkey", "l_suppkey")
        if most_lines("order", F.col("l_orderkey")) <= store.hot_rows:  # dealt by order once, for the distinct pairs and their orders
            found = found.repartition(store.buckets, "l_orderkey")
        return found.distinct()

    def purchase_order(deal: bool = False) -> DataFrame:
        o = read("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
        st, ok, sk = F.col("o_orderstatus"), F.col("l_orderkey"), F.col("l_suppkey")
        found = po_pairs().join(o, ok == F.col("o_orderkey")).withColumn("name", po_name())
        if deal:  # the bare columns travel, the texts are made where they are written
            found = found.repartition(store.buckets, "name")
        return found.select(
            "name", sk.alias("supplier"),
            F.when(st == "O", fixed.STATUS_TO_RECEIVE_AND_BILL).when(st == "P", "To Bill")
             .otherwise("Completed").alias("status"),
            order_date().alias("transaction_date"),
            F.concat(F.lit("TR-"), _s(sk % 7)).alias("custom_transporter"),
            F.concat(F.lit("Transporter "), _s(sk % 7)).alias("custom_transporter_name"),
            F.concat(F.lit("GJ-21-"), _s(ok % 1000)).alias("custom_vehicle_no"),
            F.concat(F.lit("LR-"), _s(ok)).alias("custom_transport_receipt_no"),
            F.date_add(order_date(), 2).alias("custom_transport_receipt_date"),
            ((sk % 50) * 10).cast("int").alias("custom_distance_in_km"),
            F.when(sk % 4 == 0, "Rail").otherwise("Road").alias("custom_mode_of_transport"),
            F.when(ok % 2 == 0, "Regular").otherwise("Over Dimensional Cargo").alias("custom_gst_vehicle_type"))
    b["purchase_order"] = lambda: store.header("purchase_order", lambda: purchase_order(deal=True))
    b["purchase_order__plain"] = purchase_order

    def purchase_order_item() -> DataFrame:
        li = read("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber",
                                     "l_quantity", "l_extendedprice", "l_shipdate").withColumn("parent", po_name())
        # a null in the name's parts gives a null parent: numbered apart, dealt with the others
        li = numbered(li, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
                      partitions=store.buckets, deal=["parent"], largest=most_in_po())
        return li.join(part("p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
            "parent", "idx", F.col("l_partkey").alias("item_code"),
            F.col("l_quantity").alias("qty"), F.col("p_retailprice").alias("rate"),
            F.col("l_extendedprice").alias("amount"), F.lit("Nos").alias("uom"),
            F.to_date("l_shipdate").alias("expected_delivery_date"))

    def most_in_po() -> int:
        return most_lines("po", po_name())
    b["purchase_order_item"] = lambda: store.child("purchase_order_item", purchase_order_item, largest=most_in_po)

    def stock_entry() -> DataFrame:
        pr = F.col("o_orderpriority")
        return read("orders").select(
            F.col("o_orderkey").alias("name"), order_date().alias("posting_date"),
            F.when(pr == "1-URGENT", fixed.SE_TRANSFER_FOR_MANUFACTURE).when(pr == "2-HIGH", "Manufacture")
             .otherwise("Material Receipt").alias("stock_entry_type"),
            F.when(pr == "2-HIGH", "").when(pr == "3-MEDIUM", F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("WO-"), _s("o_custkey"))).alias("work_order"),
            _docstatus(F.col("o_orderstatus")).alias("docstatus"))
    b["stock_entry"] = stock_entry

    b["stock_entry_detail"] = lambda: lines().select(
        F.col("l_orderkey").alias("parent"), "idx", F.col("l_partkey").alias("item_code"),
        F.col("l_quantity").alias("qty"), F.concat(F.lit("B"), _s("l_suppkey")).alias("batch_no"))

    def work_order() -> DataFrame:
        c = F.col("c_custkey")
        return read("customer").where(c % 10 != 0).select(
            F.concat(F.lit("WO-"), _s(c)).alias("name"), c.alias("production_item"),
            F.when(c % 2 == 0, "Work Order").otherwise("Job Card").alias("transfer_material_against"))
    b["work_order"] = work_order

    def production_qc() -> DataFrame:
        c = F.col("c_custkey")
        return read("customer").where(c % 4 != 0).select(
            F.concat(F.lit("PQC-"), _s(c)).alias("name"),
            F.concat(F.lit("WO-"), _s(c)).alias("reference_name"),
            F.when(c % 7 == 0, c + 1).otherwise(c).alias("item_code"),
            (c % 3).cast("int").alias("docstatus"))
    b["production_qc"] = production_qc

    def bin_() -> DataFrame:
        wh = (F.col("l_suppkey") % 5).alias("wh")
        g = (read("lineitem").where(F.col("l_partkey") % 9 != 0)
             .groupBy("l_partkey", wh)
             .agg(F.sum(F.col("l_quantity").cast("decimal(21,9)")).cast("double").alias("actual_qty"),
                  F.max("l_shipdate").alias("modified")))
        return g.select(
            F.concat(_s("l_partkey"), F.lit("-W"), _s("wh")).alias("name"),
            F.col("l_partkey").alias("item_code"), F.concat(F.lit("W"), _s("wh")).alias("warehouse"),
            "actual_qty", "modified")
    b["bin"] = bin_

    def weekly_production_plan() -> DataFrame:
        o = read("orders").where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderpriority")
        line = lines().select("l_orderkey", "l_partkey", "idx")
        ok = F.col("o_orderkey")
        return (o.join(line, ok == F.col("l_orderkey"))
                 .join(part("p_size"), F.col("l_partkey") == F.col("p_partkey"))
                 .select(F.concat(F.lit("WPP-"), _s(ok), F.lit("-"), _s("idx")).alias("name"), ok.alias("sales_order"),
                         F.col("o_orderpriority").alias("line"),
                         F.when(ok % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_partkey")).alias("item_name"),
                         _s("p_size").alias("tube"), F.lit("10000").alias("capacity_per_day")))
    b["weekly_production_plan"] = weekly_production_plan

    def item_price() -> DataFrame:
        p = read("part").select("p_partkey", "p_retailprice")
        key, valid = F.col("p_partkey"), F.lit("2000-01-01").cast("date")
        selling = p.select(F.concat(F.lit("IPS-"), _s(key)).alias("name"), key.alias("item_code"),
                           F.lit("Standard Selling").alias("price_list"),
                           F.col("p_retailprice").alias("price_list_rate"), valid.alias("valid_from"))
        buying = p.select(F.concat(F.lit("IPB-"), _s(key)).alias("name"), key.alias("item_code"),
                          F.lit("Standard Buying").alias("price_list"),
                          F.when(key % 11 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("price_list_rate"),
                          valid.alias("valid_from"))
        return selling.unionByName(buying)
    b["item_price"] = item_price

    def item_default() -> DataFrame:
        sk = F.col("l_suppkey")
        return pairs().select(
            F.col("l_partkey").alias("parent"), "idx",
            F.when(sk % 10 == 9, F.lit(None).cast("long")).otherwise(sk).alias("default_supplier"))
    b["item_default"] = item_default

    def item_supplier() -> DataFrame:
        # whole parts are left out, so the numbers inside a part stay
        return pairs().join(part("p_type").where(F.col("p_type") != "LARGE"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_partkey").alias("parent"), "idx", F.col("l_suppkey").alias("supplier"))
    b["item_supplier"] = item_supplier

    b["supplier"] = lambda: read("supplier").select(
        F.col("s_suppkey").alias("name"), F.col("s_name").alias("supplier_name"))
    b["customer"] = lambda: read("customer").select(
        F.col("c_custkey").alias("name"), F.col("c_name").alias("customer_name"))

    def plain_doc() -> DataFrame:
        return doc_from_orders(read("orders"))
    b["doc"] = lambda: store.header("doc", plain_doc)
    b["doc__plain"] = plain_doc

    def plain_doc_item() -> DataFrame:
        found = lines().join(part("p_name"), F.col("l_partkey") == F.col("p_partkey")).withColumn("parent", F.concat(F.lit("D-"), _s("l_orderkey")))
        if store.clustered("lines"):  # the bare columns travel, the texts are made where they are written
            found = found.repartition(store.buckets, "parent")
        return found.select(
            "parent", doctype_of(F.col("l_orderkey")).alias("parenttype"), "idx",
            F.col("l_partkey").alias("item_code"), F.col("p_name").alias("item_name"),
            F.col("l_quantity").alias("qty"),
            F.concat(F.lit("B"), _s("l_suppkey")).alias("batch_no"),
            F.concat(F.lit("L"), _s("l_linenumber")).alias("lot_no"),
            F.col("l_returnflag").alias("custom_box_no"),
            F.concat(F.lit("SB"), _s("l_suppkey")).alias("custom_supplier_batch_no"),
            F.round(F.col("l_quantity").cast("decimal(15,2)") * F.lit(0.98).cast("decimal(3,2)"), 3)
             .cast("double").alias("custom_actual_consumed_qty"))
    b["doc_item"] = lambda: store.child("doc_item", plain_doc_item, like="lines")

    def batch() -> DataFrame:
        ok, idx = F.col("l_orderkey"), F.col("idx")
        return (lines().where(ok % 3 == 0).select(
            F.concat(F.lit("BATCH-"), _s(ok), F.lit("-"), _s(idx)).alias("name"),
            F.when(ok % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("D-"), _s(ok))).alias("reference_name"),
            F.when((idx == 2) & (ok % 2 == 0), F.col("l_partkey") + 1000000000).otherwise(F.col("l_partkey")).alias("item"),
            F.lit("OLD").alias("custom_supplier_batch_no"),
            F.lit(None).cast("string").alias("custom_box_no")))
    b["batch"] = batch

    def scr_lines() -> DataFrame:
        return lines().where(F.col("l_orderkey") % 3 == 2)

    b["scr_supplied_item"] = lambda: scr_lines().select(
        F.concat(F.lit("D-"), _s("l_orderkey")).alias("parent"), "idx",
        F.col("l_partkey").alias("main_item_code"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * F.lit(0.001).cast("decimal(4,3)"))
        .cast("decimal(21,9)").alias("consumed_qty"))

    b["scr_actual_consumed"] = lambda: scr_lines().where(F.col("idx") % 2 == 0).select(
        F.concat(F.lit("D-"), _s("l_orderkey")).alias("parent"), (F.col("idx") / 2).cast("long").alias("idx"),
        F.col("l_partkey").alias("item"),
        (F.col("l_quantity").cast("decimal(15,2)") * F.lit(0.95).cast("decimal(3,2)"))
        .cast("decimal(21,9)").alias("actual_consumed_qty"))

    b["doc_reference"] = lambda: read("orders").where(F.col("o_orderkey") % 3 == 2).select(
        F.concat(F.lit("D-"), _s("o_orderkey")).alias("parent"), F.lit(1).cast("long").alias("idx"),
        F.lit("Purchase Order").alias("link_doctype"),
        F.concat(F.lit("PUR-ORD-2024-"), _s("o_orderkey"), F.lit("-0")).alias("link_name"))

    b["custom_document_reference"] = lambda: lines().where(
        (F.col("l_orderkey") % 3 == 2) & (F.col("l_orderkey") % 4 != 0)).select(
        F.concat(F.lit("D-"), _s("l_orderkey")).alias("parent"), "idx",
        F.lit("Purchase Order").alias("link_doctype"), po_name().alias("link_name"))

    def sales_invoice() -> DataFrame:
        ok, ck = F.col("o_orderkey"), F.col("o_custkey")
        return read("orders").select(
            F.concat(F.lit("SI-"), _s(ok)).alias("name"), ck.alias("customer"),
            F.concat(F.lit("ADDR-"), _s(ck)).alias("customer_address"),
            F.when(ok % 4 == 0, F.concat(F.lit("ADDR-"), _s(ck + 1)))
             .otherwise(F.concat(F.lit("ADDR-"), _s(ck))).alias("shipping_address_name"),
            order_date().alias("posting_date"), F.date_add(order_date(), 45).alias("due_date"),
            F.when(ok % 8 != 0, F.concat(F.lit("IRN-"), _s(ok))).alias("irn"),
            F.concat(F.lit("Transporter "), _s(ck % 7)).alias("transporter"),
            F.concat(F.lit("GJ-21-"), _s(ok % 1000)).alias("vehicle_no"),
            F.concat(F.lit("LR-"), _s(ok)).alias("lr_no"), F.date_add(order_date(), 2).alias("lr_date"),
            F.col("o_orderpriority").alias("remarks"), (ok % 500).cast("double").alias("total_qty"),
            F.col("o_totalprice").alias("total"), (ok % 1000).cast("double").alias("total_taxes_and_charges"),
            (F.col("o_totalprice") + (ok % 1000).cast("double")).alias("grand_total"))
    b["sales_invoice"] = lambda: store.header("sales_invoice", sales_invoice)
    b["sales_invoice__plain"] = sales_invoice

    def sales_invoice_item(line: DataFrame) -> DataFrame:
        return line.join(
            part("p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat(F.lit("SI-"), _s("l_orderkey")).alias("parent"), "idx",
            F.col("l_partkey").alias("item_code"), F.col("l_orderkey").alias("sales_order"),
            (F.col("l_suppkey") % 12).alias("custom_no_of_pkgs"), (F.col("l_partkey") % 250).alias("custom_average_contents_per"),
            F.col("l_quantity").alias("qty"), F.col("p_retailprice").alias("rate"),
            F.col("l_extendedprice").alias("taxable_value"))
    b["sales_invoice_item"] = lambda: store.child("sales_invoice_item", lambda: sales_invoice_item(lines()), like="lines")
    b["sales_invoice_item__unstored"] = lambda: sales_invoice_item(numbered_lines())

    def sales_taxes() -> DataFrame:
        rf = F.col("l_returnflag")
        tax = F.round(F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_tax").cast("decimal(4,2)"), 2)
        return (read("lineitem").groupBy("l_orderkey", "l_returnflag")
                .agg(F.sum(tax).cast("double").alias("base_tax_amount"))
                .select(F.concat(F.lit("SI-"), _s("l_orderkey")).alias("parent"),
                        F.when(rf == "R", fixed.TAX_PACKING).when(rf == "A", fixed.TAX_INSURANCE)
                         .when(rf == "N", fixed.TAX_FREIGHT).alias("account_head"),
                        "base_tax_amount"))
    b["sales_taxes"] = sales_taxes

    b["address"] = lambda: read("customer").select(
        F.concat(F.lit("ADDR-"), _s("c_custkey")).alias("name"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("GST"), _s("c_custkey"))).alias("gstin"))

    def pmc() -> DataFrame:
        key = F.col("p_partkey")
        return read("part").select(
            F.concat(F.lit("PMC-"), _s(key)).alias("name"),
            F.when(key % 50 == 0, F.concat(F.lit("PMC-"), _s(key - 2)))
             .otherwise(F.concat(F.lit("PMC-"), _s(key))).alias("pmc_no"),
            key.alias("product_name"), key.alias("customer_code"),
            F.when(key % 13 != 0, F.when(key % 17 == 0, key + 1000000000).otherwise(key)).alias("sales_order"))
    b["pmc"] = pmc

    b["checklist"] = lambda: read("part").select(
        F.concat(F.lit("CHK-"), _s("p_partkey")).alias("name"),
        F.concat(F.lit("Checklist "), _s(F.col("p_partkey") - F.when(F.col("p_partkey") % 40 == 0, 1).otherwise(0))).alias("checklist_name"))
    b["workstation"] = lambda: read("orders").where(F.col("o_orderkey") % 5 != 0).select(F.col("o_orderpriority").alias("name")).distinct()
    b["employee"] = lambda: read("supplier").where(F.col("s_suppkey") % 3 != 0).select(
        F.concat(F.lit("EMP-"), _s("s_suppkey")).alias("name"))

    def pmc_item() -> DataFrame:
        sk = F.col("l_suppkey")
        sections = F.array(*[F.lit(f) for f, _ in fixed.PMC_SECTIONS])
        return pairs().withColumn("parentfield", F.element_at(sections, (F.col("section") + 1).cast("int"))).select(
            F.concat(F.lit("PMC-"), _s("l_partkey")).alias("parent"), "parentfield", F.col("sidx").alias("idx"),
            (F.col("l_partkey") + sk).alias("raw_material_name"),
            F.concat(F.lit("Supplier#"), _s(sk)).alias("supplier_name"))
    b["pmc_item"] = pmc_item

    b["product_specification"] = lambda: read("part").select(
        F.concat(F.lit("PS-"), _s("p_partkey")).alias("name"), F.col("p_partkey").alias("item_code"),
        _s(F.col("p_size") % 4).alias("revision_no"))

    b["checklist_template"] = lambda: fixed.checklist_templates(spark)

    def solution_type() -> DataFrame:
        rk = F.col("n_regionkey")
        return read("nation").select(
            F.concat(F.lit("SOP-"), F.col("n_name")).alias("name"),
            F.when(rk == 0, "QA").when(rk == 1, "QC").when(rk == 2, "").when(rk == 3, "QA/QC")
             .otherwise(F.lit(None).cast("string")).alias("department"),
            F.when(rk != 4, F.concat(F.lit("EMP-"), _s("n_nationkey"))).alias("prepared_by"))
    b["solution_type"] = solution_type

    def raw(*cols: str) -> DataFrame:
        return read("lineitem").select("l_orderkey", "l_partkey", *cols)

    def in_part(line: DataFrame, *cols: str) -> DataFrame:
        return line.join(part(*cols), F.col("l_partkey") == F.col("p_partkey"))

    b["sales_order_item__plain"] = lambda: in_part(raw("l_quantity", "l_extendedprice"), "p_retailprice").select(
        F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("item_code"), F.col("l_quantity").alias("qty"),
        F.col("p_retailprice").alias("rate"), F.col("l_extendedprice").alias("amount"))
    b["purchase_order_item__plain"] = lambda: in_part(raw("l_suppkey", "l_quantity")).select(
        po_name().alias("parent"), F.col("l_partkey").alias("item_code"), F.col("l_quantity").alias("qty"))
    b["item_default__plain"] = lambda: read("lineitem").select(F.col("l_partkey").alias("parent"), F.when(F.col("l_suppkey") % 10 == 9, F.lit(None).cast("long"))
                                                                 .otherwise(F.col("l_suppkey")).alias("default_supplier")).distinct()
    b["stock_entry_detail__plain"] = lambda: raw("l_suppkey", "l_quantity").select(
        F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("item_code"), F.col("l_quantity").alias("qty"),
        F.concat(F.lit("B"), _s("l_suppkey")).alias("batch_no"))
    return Erp(spark, b, store.clustered)
