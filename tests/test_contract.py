"""The input contract of ERP exports, and the invoice charges on a hand frame."""

import pytest

from plantops.operators import documents as D
from plantops.sources import fixed, schemas
from plantops.sources.erp import Erp

SF = "/root/testdata/sf0.001"


def test_mapped_tables_meet_the_contract(spark):
    from plantops.sources.testdata import erp_from_testdata
    erp = erp_from_testdata(spark, SF)
    assert set(erp.tables()) == set(schemas.COLUMNS)
    for t in ("sales_order", "item", "sales_invoice", "pmc", "checklist", "workstation", "solution_type", "work_order"):
        schemas.check(t, erp[t])


def test_export_is_checked_when_a_table_is_used(spark, tmp_path):
    good = spark.createDataFrame([("CHK-1", "Raw", "x")], "name string, checklist_name string, further string")
    good.write.parquet(str(tmp_path / "checklist.parquet"))
    bad = spark.createDataFrame([("SO-1", "C", "1")], "name string, customer string, docstatus string")
    bad.withColumn("transaction_date", bad.name).write.parquet(str(tmp_path / "sales_order.parquet"))
    erp = Erp.from_parquet_dir(spark, str(tmp_path), ["checklist", "sales_order"])
    assert erp.checklist.columns == good.columns
    with pytest.raises(ValueError, match="delivery_date is missing.*transaction_date is no date.*docstatus is no number"):
        erp.sales_order


def test_invoice_charges_print_totals_only_with_freight(spark):
    si = spark.createDataFrame([("A", 5.0, 100.0, 18.0, 118.0), ("B", 1.0, 50.0, 9.0, 59.0), ("C", 0.0, 0.0, 0.0, 0.0)],
                               "name string, total_qty double, total double, total_taxes_and_charges double, grand_total double")
    taxes = spark.createDataFrame([("A", fixed.TAX_FREIGHT, 2.5), ("A", fixed.TAX_FREIGHT, 0.5), ("A", "other", 7.0), ("B", fixed.TAX_PACKING, 4.0)],
                                  "parent string, account_head string, base_tax_amount double")
    got = {r.invoice: tuple(r)[1:] for r in D.print_tax_invoice_charges(si, taxes).collect()}
    assert got == {"A": (None, None, 3.0, 100.0, 18.0, 5.0, 100.0, 118.0),
                   "B": (4.0, None, None, None, None, 1.0, 50.0, 59.0),
                   "C": (None, None, None, None, None, 0.0, 0.0, 0.0)}
