"""Supplier price lists (survey J7, W1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.functions.scalars import as_date, flt


def _supplier_item_codes(item_default: DataFrame, supplier) -> DataFrame:
    """Items whose default-supplier list contains ``supplier`` (one row each)."""
    return (item_default.where(F.col("default_supplier") == F.lit(supplier))
                        .select(F.col("parent").alias("_sup_item")).distinct())


def supplier_items(item_price: DataFrame, item_default: DataFrame, supplier, price_list: str) -> DataFrame:
    """Price rows of ``price_list`` whose item lists ``supplier`` among
    its default suppliers; one row per price row, so duplicates stay."""
    prices = item_price.where(F.col("price_list") == price_list).select("name", "item_code")
    items = _supplier_item_codes(item_default, supplier)
    return prices.join(items, prices["item_code"] == items["_sup_item"], "left_semi")


def price_changes(item_price: DataFrame, item_default: DataFrame, supplier, price_list: str,
                  amount, valid_from: dt.date | str) -> DataFrame:
    """Only the price rows that the revision changes, with all their columns."""
    items = _supplier_item_codes(item_default, supplier)
    rate = F.col("price_list_rate")
    rows = item_price.where((F.col("price_list") == price_list) & rate.isNotNull() & (rate != 0))
    return (rows.join(items, F.col("item_code") == F.col("_sup_item"), "left_semi")
                .withColumns({"price_list_rate": rate + flt(F.lit(str(amount))), "valid_from": as_date(valid_from)}).select(*item_price.columns))


def price_revision(item_price: DataFrame, item_default: DataFrame, supplier, price_list: str,
                   amount, valid_from: dt.date | str) -> DataFrame:
    """The whole Item Price table after the revision: each price row of
    ``price_list`` for an item of ``supplier`` with a non-zero rate gets
    ``rate + flt(amount)`` and the new ``valid_from``; every other row is
    unchanged.

    Difference from the reference, on purpose: when an item has k rows in
    the list the reference adds ``amount`` k times (it writes by filter
    once per row it finds); here each qualifying row gets it once.  Equal
    when k = 1.
    """
    items = _supplier_item_codes(item_default, supplier)
    p = item_price.join(items, item_price["item_code"] == items["_sup_item"], "left")
    rate = F.col("price_list_rate")
    change = ((F.col("price_list") == price_list) & F.col("_sup_item").isNotNull()
              & rate.isNotNull() & (rate != 0))
    return p.withColumns({
        "price_list_rate": F.when(change, rate + flt(F.lit(str(amount)))).otherwise(rate),
        "valid_from": F.when(change, as_date(valid_from)).otherwise(F.col("valid_from"))}).select(*item_price.columns)
