"""Parent/child access over whole tables (survey A3, A5, J4, G6, G7).

The reference fetches one document and walks its lines; here each operator
answers the question for every document at once.  Per-group picks
("first line with this item", "latest Bin") are aggregates, so Spark combines
them map-side before the shuffle and a hot group never lands whole in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantops.operators.ordinal import numbered


def order_lines(header: DataFrame, items: DataFrame, header_cols: list[str] | None = None,
                item_cols: list[str] | None = None) -> DataFrame:
    """A3: ``get_doc(parent)`` for every parent: header x its lines (inner, a
    header with no lines gives no row)."""
    h = header.select(*(header_cols or header.columns))
    i = items.select(*(item_cols or items.columns))
    return i.join(h, i["parent"] == h["name"], "inner")


def latest_row(df: DataFrame, key: str, order: list[Column], cols: list[str]) -> DataFrame:
    """A5: the one row per ``key`` that ``get_value(dt, {key: k})`` returns.

    The ERP leaves the pick to the database; we fix it as the first row by
    ``order``.  One aggregate (``min_by`` over a struct), combined map-side.
    """
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), rank).alias("_r"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in cols])


def latest_bin(bins: DataFrame) -> DataFrame:
    """A5 for Bin: per item, the row with the latest ``modified`` (NULL is the
    oldest), then lowest ``name``."""
    newest_first = F.coalesce(-F.unix_micros(F.col("modified").cast("timestamp")), F.lit((1 << 63) - 1))
    return latest_row(bins, "item_code", [newest_first, F.col("name")],
                      ["name", "warehouse", "actual_qty", "modified"])


def first_match(items: DataFrame, keys: list[str], value: str, order: str = "idx",
                alias: str | None = None) -> DataFrame:
    """Value of the first (lowest ``order``) child row per ``keys``;
    later duplicates ignored.  One row per key combination."""
    return items.groupBy(*keys).agg(F.min_by(F.col(value), F.col(order)).alias(alias or value))


def so_item_qty(plans: DataFrame, so_items: DataFrame) -> DataFrame:
    """J4 as the API returns it: per plan, qty of the first line of its sales
    order with the plan's item; NULL when there is none."""
    first = first_match(so_items, ["parent", "item_code"], "qty")
    p = plans.select("name", "sales_order", F.col("item_name").alias("item_code"))
    return p.join(first, (p["sales_order"] == first["parent"]) & (p["item_code"] == first["item_code"]),
                  "left").select(p["name"], p["sales_order"], p["item_code"], first["qty"])


def so_item_list(sales_orders: DataFrame, so_items: DataFrame) -> DataFrame:
    """Item codes of each order in line order, duplicates kept.  Long
    form ``(sales_order, position, item_code)``: a list per order would put
    an unbounded group into one row."""
    i = so_items.select("parent", "idx", "item_code")
    return (i.join(sales_orders.select("name"), i["parent"] == F.col("name"), "left_semi")
             .select(F.col("parent").alias("sales_order"), F.col("idx").alias("position"), "item_code"))


def item_default_suppliers(item_defaults: DataFrame) -> DataFrame:
    """Non-empty default suppliers per item in child order, duplicates
    kept; ``position`` renumbers the kept rows 1..k (skew-safe)."""
    kept = item_defaults.where(F.col("default_supplier").isNotNull()
                               & (F.col("default_supplier").cast("string") != ""))
    return numbered(kept.select("parent", "idx", "default_supplier"), ["parent"], ["idx"], "position").select(
        F.col("parent").alias("item_code"), "position", F.col("default_supplier").alias("supplier"))
