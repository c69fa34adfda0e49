"""Data-quality checks the ERP schema enforces on save (survey Q1-Q3),
run over whole tables: unique keys, select domains, link targets.  Each
check returns the violating rows only, in one long shape, so several checks
union into one report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantops.functions.scalars import non_blank


def dq_unique(table: DataFrame, doctype: str, field: str) -> DataFrame:
    """Q1: values of ``field`` held by more than one row (partial-aggregated
    count, so a hot value costs nothing extra)."""
    return (table.where(F.col(field).isNotNull())
                 .groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") > 1)
                 .select(F.lit(doctype).alias("doctype"), F.lit(field).alias("field"), "value", "n"))


def dq_domain(table: DataFrame, doctype: str, field: str, domain: DataFrame,
              allow_blank: bool = True) -> DataFrame:
    """Q2: rows whose Select ``field`` is outside its option list (``domain``
    is a small literal frame with column ``value``, broadcast: the rows hold few
    values, so a join that deals them by value would have few tasks)."""
    v = F.col(field)
    t = table.where(v.isNotNull() & ((v != "") if allow_blank else F.lit(True)))
    return (t.join(F.broadcast(domain.select(F.col("value").alias("_dv"))), v == F.col("_dv"), "left_anti")
             .select(F.lit(doctype).alias("doctype"), F.lit(field).alias("field"),
                     F.col("name").cast("string").alias("name"), v.cast("string").alias("value")))


def dq_links(table: DataFrame, doctype: str, field: str, target: DataFrame,
             target_key: str = "name") -> DataFrame:
    """Q3: non-blank Link values with no target row."""
    v = F.col(field)
    keys = target.select(F.col(target_key).alias("_tk"))
    return (table.where(non_blank(v.cast("string")))
                 .join(keys, v == F.col("_tk"), "left_anti")
                 .select(F.lit(doctype).alias("doctype"), F.lit(field).alias("field"),
                         F.col("name").cast("string").alias("name"), v.cast("string").alias("value")))


def dq_links_all(tables: list[tuple[DataFrame, str, dict[str, str]]], targets: dict[str, DataFrame],
                 target_key: str = "name") -> DataFrame:
    """Q3 for many Link fields at once: each of ``tables`` is (rows, doctype,
    {field: doctype it links to}).  The Link fields are unpivoted, so a table is
    read once however many it has, and meet the keys of all targets in one
    anti join on (target, value); AQE splits a value that many rows hold."""
    links = []
    for table, doctype, fields in tables:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), F.col(f).cast("string").alias("value"))
                         for f, t in fields.items()])
        links.append(table.select(F.lit(doctype).alias("doctype"), F.col("name").cast("string").alias("name"), F.explode(each).alias("link"))
                          .select("doctype", "link.field", "name", "link.value", "link.target").where(non_blank("value")))
    keys = [df.select(F.lit(t).alias("_target"), F.col(target_key).cast("string").alias("_key")) for t, df in targets.items()]
    found = union_all(keys)
    return (union_all(links).join(found, (F.col("target") == F.col("_target")) & (F.col("value") == F.col("_key")), "left_anti")
                            .select("doctype", "field", "name", "value"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
