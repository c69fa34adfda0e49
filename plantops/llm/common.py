"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import plantops
from plantops.session import staging


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that
    their Python workers can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(plantops.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "plantops-code"), "zip", root, "plantops"))
        _shipped.add(sc.applicationId)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``),
    in the open run folder if there is one (:func:`plantops.session.run_folder`)."""
    return staging(spark, label)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is
    cut and every later use sees the same rows, whatever executor is lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as it counts for the operators: null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def number_within(df: DataFrame, key: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless 0-based numbers inside each value of ``key`` without bringing a
    whole value to one task: rows are counted per (key, bucket), the small
    count table gives each bucket its first number, and only rows of one
    bucket are sorted together.  Rows that tie in ``order`` are numbered in
    any order; ``key`` may be null (a value of its own)."""
    from pyspark.sql import Window

    b, base = "__bucket", "__base"
    df = df.withColumn(b, bucket)
    counts = df.groupBy(key, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(key).alias("__k"), F.col(b).alias("__b"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(key, b).orderBy(*order))
    return (df.withColumn("__i", inside)
              .join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col(b) == F.col("__b")))
              .withColumn(name, (F.col(base) + F.col("__i") - 1).cast("long"))
              .drop("__k", "__b", b, base, "__i"))
