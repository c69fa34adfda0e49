"""Writing changed documents back into a stored table.

The reference reads a document, sets fields and saves it, one at a time.  Here
a table is stored in partitions by a hash of its key (``name`` of a document,
``parent`` of a child list), and all changed keys are written back at once: only
the partitions that hold one are read and rewritten, by dynamic partition
overwrite, with all columns of their rows.  Other partitions keep their files.

The new content of the touched partitions is written to the shared folder
first.  A write that a lost driver broke off between two partitions can be
repeated from there (:meth:`KeyedTable.commit`), as often as needed.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantops.session import staging, sub_dir

PART = "part_of_key"


class KeyedTable:
    """A stored table whose rows of one ``key`` are replaced together."""

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int, schema: T.StructType):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts
        self.schema = T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, parts: int = 64) -> "KeyedTable":
        """Stores ``df`` at a new path; an existing one raises."""
        table = cls(df.sparkSession, path, key, parts, df.schema)
        # rebalance: small partitions get few files, a hot key is written by several tasks
        df.withColumn(PART, table._part()).hint("rebalance", F.col(PART)).write.mode("errorifexists").partitionBy(PART).parquet(path)
        return table

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        return self._stored(self.path).drop(PART)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> str | None:
        """``rows`` take the place of all rows with their keys; ``keys`` (one
        column) names further keys whose rows go.  A null key is a key like any
        other.  Returns the folder of the new content, None if nothing changed."""
        k = self.key
        touched = rows.select(k) if keys is None else rows.select(k).unionByName(keys.select(k))
        return self._swap(rows, touched.distinct())

    def _swap(self, rows: DataFrame, touched: DataFrame) -> str | None:
        """:meth:`replace` for keys that are known: one row of ``touched`` for each."""
        k = self.key
        touched = touched.withColumn(PART, self._part())
        parts = [r[0] for r in touched.select(PART).distinct().collect()]  # at most ``parts`` numbers
        if not parts:
            return None
        old = self._stored(self.path).where(F.col(PART).isin(parts))
        gone = touched.select(F.col(k).alias("__key"))
        kept = old.join(gone, F.col(k).eqNullSafe(F.col("__key")), "left_anti")
        content = kept.unionByName(rows.select(*[c for c in old.columns if c != PART]).withColumn(PART, self._part()))
        staged = staging(self.spark, "writeback")
        content.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(staged)
        self.commit(staged, parts)
        return staged

    def commit(self, staged: str, parts: list[int] | None = None) -> None:
        """Puts the staged partitions in place of the table's; may be repeated.
        A touched partition that has no rows left is emptied."""
        content = self._stored(staged)
        left = {r[0] for r in content.select(PART).distinct().collect()}
        content.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        for part in sorted(set(parts or []) - left):
            empty = self.spark.createDataFrame([], content.drop(PART).schema)
            empty.write.mode("overwrite").parquet(sub_dir(self.path, f"{PART}={part}"))
        self.spark.catalog.refreshByPath(self.path)


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys whose rows differ between two versions of a table, as
    multisets.  Each version is reduced to a count and two sums of row hashes
    for each key, so no group is gathered."""
    cols = sorted(old.columns)

    def prints(df: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in cols])
        sums = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(row), F.hash(row).cast("long"))]
        return df.groupBy(F.col(key).alias(f"{side}_k")).agg(F.struct(F.count(F.lit(1)), *sums).alias(side))

    a, b = prints(old, "_old"), prints(new, "_new")
    both = a.join(b, F.col("_old_k").eqNullSafe(F.col("_new_k")), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(F.when(F.col("_old").isNull(), F.col("_new_k")).otherwise(F.col("_old_k")).alias(key))


def write_version(old: DataFrame, new: DataFrame, path: str, key: str, parts: int = 64) -> DataFrame:
    """Stores ``old`` at ``path`` and writes back what differs in ``new``;
    the table as it is read afterwards.  ``new`` and the changed keys are each
    used several times and may be costly, so they are computed once and staged."""
    spark = old.sparkSession
    table = KeyedTable.create(old, path, key, parts)

    def once(df: DataFrame) -> DataFrame:
        at = staging(spark, "writeback")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    new = once(new)
    keys = once(changed_keys(table.read(), new, key))
    rows = new.join(keys.select(F.col(key).alias("__changed")), F.col(key).eqNullSafe(F.col("__changed")), "left_semi")
    table._swap(rows, keys)
    return table.read()
