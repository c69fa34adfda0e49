"""Stored ERP tables: each written once, bucketed by its key and sorted.

A child table is bucketed by ``parent`` and sorted by ``(parent, idx)``, its
header by ``name``, both into the same number of buckets.  A join of lines
with their header, a window or a sum over a parent then needs no exchange, and
``idx`` is numbered once instead of in every query.

The buckets' number grows with the inputs' size, so a task's share does not.

A bucket is one task's, so a table in which a parent has more than
``hot_rows`` lines is stored unbucketed: its joins shuffle, and AQE splits
them.  ``largest`` tells the size of a table's largest parent, and
:meth:`TableStore.clustered` whether it is bucketed.

Files lie in the cluster's shared folder; the tables are known to the
session's catalog under a name of their own.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantops.operators.ordinal import largest_group
from plantops.session import checkpoint_dir, remove, shuffle_partitions, sub_dir

HOT_ROWS = 1_000_000
BUCKET_INPUT = 8 << 20  # bytes of the inputs for each bucket: a bucket's rows do not grow with them
MAX_BUCKETS = 100_000  # Spark's limit
AUTO_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


class TableStore:
    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, hot_rows: int = HOT_ROWS):
        self.spark = spark
        self.id = uuid.uuid4().hex
        self._own_folder = folder is None
        self.folder = folder or sub_dir(checkpoint_dir(spark), f"plantops-store-{self.id}")
        self.buckets = buckets or shuffle_partitions(spark)
        self.hot_rows = hot_rows
        self.largest: dict[str, int] = {}
        self._tables: dict[str, DataFrame] = {}
        self._clustered: set[str] = set()

    def clustered(self, name: str) -> bool:
        """All rows of a key are in one bucket (and not too many for a task)."""
        return name in self._clustered

    def header(self, name: str, build: Callable[[], DataFrame], key: str = "name") -> DataFrame:
        """A table with a unique key."""
        return self._table(name, build, key, [key], lambda df: 1)

    def child(self, name: str, build: Callable[[], DataFrame], key: str = "parent", order: str = "idx", like: str | None = None,
              largest: Callable[[], int | None] = lambda: None) -> DataFrame:
        """A table of lines numbered by ``order``.  ``like`` names a stored
        table whose groups bound this one's, ``largest`` tells such a bound."""
        def bound(df: DataFrame) -> int:
            if like:
                return self.largest[like]
            told = largest()
            return largest_group(df, [key], self.hot_rows) if told is None else told
        return self._table(name, build, key, [key, order], bound)

    def _table(self, name: str, build, key: str, sort: list[str], largest) -> DataFrame:
        if name not in self._tables:
            df = build()
            self.largest[name] = largest(df)
            path = sub_dir(self.folder, name)
            if self.largest[name] <= self.hot_rows:
                self._clustered.add(name)
                catalog_name = f"plantops_{self.id}_{name}"
                # rows that come from a stored table's buckets are written a bucket a task
                auto = self.spark.conf.get(AUTO_SCAN)
                self.spark.conf.set(AUTO_SCAN, "false")
                try:
                    (df.repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, key).sortBy(*sort)
                       .option("path", path).saveAsTable(catalog_name))
                finally:
                    self.spark.conf.set(AUTO_SCAN, auto)
                self._tables[name] = self.spark.table(catalog_name)
            else:
                df.write.parquet(path)
                self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[name]


    def drop(self) -> None:
        """Takes the stored tables out of the catalog and removes their files;
        frames read from them can't be used any more."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS plantops_{self.id}_{name}")
            remove(self.spark, sub_dir(self.folder, name))
        if self._own_folder:
            remove(self.spark, self.folder)
        self._tables.clear()
        self._clustered.clear()
        self.largest.clear()


_stores: dict[tuple, TableStore] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of change of an input, so that a store is not used for other rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def store_for(spark: SparkSession, inputs: list[str]) -> TableStore:
    """The application's store for these input tables, made on first use."""
    stamps = [_stamp(spark, p) for p in inputs]
    key = (spark.sparkContext.applicationId, shuffle_partitions(spark), *zip(inputs, stamps))
    if key not in _stores:
        by_size = min(sum(size for size, _ in stamps) // BUCKET_INPUT, MAX_BUCKETS)
        _stores[key] = TableStore(spark, buckets=max(shuffle_partitions(spark), by_size))
    return _stores[key]


def drop_stores(spark: SparkSession) -> None:
    """Drops all stores of the application, at its end."""
    for key in [k for k in _stores if k[0] == spark.sparkContext.applicationId]:
        _stores.pop(key).drop()
