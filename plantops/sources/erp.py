"""The ERP tables the jobs read, as one lazily-built bundle.

``Erp`` maps a table name to a DataFrame builder; a table is built on first
use and then reused (the DataFrame, i.e. the plan -- no data is cached).
Two constructors: :func:`Erp.from_parquet_dir` for ERP exports laid out as
``<dir>/<table>.parquet`` and :func:`plantops.sources.testdata.erp_from_testdata`
for the TPC-H-shaped test tables.

Table names and the columns the jobs need are in
:mod:`plantops.sources.schemas` (ERP ``name`` is the key, child tables carry
``parent`` and ``idx``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from plantops.sources import schemas


class Erp:
    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]],
                 clustered: Callable[[str], bool] = lambda name: False):
        self.spark = spark
        self._is_clustered = clustered
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def unnumbered(self, name: str) -> DataFrame:
        """A table for uses that need no ``idx`` and read few columns: sources
        that must derive or store it name a cheaper builder ``<name>__plain``."""
        plain = f"{name}__plain"
        return self[plain] if plain in self._builders else self[name]

    def unstored(self, name: str) -> DataFrame:
        """A table with its ``idx`` for a query that reads it once, in no
        order of its parents: sources that store it name a builder
        ``<name>__unstored``, which writes less."""
        unstored = f"{name}__unstored"
        return self[unstored] if unstored in self._builders else self[name]

    def clustered(self, name: str) -> bool:
        """The table's rows of one parent lie together, and no parent is too
        large for a task (a bucketed table of a store)."""
        self[name]
        return self._is_clustered(name)

    def tables(self) -> list[str]:
        return sorted(t for t in self._builders if not t.endswith(("__plain", "__unstored")))

    def with_table(self, name: str, df: DataFrame) -> "Erp":
        b = {k: v for k, v in self._builders.items() if k not in (f"{name}__plain", f"{name}__unstored")}
        b[name] = lambda: df
        out = Erp(self.spark, b, lambda t: t != name and self._is_clustered(t))
        out._built = {k: v for k, v in self._built.items() if k != name}
        return out

    @classmethod
    def from_parquet_dir(cls, spark: SparkSession, path: str, tables: list[str]) -> "Erp":
        """Tables of an export; each is held against the input contract when it is first used."""
        def reader(t):
            return lambda: schemas.check(t, spark.read.parquet(f"{path.rstrip('/')}/{t}.parquet"))
        return cls(spark, {t: reader(t) for t in tables})
