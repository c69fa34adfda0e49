"""Every registered query: ``(spark, sf_dir) -> DataFrame`` plus, where SQL
can say it, the DuckDB oracle over the raw test tables.

Test parameters (FIXTURES.md section 3) are fixed here: ``as_of``
1998-01-01, slug item group ``ECONOMY``, price revision for supplier 3 on
``Standard Buying`` by 2.5 from 2024-01-01.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from plantops.plans.oracle_views import with_views  # noqa: F401 (re-exported)
from plantops.sources.testdata import erp_from_testdata

AS_OF = dt.date(1998, 1, 1)
AS_OF_SQL = "DATE '1998-01-01'"
SLUG_GROUP_TEST = "ECONOMY"
PRICE_SUPPLIER, PRICE_LIST, PRICE_AMOUNT, PRICE_VALID_FROM = 3, "Standard Buying", 2.5, dt.date(2024, 1, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(erp_from_testdata(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql if sql in ORACLES.values() else with_views(sql)
        return fn
    return deco


# importing the modules fills QUERIES / ORACLES
from plantops.plans import queries_core as _core  # noqa: E402,F401
from plantops.plans import queries_docs as _docs  # noqa: E402,F401
