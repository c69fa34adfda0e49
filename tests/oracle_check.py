"""Side-by-side check of a Spark result against a DuckDB oracle, in the way
the driver does it: same column names, same row count, same types (mapped),
same multiset of rows (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
}

_cons: dict[str, duckdb.DuckDBPyConnection] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    if sf_dir not in _cons:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _cons[sf_dir] = con
    return _cons[sf_dir]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return repr(v)


def compare(spark_df, sql: str, sf_dir: str, check_values: bool = True) -> dict:
    con = duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    s_cols = spark_df.columns
    s_types = [f.dataType.simpleString() for f in spark_df.schema.fields]
    s_rows = [tuple(r) for r in spark_df.collect()]
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    out["names_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["names_match"]:
        out["names"] = (sorted(s_cols), sorted(d_cols))
        out["ok"] = False
        return out
    s_t = dict(zip(s_cols, s_types))
    d_t = dict(zip(d_cols, d_types))
    bad_types = {c: (s_t[c], d_t[c]) for c in s_cols
                 if _SPARK_TO_DUCK.get(s_t[c], s_t[c].upper()) != d_t[c]
                 and not (s_t[c].startswith("decimal") and d_t[c].startswith("DECIMAL"))}
    out["types_match"] = not bad_types
    if bad_types:
        out["types"] = bad_types
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    srows = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=repr)
    drows = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=repr)
    out["values_match"] = srows == drows
    if not out["values_match"]:
        sset, dset = set(srows), set(drows)
        out["only_spark"] = [r for r in srows if r not in dset][:3]
        out["only_oracle"] = [r for r in drows if r not in sset][:3]
    out["ok"] = out["values_match"] and out["types_match"] and len(s_rows) == len(d_rows)
    return out
