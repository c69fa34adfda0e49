"""the ERP filter dict turned into a Column.

Accepted shapes (as in ``get_all(filters=...)``)::

    {"docstatus": 1}                    equality, ANDed
    {"work_order": ["!=", ""]}          not-equal ("" also drops NULL)
    {"status": ["in", ["A", "B"]]}      membership
    {"qty": [">", 5]}                   comparisons
    [["Sales Order", "docstatus", "=", 1], ...]   list form (doctype ignored)

Values become literals of the field's type through the Column API, never SQL
text.  As in the ERP, ``!=``, ``not in`` and an ``in`` list with a blank see a
NULL as the blank of the field's type: "" for text, 0 for numbers, the first
day of year 1 for dates, false for checks.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIRST_DAY = dt.date(1, 1, 1)


def _blank(kind: T.DataType):
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.NumericType):
        return 0
    if isinstance(kind, T.DateType):
        return _FIRST_DAY
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.combine(_FIRST_DAY, dt.time())
    return ""


def _read(value, kind: T.DataType):
    """``value`` as the field's type; None and "" are its blank.  A value that
    cannot be read as that type raises ValueError."""
    if value is None or value == "":
        return _blank(kind)
    try:
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else bool(int(value))
        if isinstance(kind, T.IntegralType):
            number = Decimal(str(value))
            return int(number) if number == int(number) else number
        if isinstance(kind, T.FractionalType):
            return Decimal(str(value)) if isinstance(kind, T.DecimalType) else float(value)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(str(value)[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return dt.datetime.fromisoformat(str(value))
    except (ArithmeticError, TypeError, ValueError):
        raise ValueError(f"{value!r} is no {kind.simpleString()}") from None
    return str(value)


def _literal(value, kind: T.DataType) -> Column:
    if value == _FIRST_DAY or (isinstance(value, dt.datetime) and value.year == 1):
        return F.lit(str(value)).cast(kind)  # before the range of Python's time stamps
    return F.lit(value)


def _one(field: str, op: str, value, schema: T.StructType) -> Column:
    c, kind, op = F.col(field), schema[field].dataType, op.lower().strip()
    lit = lambda v: _literal(_read(v, kind), kind)
    filled = F.coalesce(c, _literal(_blank(kind), kind))
    if op in ("=", "=="):
        return c.isNull() if value is None else c == lit(value)
    if op == "!=":
        return filled != lit(value)
    if op in ("in", "not in"):
        found = F.lit(False)
        if len(value):
            has_blank = any(v is None or v == "" for v in value)
            found = (filled if has_blank or op == "not in" else c).isin([lit(v) for v in value])
        return ~found if op == "not in" else found
    if op in (">", ">=", "<", "<="):
        v = lit(value)
        return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    if op == "is":
        return c.isNotNull() if str(value).lower() == "set" else c.isNull()
    if op == "like":
        return c.like(value)
    raise ValueError(f"unsupported filter operator {op!r}")


def compile_filters(filters, schema: T.StructType) -> Column | None:
    """Translate an ERP filter spec into one Column (or None for no filter)."""
    if not filters:
        return None
    conds: list[Column] = []
    if isinstance(filters, dict):
        for field, spec in filters.items():
            if isinstance(spec, (list, tuple)) and len(spec) == 2 and isinstance(spec[0], str):
                conds.append(_one(field, spec[0], spec[1], schema))
            else:
                conds.append(_one(field, "=", spec, schema))
    else:
        for spec in filters:
            field, op, value = spec[1:] if len(spec) == 4 else spec
            conds.append(_one(field, op, value, schema))
    return reduce(lambda a, b: a & b, conds)


def apply_filters(df: DataFrame, filters) -> DataFrame:
    cond = compile_filters(filters, df.schema)
    return df if cond is None else df.where(cond)
