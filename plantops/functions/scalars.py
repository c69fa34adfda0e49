"""Scalar helpers (survey M1-M11), all built-in Column expressions.

Quantities are summed as ``DECIMAL(21,9)`` (the ERP storage type) and emitted
as DOUBLE, so totals do not depend on the order in which partial sums meet.
Rounding of money/qty goes through DECIMAL too, half-even as both the ERP's
``flt`` and Python's ``round`` do.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

QTY = "decimal(21,9)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qty(x) -> Column:
    """A quantity as DECIMAL(21,9); text that is no number is NULL."""
    return _c(x).cast("string").try_cast(QTY)


def qty_sum(x) -> Column:
    """SUM of a quantity column, exact (decimal) and emitted as DOUBLE."""
    return F.sum(_c(x).try_cast(QTY)).cast("double")


def excess5(x) -> Column:
    """M1: ``float(qty*0.05) + qty`` per row, in DOUBLE like the reference."""
    q = _c(x).try_cast("double")
    return q * F.lit(0.05) + q


def plus5(total) -> Column:
    """A total with 5 % excess: an exact decimal sum times 1.05."""
    return (_c(total) * F.lit(1.05).cast("decimal(3,2)")).cast("double")


def _number(x) -> Column:
    return F.replace(_c(x).cast("string"), F.lit(","), F.lit("")).try_cast("double")


def flt(x, default: float = 0.0) -> Column:
    """M4: ERP ``flt``: parse a number (thousands commas go), NULL/blank/garbage -> 0."""
    return F.coalesce(_number(x), F.lit(default))


def cint(x, default: int = 0) -> Column:
    """M4: ERP ``cint``: parse an integer (truncating), NULL/garbage/overflow -> 0."""
    return F.coalesce(_number(x).try_cast("long"), F.lit(default).cast("long"))


def round2(x) -> Column:
    """M3: ``flt(x, 2)``: NULL, blank or text that is no number -> 0 (thousands
    commas go), banker's rounding to 2 places (via decimal)."""
    number = F.replace(_c(x).cast("string"), F.lit(","), F.lit(""))
    return F.coalesce(F.bround(number.try_cast(QTY), 2), F.lit(0).cast(QTY))


def or_zero(x) -> Column:
    """M5: Python ``x or 0``."""
    return F.coalesce(_c(x), F.lit(0))


def days_left(delivery, as_of) -> Column:
    """M6: ``max((delivery - as_of).days, 0)``."""
    return F.greatest(F.datediff(_c(delivery), _date(as_of)), F.lit(0)).cast("int")


def add_days(date, days) -> Column:
    """M7: ``add_days(date, cint(days))``; NULL where no calendar reaches
    (the result lies outside the years 1 to 9999)."""
    day = _c(date).cast("date")
    n = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("decimal(38,0)") + cint(days).cast("decimal(38,0)")
    return F.when(n.between(-719162, 2932896), F.date_add(day, cint(days).try_cast("int")))


def non_blank(x) -> Column:
    """``["!=", ""]`` on a Data field: NULL and "" both fail."""
    return F.coalesce(_c(x), F.lit("")) != F.lit("")


def slice_from(x, start: int) -> Column:
    """M9: Python ``s[start:]`` (0-based) on a string."""
    return F.substring(_c(x).cast("string"), start + 1, 1 << 30)


def _date(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, (_dt.date, _dt.datetime)):
        return F.lit(x.isoformat()[:10]).cast("date")
    if isinstance(x, str):
        return F.to_date(F.lit(x))
    raise TypeError(f"not a date: {x!r}")


def as_date(x) -> Column:
    return _date(x)
