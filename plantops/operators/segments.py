"""Sums and first / last marks inside ordered groups, in one pass over the lines.

The segmented form of :mod:`~plantops.operators.ordinal`: rows are ranged on
(keys, order), so a hot group lies in many partitions; an Arrow pass gives each
row the sum of its group so far and says whether its group ends with it; what a
group brings along from earlier partitions, and whether it goes on in the next,
is read from a table with one row for each partition.

Sums are exact: a ``DECIMAL(21,9)`` travels as its whole part and its
billionths, two longs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantops.functions.scalars import QTY
from plantops.operators.ordinal import _key_change
from plantops.session import shuffle_partitions, staging

try:  # as in ordinal: workers need not have this package on their path
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

_PID, _NO, _WHOLE, _NANO, _LAST = "__seg_pid", "__seg_no", "__seg_whole", "__seg_nano", "__seg_last"
_ADDED = [(_NO, T.LongType()), (_LAST, T.BooleanType())]


def _carried(values: np.ndarray, last_start: np.ndarray, before: int) -> np.ndarray:
    """Running sums of each row's segment; ``before`` belongs to the segment
    that goes on from the batch before (rows with no start in this one)."""
    total = np.cumsum(values)
    base = np.where(last_start >= 0, total[last_start] - values[last_start], -before)
    return total - base


def _segments_fn(keys: list[str]):
    def fn(batches):
        prev, no, sums, held = None, 0, (0, 0), None

        def with_last(rb: pa.RecordBatch, last) -> pa.RecordBatch:
            return rb.append_column(_LAST, pa.array(last, pa.bool_()))

        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            starts, ends = np.zeros(n, dtype=bool), []
            for i, k in enumerate(keys):
                col = rb.column(rb.schema.get_field_index(k))
                starts |= _key_change(col, None if prev is None else prev[i])
                ends.append((not col[n - 1].is_valid, col[n - 1].as_py()))
            at = np.arange(n, dtype=np.int64)
            last_start = np.maximum.accumulate(np.where(starts, at, -1))
            number = np.where(last_start >= 0, at - last_start + 1, at + 1 + no)
            running = [_carried(rb.column(rb.schema.get_field_index(c)).to_numpy(zero_copy_only=False), last_start, s)
                       for c, s in zip((_WHOLE, _NANO), sums)]
            prev, no, sums = ends, int(number[-1]), (int(running[0][-1]), int(running[1][-1]))
            for c, r in zip((_WHOLE, _NANO), running):
                rb = rb.set_column(rb.schema.get_field_index(c), c, pa.array(r, pa.int64()))
            rb = rb.append_column(_NO, pa.array(number, pa.int64()))
            if held is not None:
                yield with_last(held, [bool(starts[0])])
            if n > 1:
                yield with_last(rb.slice(0, n - 1), starts[1:])
            held = rb.slice(n - 1)
        if held is not None:
            yield with_last(held, [None])  # the next partition tells
    return fn


def group_marks(df: DataFrame, keys: list[str], order: list[str], value: Column, clustered: bool = False, partitions: int | None = None) -> DataFrame:
    """``df`` with ``is_first``, ``is_last`` (of its group by ``order``) and
    ``running`` (DECIMAL(31,9): ``value`` summed from the group's first row to
    this one, a null counting as 0; at the last row the group's total).

    ``order`` must be total inside a group.  ``clustered``: no group is too
    large for a task (as in a bucketed table), so a window does it, without an
    exchange where the rows already lie together; otherwise the segmented
    pass.  Both give the same rows."""
    exact = F.coalesce(value.cast(QTY), F.lit(0).cast(QTY))
    if clustered:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({"is_first": F.row_number().over(w) == 1, "is_last": F.lead(F.lit(1)).over(w).isNull(),
                               "running": F.sum(exact).over(upto).cast("decimal(31,9)")})
    spark, n = df.sparkSession, partitions or shuffle_partitions(df.sparkSession)
    whole = F.floor(exact).cast("long")
    nano = ((exact - F.floor(exact)) * F.lit(1_000_000_000)).cast("long")
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = (df.withColumns({_WHOLE: whole, _NANO: nano}).repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                .withColumn(_PID, F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(c, t) for c, t in _ADDED]])
    path = staging(spark, "segments")
    ranged.mapInArrow(_segments_fn(keys), schema).write.parquet(path)  # the bounds of a range come from a sample: cut once
    rows = spark.read.schema(schema).parquet(path)

    # one row for each partition: its first and last key, and what its last group has summed up in it
    key = F.struct(*[F.col(k) for k in keys])
    tail = F.struct(key.alias("k"), F.col(_NO).alias("no"), F.col(_WHOLE).alias("whole"), F.col(_NANO).alias("nano"))
    ends = rows.groupBy(_PID).agg(F.min(key).alias("first"), F.max(tail).alias("tail"))
    by_pid = Window.orderBy(_PID)
    same = Window.partitionBy("tail.k").orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    ends = (ends.withColumns({c: F.sum(f"tail.{c}").over(same) for c in ("no", "whole", "nano")})
                .select(F.col(_PID).alias("__p"), "first", F.lead("first").over(by_pid).alias("next"), F.lag("tail.k").over(by_pid).alias("before"),
                        *[F.lag(c).over(by_pid).alias(f"__{c}") for c in ("no", "whole", "nano")]))
    # as many rows as partitions: a bounded broadcast
    out = rows.join(F.broadcast(ends), F.col(_PID) == F.col("__p"))
    goes_on = key.eqNullSafe(F.col("first")) & key.eqNullSafe(F.col("before"))

    def plus(c: str, more: str) -> Column:
        return F.col(c) + F.when(goes_on, F.col(more)).otherwise(F.lit(0).cast("long"))

    billionths = plus(_NANO, "__nano").cast("decimal(22,0)") * F.lit("0.000000001").cast("decimal(10,9)")
    return out.select(
        *df.columns, (plus(_NO, "__no") == 1).alias("is_first"),
        F.coalesce(F.col(_LAST), ~key.eqNullSafe(F.col("next"))).alias("is_last"),
        (plus(_WHOLE, "__whole").cast("decimal(22,0)") + billionths).cast("decimal(31,9)").alias("running"))
