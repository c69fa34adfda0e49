"""Skew-safe row numbering inside groups (child ``idx``, print ``loop.index``,
document series numbers).

``Window.partitionBy(key).orderBy(...)`` would put a whole group into one
task; if one order holds a third of all lines that task holds a third of the
data.  Instead:

1. range-partition on ``(keys, order)`` -- a hot key is split over many
   partitions because the order columns separate its rows;
2. sort inside partitions and, in one Arrow pass per partition, give each row
   its position inside the run of equal keys *in that partition* (``_run``);
3. a group that spills over partition boundaries needs an offset: per
   partition keep only (first key, last key, length of last run) -- one row
   per partition -- and add up the tails of the preceding partitions with
   the same key;
4. join that table (bounded by the partition count, so broadcast is safe)
   back on (partition, key) and add the offset.

The rows of step 2 are written once to the shared checkpoint folder, and both
uses read them from there: the bounds of a range exchange come from a sample,
so running it twice could cut at other places.  The order must be total inside
a group for the numbering to be deterministic.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plantops.session import shuffle_partitions, staging

try:  # the Arrow pass runs on executors: ship this module by value, so a
    # worker needs numpy/pyarrow but not this package on its path
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: ship the package with --py-files
    pass

_PID, _RUN, _OFF = "_plantops_pid", "_plantops_run", "_plantops_off"
_BINS = 1 << 14


def _key_change(col: pa.ChunkedArray | pa.Array, prev) -> np.ndarray:
    """Boolean array: row i starts a new value compared to row i-1 (row 0
    compared to ``prev``, a (is_null, value) tuple or None)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    nulls = col.is_null().to_numpy(zero_copy_only=False)
    vals = col.to_pylist() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) \
        else pc.fill_null(col, pa.scalar(0, col.type)).to_numpy(zero_copy_only=False)
    vals = np.asarray(vals, dtype=object) if isinstance(vals, list) else vals
    out = np.empty(n, dtype=bool)
    if n == 0:
        return out
    out[1:] = (nulls[1:] != nulls[:-1]) | ((vals[1:] != vals[:-1]) & ~nulls[1:])
    if prev is None:
        out[0] = True
    else:
        pnull, pval = prev
        out[0] = (bool(nulls[0]) != pnull) or (not nulls[0] and vals[0] != pval)
    return out


def _runs_fn(keys: list[str]):
    def fn(batches):
        prev = None          # per key: (is_null, value) of the last row seen
        prev_run = 0
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            starts = np.zeros(n, dtype=bool)
            last_vals = []
            for i, k in enumerate(keys):
                col = rb.column(rb.schema.get_field_index(k))
                starts |= _key_change(col, None if prev is None else prev[i])
                last = col[n - 1]
                last_vals.append((not last.is_valid, last.as_py()))
            pos = np.arange(n, dtype=np.int64)
            last_start = np.maximum.accumulate(np.where(starts, pos, -1))
            run = np.where(last_start >= 0, pos - last_start + 1, pos + 1 + prev_run)
            prev, prev_run = last_vals, int(run[-1])
            yield rb.append_column(_RUN, pa.array(run, type=pa.int64()))
    return fn


def ordinal(df: DataFrame, keys: list[str], order: list, name: str = "idx",
            partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its ``keys`` group,
    ordered by ``order`` (ascending).  ``keys`` may be empty: then the whole
    frame is one group (a dense global numbering, still distributed)."""
    n = partitions or shuffle_partitions(df.sparkSession)
    order_cols: list[Column] = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in keys]
    base = df
    if not keys:
        base = base.withColumn("_plantops_all", F.lit(0))
        keys = ["_plantops_all"]
        key_cols = [F.col("_plantops_all")]
    srt = (base.repartitionByRange(n, *key_cols, *order_cols)
               .sortWithinPartitions(*key_cols, *order_cols)
               .withColumn(_PID, F.spark_partition_id()))
    schema = StructType(srt.schema.fields + [StructField(_RUN, LongType(), False)])
    path = staging(df.sparkSession, "ordinal")
    srt.mapInArrow(_runs_fn(keys), schema).write.parquet(path)
    runs = df.sparkSession.read.schema(schema).parquet(path)

    # one row per non-empty partition: its first key, its last key and the
    # length of the last key's run inside it
    kstruct = F.struct(*[F.col(k) for k in keys])
    stats = (runs.groupBy(_PID)
                 .agg(F.min(kstruct).alias("fk"),
                      F.max(F.struct(*[F.col(k) for k in keys], F.col(_RUN))).alias("lst"))
                 .select(_PID, "fk",
                         F.struct(*[F.col("lst")[k].alias(k) for k in keys]).alias("lk"),
                         F.col("lst")[_RUN].alias("ll")))
    by_last = Window.partitionBy("lk").orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    by_pid = Window.orderBy(_PID)  # one row per partition: a bounded single task
    offsets = (stats.withColumn("cum", F.sum("ll").over(by_last))
                    .withColumn("prev_lk", F.lag("lk").over(by_pid))
                    .withColumn("prev_cum", F.lag("cum").over(by_pid))
                    .where(F.col("prev_lk").eqNullSafe(F.col("fk")))
                    .select(F.col(_PID).alias("_o_pid"),
                            *[F.col("fk")[k].alias(f"_o_{k}") for k in keys],
                            F.col("prev_cum").alias(_OFF)))
    # offsets has at most `n` rows (one per range partition): broadcast is bounded
    cond = [runs[_PID] == F.col("_o_pid")] + [runs[k].eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    out = (runs.join(F.broadcast(offsets), cond, "left")
               .withColumn(name, (F.col(_RUN) + F.coalesce(F.col(_OFF), F.lit(0))).cast("long")))
    drop = [_PID, _RUN, _OFF, "_o_pid", *[f"_o_{k}" for k in keys]]
    if "_plantops_all" in keys:
        drop.append("_plantops_all")
    return out.drop(*drop)


def global_ordinal(df: DataFrame, order: list, name: str = "seq",
                   partitions: int | None = None) -> DataFrame:
    """Dense 1..N numbering of a whole frame without a single-task window: the
    ranged, sorted rows are numbered inside their partitions and written once,
    and each partition is moved by the rows of those before it."""
    n = partitions or shuffle_partitions(df.sparkSession)
    cols: list[Column] = [F.col(c) if isinstance(c, str) else c for c in order]
    # the lower 33 bits count the rows of a partition
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    srt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumns({_PID: F.spark_partition_id(), _RUN: inside})
    path = staging(df.sparkSession, "ordinal")
    srt.write.parquet(path)
    rows = df.sparkSession.read.schema(srt.schema).parquet(path)
    earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition: a bounded single task
    offsets = rows.groupBy(_PID).agg(F.max(_RUN).alias("ll")).select(F.col(_PID).alias("_o_pid"), F.coalesce(F.sum("ll").over(earlier), F.lit(0)).alias(_OFF))
    # at most `n` rows: broadcast is bounded
    return (rows.join(F.broadcast(offsets), F.col(_PID) == F.col("_o_pid"))
                .withColumn(name, (F.col(_RUN) + F.col(_OFF)).cast("long")).drop(_PID, _RUN, _OFF, "_o_pid"))


def largest_group(df: DataFrame, keys: list[str], enough: int) -> int:
    """Rows of the largest group, or a bound for it that is not over ``enough``.
    Rows are counted by a hash of their keys first, so a task sends at most
    ``_BINS`` counts; only if such a bin holds more are the groups counted."""
    by_hash = df.select(F.pmod(F.xxhash64(*keys), F.lit(_BINS)).alias("bin"))
    bound = by_hash.groupBy("bin").count().agg(F.max("count")).first()[0] or 0
    if bound <= enough:
        return bound
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "idx", hot_rows: int = 1_000_000,
             partitions: int | None = None, deal: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """:func:`ordinal` for rows whose groups are usually small: the largest
    group is measured first (or told by ``largest``); up to ``hot_rows`` a
    window numbers the rows where a shuffle on the keys puts them, beyond it
    :func:`ordinal` splits the group.  Both give the same numbers.

    ``partitions``: that shuffle deals the rows into so many tasks, which AQE
    does not join into larger ones, by ``deal`` (columns that the keys include
    or decide) instead of the keys."""
    if largest is None:
        largest = largest_group(df, keys, hot_rows)
    if largest > hot_rows:
        return ordinal(df, keys, order, name)
    if partitions:
        df = df.repartition(partitions, *(deal or keys))
        keys = [*(deal or []), *[k for k in keys if k not in (deal or [])]]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
