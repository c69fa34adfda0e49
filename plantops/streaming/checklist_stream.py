"""Checklists for newly arriving documents, as a Structured Streaming job.

The reference creates checklists in an ``after_insert`` hook, one document at
a time.  Here new document headers arrive on a file stream; each micro-batch
meets the static line/item/template tables inside ``foreachBatch``.  The sink
holds, in a folder for each batch:

* ``lines``: the document lines that the batch works on, its own and the open
  rejects of the batch before;
* ``headers`` and ``rows``: the checklists made of them;
* ``open``: the dead letters, all lines that have no checklist so far.  Each
  batch drives those of the batch before again, so a line gets its checklist
  in the first batch after its item has one;
* ``marks``: the last series number given out, written at the end;
* ``ledger``: the documents taken, see below.

No batch scans the sink.  It reads ``marks`` and ``open`` of its predecessor,
and the ledger, which says which documents earlier batches have taken (a
document may be delivered again).  The ledger is kept in runs like a counter's
digits: every batch adds a run, and four neighbouring runs of a level become
one of the next, so that a batch reads at most three runs of each level.

Exactly-once, also when a batch is replayed after a failure: a batch with its
mark is done and adds nothing; one without is worked on again from the same
inputs and overwrites its own folders.  The printable series ``CL/24-25/####``
goes on from the predecessor's mark, in the order of the keys, by the
distributed numbering.

Sink and checkpoint live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plantops.operators.checklists import KEY, checklist_transactions, document_lines
from plantops.operators.ordinal import global_ordinal
from plantops.session import run_folder, staging, sub_dir
from plantops.sources.erp import Erp

DOC_KEY = ["doctype", "name"]
FAN = 4  # runs of the ledger that become one of the next level
SERIES_PREFIX = "CL/24-25/"


def _done(spark: SparkSession, path: str) -> bool:
    """A folder that Spark has written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(sub_dir(path, "_SUCCESS"))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _at(sink: str, part: str, batch_id: int) -> str:
    return sub_dir(sink, part, f"batch_id={batch_id}")


def _predecessor(spark: SparkSession, sink: str, batch_id: int) -> int | None:
    """The last batch before this one that was done (ids may leave gaps)."""
    return next((b for b in range(batch_id - 1, -1, -1) if _done(spark, _at(sink, "marks", b))), None)


def ledger_runs(batch_id: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold all batches before ``batch_id``;
    run r of level l holds the batches from r * FAN^l on, FAN^l of them."""
    runs, taken, level = [], 0, 0
    while FAN ** (level + 1) <= batch_id:
        level += 1
    while level >= 0:
        while taken + FAN ** level <= batch_id:
            runs.append((level, taken // FAN ** level))
            taken += FAN ** level
        level -= 1
    return runs


def _run_path(sink: str, level: int, number: int) -> str:
    return sub_dir(sink, "ledger", f"level={level}", f"run={number}")


def _ensure_run(spark: SparkSession, sink: str, level: int, number: int) -> str | None:
    """The folder of a run, merged from the level below if it is not there;
    None if none of its batches has been."""
    path = _run_path(sink, level, number)
    if _done(spark, path):
        return path
    if level == 0:
        return None
    below = [p for i in range(FAN) if (p := _ensure_run(spark, sink, level - 1, number * FAN + i))]
    if not below:
        return None
    _write_run(spark.read.schema(_LEDGER).parquet(*below), path)
    return path


def _write_run(keys: DataFrame, path: str) -> None:
    """A run's files are as large as the session's advisory size, not one for each task."""
    keys.hint("rebalance").write.mode("overwrite").parquet(path)


_LEDGER = T.StructType([T.StructField(c, T.StringType()) for c in DOC_KEY])


def taken_documents(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """Keys of the documents of all batches before ``batch_id``."""
    paths = [p for run in ledger_runs(batch_id) if (p := _ensure_run(spark, sink, *run))]
    return spark.read.schema(_LEDGER).parquet(*paths) if paths else None


def latest_version(docs: DataFrame) -> DataFrame:
    """One row for each document: the last ``modified`` (if there is such a
    column), then the greatest in the order of its columns."""
    others = [c for c in docs.columns if c not in DOC_KEY]
    order = sorted(others, key=lambda c: c != "modified")
    best = docs.groupBy(*DOC_KEY).agg(F.max(F.struct(*order)).alias("__latest"))
    return best.select(*[F.col(c) if c in DOC_KEY else F.col(f"__latest.{c}").alias(c) for c in docs.columns])


def process_batch(erp: Erp, docs: DataFrame, batch_id: int, sink: str, as_of) -> None:
    """One micro-batch: checklists for ``docs``, and for open rejects whose
    items have a checklist now, written to ``sink``.  What is staged for the
    numbering is removed at the batch's end."""
    spark = docs.sparkSession
    if _done(spark, _at(sink, "marks", batch_id)):
        return
    with run_folder(spark):
        _write_batch(erp, docs, batch_id, sink, as_of)


def _write_batch(erp: Erp, docs: DataFrame, batch_id: int, sink: str, as_of) -> None:
    spark = docs.sparkSession
    before = _predecessor(spark, sink, batch_id)
    once = latest_version(docs)
    taken = taken_documents(spark, sink, batch_id)
    fresh = once if taken is None else once.join(taken, DOC_KEY, "left_anti")

    lines = document_lines(erp.with_table("doc", fresh))
    if before is not None:
        lines = lines.unionByName(spark.read.schema(lines.schema).parquet(_at(sink, "open", before)))
    lines.write.mode("overwrite").parquet(_at(sink, "lines", batch_id))
    cl = checklist_transactions(erp, as_of, lines=spark.read.schema(lines.schema).parquet(_at(sink, "lines", batch_id)))

    mark = spark.read.parquet(_at(sink, "marks", before)).first() if before is not None else None
    high_water = mark["last_seq"] if mark else 0
    numbered = global_ordinal(cl.headers.select(*KEY), KEY, "seq").withColumn("seq", F.col("seq") + F.lit(high_water))
    headers = cl.headers.join(numbered, KEY).withColumn("name", F.format_string(SERIES_PREFIX + "%04d", F.col("seq")))
    headers.write.mode("overwrite").parquet(_at(sink, "headers", batch_id))
    cl.rows.write.mode("overwrite").parquet(_at(sink, "rows", batch_id))
    cl.rejected_lines.write.mode("overwrite").parquet(_at(sink, "open", batch_id))
    _write_run(fresh.select(*[F.col(c).cast("string").alias(c) for c in DOC_KEY]), _run_path(sink, 0, batch_id))
    written = spark.read.schema(headers.schema).parquet(_at(sink, "headers", batch_id)).count()
    spark.createDataFrame([(high_water + written,)], "last_seq long").write.mode("overwrite").parquet(_at(sink, "marks", batch_id))


def open_rejects(erp: Erp, sink: str, as_of) -> DataFrame:
    """The dead letters after the last batch that was done, with the reason
    that holds now (columns of C1's rejects)."""
    spark = erp.spark
    folder = spark._jvm.org.apache.hadoop.fs.Path(sub_dir(sink, "marks"))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    ids = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder) if "=" in f.getPath().getName()]
    last = _predecessor(spark, sink, max(ids) + 1)
    lines = spark.read.parquet(_at(sink, "open", last))
    return checklist_transactions(erp, as_of, lines=lines).rejects


def start_checklist_stream(erp: Erp, doc_stream: DataFrame, sink: str, checkpoint: str,
                           as_of: dt.date | str, available_now: bool = True) -> StreamingQuery:
    """Start the stream: ``doc_stream`` is a streaming frame of document
    headers (columns of the ``doc`` table)."""
    writer = (doc_stream.writeStream
              .foreachBatch(lambda df, bid: process_batch(erp, df, bid, sink, as_of))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_checklist_stream(spark: SparkSession, erp: Erp, doc_stream: DataFrame, as_of,
                         base: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Run the stream over everything available and return the sink
    ``(headers, rows, folder)``."""
    folder = base or staging(spark, "checklist-stream")
    q = start_checklist_stream(erp, doc_stream, sub_dir(folder, "sink"), sub_dir(folder, "checkpoint"), as_of)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    sink = sub_dir(folder, "sink")
    return (spark.read.parquet(sub_dir(sink, "headers")), spark.read.parquet(sub_dir(sink, "rows")), folder)
