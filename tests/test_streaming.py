import datetime as dt
import tempfile

from plantops.plans.registry import AS_OF
from plantops.sources.testdata import ORDERS_SCHEMA, doc_from_orders, erp_from_testdata
from plantops.streaming.checklist_stream import process_batch, run_checklist_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    from plantops.operators.checklists import checklist_transactions
    erp = erp_from_testdata(spark, SF)
    stream = spark.readStream.schema(ORDERS_SCHEMA).parquet(f"{SF}/orders.parque[t]")
    folder = tempfile.mkdtemp(prefix="plantops-stream-test-")
    headers, rows, _ = run_checklist_stream(spark, erp, doc_from_orders(stream), AS_OF, base=folder)
    batch = checklist_transactions(erp, AS_OF)
    key = ["reference", "grb_nomrn_no_date", "line_idx"]
    assert headers.count() == batch.headers.count()
    assert headers.select(*batch.headers.columns).exceptAll(batch.headers).count() == 0
    assert rows.count() == batch.rows.count()
    seqs = sorted(r.seq for r in headers.collect())
    assert seqs == list(range(1, len(seqs) + 1))
    # replaying the same batch (e.g. after a crash) adds nothing
    process_batch(erp, erp.doc, 0, f"{folder}/sink", AS_OF)
    assert spark.read.parquet(f"{folder}/sink/headers").count() == headers.count()
    assert spark.read.parquet(f"{folder}/sink/rows").count() == rows.count()
    assert headers.groupBy(*key).count().where("count > 1").count() == 0


def test_second_batch_continues_the_series(spark):
    from pyspark.sql import functions as F

    from plantops.operators.checklists import checklist_transactions
    erp = erp_from_testdata(spark, SF)
    sink = tempfile.mkdtemp(prefix="plantops-stream-test-")
    even = F.pmod(F.xxhash64("doctype", "name"), F.lit(2)) == 0
    process_batch(erp, erp.doc.where(even), 0, sink, AS_OF)
    before = {r["name"]: r.seq for r in spark.read.parquet(f"{sink}/headers").collect()}
    # new documents, and all those of the first batch delivered again
    process_batch(erp, erp.doc, 1, sink, AS_OF)
    headers = spark.read.parquet(f"{sink}/headers").collect()
    whole = checklist_transactions(erp, AS_OF)
    assert sorted(before.values()) == list(range(1, len(before) + 1)) and 0 < len(before) < len(headers)
    assert sorted(r.seq for r in headers) == list(range(1, whole.headers.count() + 1))
    assert {r["name"]: r.seq for r in headers if r.batch_id == 0} == before
    assert all(r.seq > len(before) for r in headers if r.batch_id == 1)
    assert spark.read.parquet(f"{sink}/rows").count() == whole.rows.count()


KEYS = ["reference", "grb_nomrn_no_date", "line_idx"]


def _all_lines(erp):
    from plantops.operators.checklists import document_lines
    return {(r.doctype, r["name"], r.idx) for r in document_lines(erp).collect()}


def _folder():
    return tempfile.mkdtemp(prefix="plantops-stream-test-")


def test_rejects_are_driven_again_when_the_item_gets_a_checklist(spark):
    from pyspark.sql import functions as F

    from plantops.streaming.checklist_stream import open_rejects
    erp = erp_from_testdata(spark, SF)
    sink, third = _folder(), F.pmod(F.xxhash64("doctype", "name"), F.lit(3))
    process_batch(erp, erp.doc.where(third == 0), 0, sink, AS_OF)
    process_batch(erp, erp.doc.where(third == 1), 1, sink, AS_OF)
    made = lambda: {tuple(r) for r in spark.read.parquet(f"{sink}/headers").select(*KEYS).collect()}
    left = lambda e: {tuple(r) for r in open_rejects(e, sink, AS_OF).select(*KEYS).collect()}
    lines = {x for x in _all_lines(erp.with_table("doc", erp.doc.where(third < 2)))}
    first = left(erp)
    assert first and made() | first == lines and not made() & first
    # the items get a checklist; the next batch takes the dead letters along
    item = erp.item.withColumn("custom_checklist", F.coalesce("custom_checklist", F.lit("General")))
    better = erp.with_table("item", item)
    process_batch(better, erp.doc.where(third == 2), 2, sink, AS_OF)
    assert made() == _all_lines(erp) and left(better) == set()
    rows = spark.read.parquet(f"{sink}/headers")
    assert sorted(r.seq for r in rows.collect()) == list(range(1, rows.count() + 1))
    redriven = {tuple(r) for r in rows.where("batch_id = 2").select(*KEYS).collect()}
    assert first <= redriven
    assert spark.read.parquet(f"{sink}/rows").select(*KEYS).distinct().count() <= rows.count()


def test_files_read_do_not_grow_over_twenty_batches(spark):
    from plantops.streaming import checklist_stream as S
    sink, read = _folder(), []
    for b in range(21):
        taken = S.taken_documents(spark, sink, b)
        if taken is not None:
            assert sorted(map(tuple, taken.collect())) == sorted(("PR", f"D-{i}") for i in range(3 * b))
        read.append(0 if taken is None else len(taken.inputFiles()))
        keys = spark.createDataFrame([("PR", f"D-{i}") for i in range(3 * b, 3 * b + 3)], "doctype string, name string")
        S._write_run(keys, S._run_path(sink, 0, b))
    assert max(read) <= 3 * 3 and read[20] <= max(read[:16])


def test_documents_delivered_again_in_later_batches(spark):
    from pyspark.sql import functions as F

    from plantops.operators.checklists import checklist_transactions
    erp = erp_from_testdata(spark, SF)
    few = erp.doc_item.where("idx = 1").orderBy("parent").limit(30).collect()
    names = sorted({r.parent for r in few})
    local = lambda df: spark.createDataFrame(df.collect(), df.schema)
    docs = local(erp.doc.where(F.col("name").isin(names)))
    small = erp.with_table("doc_item", spark.createDataFrame(few, erp.doc_item.schema)).with_table("doc", docs)
    sink = _folder()
    for b in (0, 1, 2, 3, 4, 6):  # batch 5 never came
        process_batch(small, docs.where(F.col("name").isin(names[max(0, 4 * b - 3):4 * b + 4])), b, sink, AS_OF)
    headers = spark.read.parquet(f"{sink}/headers")
    seen = [n for b in (0, 1, 2, 3, 4, 6) for n in names[max(0, 4 * b - 3):4 * b + 4]]
    want = checklist_transactions(small.with_table("doc", docs.where(F.col("name").isin(seen))), AS_OF).headers
    assert headers.groupBy(*KEYS).count().where("count > 1").count() == 0 and headers.count() == want.count() > 0
    assert sorted(r.seq for r in headers.collect()) == list(range(1, headers.count() + 1))


def test_a_batch_that_broke_off_is_worked_on_again(spark, monkeypatch):
    import pytest
    from pyspark.sql import functions as F

    from plantops.operators.checklists import checklist_transactions
    from plantops.streaming import checklist_stream as S
    erp = erp_from_testdata(spark, SF)
    even = F.pmod(F.xxhash64("doctype", "name"), F.lit(2)) == 0
    sink = _folder()
    process_batch(erp, erp.doc.where(even), 0, sink, AS_OF)
    run_path = S._run_path
    monkeypatch.setattr(S, "_run_path", lambda s, level, number: run_path(s, level, number) if number == 0 else 1 / 0)
    with pytest.raises(ZeroDivisionError):  # headers, rows and open rejects are written, the ledger and the mark are not
        process_batch(erp, erp.doc, 1, sink, AS_OF)
    monkeypatch.undo()
    for _ in range(2):
        process_batch(erp, erp.doc, 1, sink, AS_OF)
    whole = checklist_transactions(erp, AS_OF)
    headers = spark.read.parquet(f"{sink}/headers")
    assert headers.count() == whole.headers.count() and spark.read.parquet(f"{sink}/rows").count() == whole.rows.count()
    assert sorted(r.seq for r in headers.collect()) == list(range(1, headers.count() + 1))


def test_ledger_runs_cover_all_earlier_batches_once():
    from plantops.streaming.checklist_stream import FAN, ledger_runs
    for b in range(300):
        runs = ledger_runs(b)
        assert [x for level, r in runs for x in range(r * FAN ** level, (r + 1) * FAN ** level)] == list(range(b))
        assert len(runs) <= 3 * 5


def test_latest_version_of_a_document_counts(spark):
    from plantops.streaming.checklist_stream import latest_version
    rows = [("PR", "D-1", 5, "2024-01-01"), ("PR", "D-1", 3, "2024-02-01"), ("DN", "D-1", 7, None), ("DN", "D-1", 8, None), ("DN", "D-1", 8, None)]
    df = spark.createDataFrame(rows, "doctype string, name string, supplier int, modified string")
    assert sorted(map(tuple, latest_version(df).collect())) == [("DN", "D-1", 8, None), ("PR", "D-1", 3, "2024-02-01")]
