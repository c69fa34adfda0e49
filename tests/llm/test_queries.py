"""The registered queries: names, oracles, and the pipeline against its stages by hand."""

import corpus_pipeline
import pytest
from oracle_check import compare
from pyspark.sql import functions as F

import __spark_entry__ as E
from plantops.llm import pii, quality, simhash, toxicity
from plantops.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    r = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert r["ok"], r


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    toxic = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    clean = docs.where(~F.col("doc_id").isin(*toxic)) if toxic else docs
    good = {r.doc_id for r in quality.score(clean).where("kept").collect()}
    left = clean.where(F.col("doc_id").isin(*good))
    named = {r.component_id for r in simhash.near_duplicates(left).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == named
    kept = left.where(F.col("doc_id").isin(*named))
    finder = pii.train(kept)
    assert not any(pii.base_spans(r.text) for r in pii.redact(kept, finder).collect())
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_doc.values():
        assert sum(p.length for p in parts) == parts[0].doc_tokens
