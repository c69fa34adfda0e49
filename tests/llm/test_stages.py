"""Pipeline stages on documents with columns of any name and type."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
CLASHES = ("__m", "__t", "__w", "__l", "__score", "__id", "__fp", "__n", "__of", "__root", "__row", "__text", "score", "h", "root", "component_id", "ids")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_and_type_stay(spark, name):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7").withColumn("text", F.lit("another text of this id, long enough to be kept by most rules of all")))
    wide = docs.withColumns({c: F.lit(f"value {c}") for c in CLASHES}).withColumn("extra", F.create_map(F.lit("k"), F.col("lang"))).withColumn("__M2", F.lit(None).cast("string"))
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, out = stage(spark, docs, SF), stage(spark, wide, SF)
    assert out.columns == wide.columns
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert all(r[c] == f"value {c}" for r in rows for c in CLASHES) and all(r.extra == {"k": r.lang} for r in rows)


def test_last_stage_takes_such_columns_too(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    wide = docs.withColumns({c: F.lit("x") for c in (*CLASHES, "start", "length", "sequence_id", "offset", "doc_tokens")})
    pack = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, pack(spark, wide, SF).collect())) == sorted(map(tuple, pack(spark, docs, SF).collect()))
