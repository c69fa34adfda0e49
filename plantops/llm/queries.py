"""The registered queries of this package: thin callables over its operators
with production parameters, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantops.llm import ann, bpe, decontam, manifest, packing, pii, quality, quotes, sharding, simhash, toxicity, warc, whitening
from plantops.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """Vocabulary file of the production tokenizer; ``PLANTOPS_TOKENIZER`` names another."""
    given = os.environ.get("PLANTOPS_TOKENIZER")
    if given:
        return given
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def shipped(fn: Callable) -> Callable:
    """fn(spark, ...) with this package sent to the executors first."""
    @functools.wraps(fn)
    def run(spark: SparkSession, *args):
        ship(spark)
        return fn(spark, *args)
    return run


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = shipped(fn)
    return QUERIES[fn.__name__]


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 2048 tokens."""
    return digest_pieces(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    return quality.score(table(spark, sf_dir, "documents"))


ORACLES["op6_quality"] = quality.oracle_sql()


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading back the archives of all pages gives for each page."""
    read = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper > page_id THEN keeper END AS refers_to
FROM k"""


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by cosine for every vec_id divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


#: Sums run over the components in order, as the operator's exact check does.
ORACLES["op9_ann"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v WHERE len(e) > 0),
c AS (SELECT * FROM n WHERE norm > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_reduce(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
      FROM c AS q JOIN c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.report(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLES["op11_decontamination"] = decontam.oracle_sql()


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every embedding."""
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), components=32))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document against the manifest of all, some of them tampered with."""
    return manifest.verify(manifest.proofs(manifest.build(table(spark, sf_dir, "documents"), manifest.lower_some())))


ORACLES["op13_manifest"] = manifest.oracle_sql()
