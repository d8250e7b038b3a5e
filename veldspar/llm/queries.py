"""The ``opN_*`` queries: each reads its whole table, applies its operator and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, minhash, mixing, oracles, pii, quality, substrings, tokenfile, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern).select("doc_id", "ids")
    both = bpe.decode(ids, path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfile.store_and_read(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@_query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.classes(_read(spark, sf_dir, "documents"), width=2, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


ORACLES["op1_mixing"] = """
WITH RECURSIVE sized AS (
    SELECT *, greatest(coalesce(strlen(text), 0), 1)::DOUBLE AS size FROM documents
), sources AS (
    SELECT source, sum(size) AS size, pow(sum(size), 0.5) AS weight FROM sized GROUP BY source
), rates AS (
    SELECT source, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate FROM sources
), who AS (
    SELECT d.*, rate, 'mix-1' || chr(31) || coalesce(doc_id::VARCHAR, '-') || chr(31) || md5(coalesce(text, '')) AS who
    FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
    SELECT *, (('0x' || substr(md5(who || chr(31) || '0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u FROM who
), tables AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM rates
    UNION ALL
    SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM tables WHERE k < 200
), counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT min(k) FROM tables t WHERE t.source IS NOT DISTINCT FROM d.source AND t.total >= d.u) AS n FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy FROM counted WHERE n > 0
"""


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), found="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join(F.sort_array("kinds"), ",").alias("kinds"))


@_query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_read(spark, sf_dir, "conversations"))


@_query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.links(_read(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@_query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(_read(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))
