"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, minhash, mixing, pii, quality
from veldspar.llm._common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the risk-controlled cutoffs."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group at similarity 0.8 over five words."""
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the new text."""
    columns = docs.columns
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(columns) if "n_chars" in columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents at the target weights of their sources, shuffled."""
    return mixing.mix(docs, copy="_copy").drop("_copy")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with the ids of each text (little-endian unsigned 32-bit integers) and their number; the ids are decoded again as a check."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    # the text goes no further than its encoding: a digest of it is enough to check the way back
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    coded = bpe.encode(docs.select("doc_id", "source", "lang", digest.alias("digest"), "text"), path, pattern).drop("text")
    back = bpe.decode(coded, path, pattern)
    whole = F.sha2("decoded", 256) == F.col("digest")
    checked = back.withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("decoding doesn't give the text back")).cast("binary")))
    return checked.select("doc_id", "source", "lang", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Signatures, byte-pair merges and surrogates have no form in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
