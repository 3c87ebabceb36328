"""The corpus pipeline: quality rules, near duplicates, repeated passages, mix, token ids.

Every stage takes all that the one before kept and returns the columns of documents; the
last adds the ids of each text, packed as little-endian unsigned 32-bit integers, their
number and the digest of the bytes decoded from them, in place of the text. What a stage does with nulls, empty texts, repeated
rows, empty tables and further columns is said by its operator; here a document with a
null text fails the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.llm import bpe, mixing, ngram_join, quality_rules, substring_dedup
from berth.llm.common import unused
from berth.session import scratch


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust quality rules keep."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return substring_dedup.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to.

    Columns that are named like a result (ids, n_tokens, decoded_sha256) give way to it.
    """
    ids, decoded = unused(docs, "ids_of_text", "bytes_of_ids")
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=ids, out=decoded)
    kept = [c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens", "decoded_sha256")]
    return out.select(*kept, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [("rules", rules), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("token_ids", token_ids)]

#: SQL expresses neither the covariance estimates nor the merges; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
