"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.llm import bpe, embedding_dedup, fill_middle, language_id, mixing, ngram_join, quality_classifier, quality_rules, secret_links, spelling, substring_dedup, token_files, toxicity
from berth.llm.common import fold, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents"))


ORACLES["op5_pareto_mix"] = mixing.SQL


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), unit="line")


ORACLES["op1_line_dedup"] = substring_dedup.SQL


@query
def op1_piece_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), unit="piece")


def _scored(out: DataFrame, held_out: Column, least: float) -> DataFrame:
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return out.select("doc_id", "score", held).select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels")
    out = quality_classifier.classify(docs, labels, learn=fold("doc_id", 3) != 1, metadata=["n_chars"])
    return _scored(out, fold("doc_id", 3) == 1, 0.5)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity.classify(docs, labels, learn=fold("doc_id", 4) != 2)
    return _scored(out, fold("doc_id", 4) == 2, 0.3)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.train(docs, learn=fold("doc_id", 3) != 1)
    out = language_id.identify(docs.drop("lang"), network)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


@query
def op11_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.report(table(spark, sf_dir, "documents"))


ORACLES["op11_secret_links"] = secret_links.SQL


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


ORACLES["op12_fill_middle"] = fill_middle.SQL


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = spelling.SQL
