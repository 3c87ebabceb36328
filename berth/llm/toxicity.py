"""Toxicity: a factorisation machine over hashed words learns which pairs are toxic.

Words count once each, in any case, so that length and repetition don't matter. Null or
empty texts have no words and get the score of none. Labels other than 0 and 1, and labels
of null keys, teach nothing; a key with both labels counts as 1, repeated keys count once.
Without rows of both labels all scores are 0.5. Repeated rows get equal scores, an empty
table an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm import factorization


def _none(text: str) -> list[float]:
    return []


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is. ``learn``: condition on the key of rows to learn from."""
    machine = factorization.train(docs, labels, learn, label, _none, [], key, text)
    return docs.withColumn("score", F.lit(0.0) + factorization.score(docs, machine, _none, [], text))
