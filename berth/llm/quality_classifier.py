"""Quality classifier: a factorisation machine over words, structure and metadata.

A document's features are its hashed words, statistics of its structure and logarithms of
numeric metadata columns. Null or empty texts have no words and get a score from what is
left; null metadata count as 0. Labels other than 0 and 1, and labels of null keys, teach
nothing; a key with both labels counts as 1, repeated keys count once. Without rows of
both labels all scores are 0.5. Repeated rows get equal scores, an empty table an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm import factorization

_capitals, _symbols, _marks = re.compile(r"[A-Z]").findall, str.maketrans("", "", "#*$%&|<>"), str.maketrans("", "", ".,;:!?'\"()-")


def structure(text: str) -> list[float]:
    """Shares of symbols, capitals, marks, repeated lines and distinct words and windows; sizes."""
    words = text.encode().split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    return [
        math.sqrt((len(text) - len(text.translate(_symbols))) / chars),
        math.sqrt((len(text) - len(text.translate(_marks))) / chars),
        math.sqrt(len(_capitals(text)) / chars),
        math.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        math.sqrt(1 - len(set(windows)) / max(1, len(windows))),
        len(set(words)) / n,
        math.log(chars / n),
        math.log1p(len(words)),
    ]


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", metadata: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is. ``learn``: condition on the key of rows to learn from."""
    metadata = metadata or []
    machine = factorization.train(docs, labels, learn, label, structure, metadata, key, text)
    return docs.withColumn("score", F.lit(0.0) + factorization.score(docs, machine, structure, metadata, text))
