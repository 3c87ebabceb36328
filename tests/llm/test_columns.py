"""Operators that return their input's columns leave those alone that are named like working columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from berth.llm import bpe, language_id, mixing, ngram_join, quality_rules, substring_dedup

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORKING = [
    "__key", "__hash", "__cut", "__again", "__rank", "__source", "__size", "__u", "__appeal", "__copy", "__copies", "__whole", "__p", "__bin", "__total", "__target",
    "__lang", "__stats", "__fit", "__fit0", "__failed", "__distance", "__kept", "__cid", "__k", "__c", "__both", "__ids", "__decoded", "__letters", "__named", "key", "cid", "root",
]


class Same:
    """A network that calls every text one language."""

    languages = ["xx"]

    def pooled(self, texts):
        import numpy as np

        return np.ones((len(texts), 1))


OPERATORS = {
    "remove": substring_dedup.remove, "mix": mixing.mix, "filter": quality_rules.filter_documents, "deduplicate": ngram_join.deduplicate,
    "round_trip": lambda d: bpe.round_trip(d, RANKS, P.PATTERN), "digests": lambda d: bpe.digests(d, RANKS, P.PATTERN),
    "identify": lambda d: language_id.identify(d, Same()), "token_ids": lambda d: corpus_pipeline.token_ids(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_working_names_are_free(spark, name):
    r = [(i, " ".join(f"word{i}x{k} and" for k in range(60)), "en", f"s{i % 2}") for i in range(6)]
    docs = spark.createDataFrame(r, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(100 + i) for i, c in enumerate(WORKING)})
    out = OPERATORS[name](docs)
    found = out.collect()
    assert found and [c for c in out.columns if c in docs.columns] == [c for c in docs.columns if c in out.columns] and set(WORKING) <= set(out.columns)
    assert all([row[c] for c in WORKING] == [100 + i for i in range(len(WORKING))] for row in found)


def test_the_key_may_have_a_working_name(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g"), (1, "A b c d e f g")], "__key long, text string")
    assert [r["__key"] for r in ngram_join.deduplicate(docs, key="__key").collect()] == [1]
