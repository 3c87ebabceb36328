"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. ``bytes.split`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """Fold of a row by its key: crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, longer by underscores than any column of ``df`` that has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator have working columns whose names begin with an underscore.

    Columns of the input with such names are called otherwise while it runs, and get their
    names back in its result. Arguments that name one of them follow.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        hidden = [c for c in docs.columns if c.startswith("_")]
        if not hidden:
            return operator(docs, *args, **options)
        names = dict(zip(hidden, unused(docs, *[f"hidden{c}" for c in hidden]), strict=True))

        def named(value):
            if isinstance(value, str):
                return names.get(value, value)
            return [named(v) for v in value] if isinstance(value, list) else value

        out = operator(docs.withColumnsRenamed(names), *map(named, args), **{k: named(v) for k, v in options.items()})
        return out.withColumnsRenamed({new: old for old, new in names.items()})

    return run
