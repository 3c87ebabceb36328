"""Registered queries: a Spark plan, its declared result and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.plans.bind import Bound

SQL_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}


@dataclass(frozen=True)
class Query:
    """``schema`` names and types the result columns for both engines."""

    name: str
    plan: Callable[[Bound], DataFrame]
    schema: str
    sql: str | None = None

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(" ", 1)) for part in re.split(r",\s*(?![^(]*\))", self.schema.strip())]

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.plan(Bound(spark, directory)).select(*[F.col(c).cast(t).alias(c) for c, t in self.columns])

    def oracle(self, ctes: dict[str, str]) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"CAST({c} AS {SQL_TYPES.get(t, t.upper())}) AS {c}" for c, t in self.columns)
        return f"{_with(ctes, self.sql)}SELECT {cols} FROM ({self.sql}) AS q"


def _with(ctes: dict[str, str], body: str) -> str:
    """The named fragments the body needs, in declaration order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(ctes[name])
    if not needed:
        return ""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ctes[n]})" for n in ctes if n in needed) + " "
