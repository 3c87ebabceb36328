"""Ledgers (tickets, passengers, transactions) by batch and journey month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "journey_month"


def write_ledger(df: DataFrame, path: str, date_column: str = "journey_date", batch: str = "0") -> None:
    """Write ``df`` to the ledger at ``path`` as ``batch``, one folder per journey month.

    A batch written again replaces itself, so a rerun adds nothing twice. Rows are
    rebalanced by month: a small month becomes one file, a month that holds most rows is
    split over many tasks.
    """
    rows = df.withColumn(MONTH, F.date_format(date_column, "yyyy-MM")).hint("rebalance", F.col(MONTH))
    rows.write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}/batch={batch}")


def read_ledger(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, months: DataFrame | None = None) -> DataFrame:
    """Ledger rows of all batches, reading only the months from ``first`` to ``last``.

    ``months``, a frame with a column journey_month, restricts them further; Spark takes
    the folders to read from it when the query runs.
    """
    read = spark.read.option("basePath", path).parquet(path)
    out = read.withColumn(MONTH, F.col(MONTH).cast("string")).drop("batch")
    if first is not None:
        out = out.where(F.col(MONTH) >= first)
    if last is not None:
        out = out.where(F.col(MONTH) <= last)
    if months is not None:
        out = out.join(months.select(MONTH).distinct(), MONTH)
    return out
