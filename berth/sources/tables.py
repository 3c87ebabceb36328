"""Reading Parquet tables and header-less CSV files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from berth.functions import hms_to_seconds, running_days
from berth.sources.schemas import CSV_COLUMNS, CSV_IDS, SCHEMA_A, SCHEMA_B

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables(Mapping):
    """Lazy scans by table name; a table's footer is read when first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self._spark, self._directory, self._seen = spark, directory, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._seen:
            self._seen[name] = self._spark.read.parquet(f"{self._directory}/{name}.parquet")
        return self._seen[name]

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def tables(spark: SparkSession, directory: str) -> Tables:
    """Every driver table as a lazy scan; only the columns used are read."""
    return Tables(spark, directory)


def read_fixture(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table of header-less CSV files, with ids by row position.

    ``NULL`` is null, line ends may be CR LF, day lists become arrays and times
    become seconds. Files count in the order of their paths, rows in that of their
    file: rows are numbered within the splits they are read in, and the counts of the
    splits before, one row each, are joined to them.
    """
    raw = spark.read.csv(path, schema=CSV_COLUMNS[name], nullValue="NULL", ignoreTrailingWhiteSpace=True)
    split = F.struct("_metadata.file_path", "_metadata.file_block_start")
    rows = raw.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_split").orderBy("_at"))
    out = rows.withColumn("_row", number).join(before, "_split")
    out = out.select(*raw.columns, (F.col("_before") + F.col("_row")).cast("bigint").alias(CSV_IDS[name]))
    if "running_days" in out.columns:
        out = out.withColumn("running_days", running_days("running_days"))
    if "arrival" in out.columns:
        out = out.withColumn("arr_s", hms_to_seconds("arrival")).withColumn("dep_s", hms_to_seconds("departure"))
    return out


def application_tables(spark: SparkSession, directory: str, schema: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables of application schema ``a`` or ``b`` with declared types."""
    declared = SCHEMA_A if schema == "a" else SCHEMA_B
    return {name: spark.read.schema(declared[name]).parquet(f"{directory}/{name}") for name in names or declared}
