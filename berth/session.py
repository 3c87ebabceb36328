"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "berth") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own settings.

    The co-partition setting lets a join on (scope, rank) keep the partitioning by
    scope that the rank was computed on, which saves a shuffle of both sides.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="berth-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read on from there.

    Used where several branches need the same expensive frame, and between the
    rounds of an iteration, so that a lost executor costs no earlier round. A
    written table is computed once and carries its size to the planner. ``codec``
    names a compression other than the session's.
    """
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give a small frame one task per shuffle partition before it fans out.

    Spark sizes tasks by what goes in; a few thousand rows that each become
    thousands would otherwise be worked off by one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
