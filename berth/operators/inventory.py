"""Seat inventory, dated services and skip-duplicate appends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.functions import weekday3
from berth.session import spread


def first_schedule(services: DataFrame) -> DataFrame:
    """The smallest schedule of each train."""
    return services.groupBy("train_id").agg(F.min("schedule_id").alias("schedule_id"))


def numbered_seats(coaches: DataFrame) -> DataFrame:
    """One row per seat, ``S1`` to ``S<total>``; no rows for an empty coach."""
    return spread(coaches.where(F.col("total_seats") >= 1), "coach_id").withColumn(
        "seat_index", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_seats").cast("long")))
    ).withColumn("seat_no", F.concat(F.lit("S"), F.col("seat_index").cast("string")))


def populate_seats(
    coaches: DataFrame, services: DataFrame, dates: Sequence[dt.date], existing: DataFrame | None = None
) -> DataFrame:
    """Free seats for each coach and date under the train's first schedule.

    Seats already in ``existing`` (same coach, seat and date) are left out.
    """
    if not dates:
        raise ValueError("populate_seats needs at least one date")
    days = F.array(*[F.lit(d) for d in sorted(set(dates))])
    coach_rows = coaches.select("coach_id", "train_id", "class_no", "total_seats").join(
        first_schedule(services), "train_id", "left"
    )
    seats = numbered_seats(coach_rows).select(
        "coach_id", "train_id", "class_no", "seat_no", "schedule_id",
        F.explode(days).alias("journey_date"), F.lit(True).alias("is_available"),
    )
    if existing is None:
        return seats
    return seats.join(existing.select("coach_id", "seat_no", "journey_date"), ["coach_id", "seat_no", "journey_date"], "left_anti")


def generate_seats(coaches: DataFrame, services: DataFrame, as_of: dt.date, existing: DataFrame | None = None) -> DataFrame:
    """Inventory of one day. Where several schedules claim a (coach, seat, date)
    the smallest schedule keeps it, so the schedules are reduced before the seats
    are spelt out. Trains without a schedule get none."""
    return populate_seats(coaches, services, [as_of], existing).where(F.col("schedule_id").isNotNull())


def expand_services(services: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per service and running date in the closed range.

    Where services carry a ``season`` the range is cut to that year first.
    """
    lo, hi = F.lit(start), F.lit(end)
    if "season" in services.columns:
        lo = F.greatest(lo, F.make_date("season", F.lit(1), F.lit(1)))
        hi = F.least(hi, F.make_date("season", F.lit(12), F.lit(31)))
    dated = spread(services.where(lo <= hi), "schedule_id").withColumn("service_date", F.explode(F.sequence(lo, hi)))
    return dated.where(F.array_contains("running_days", weekday3("service_date")))


def append_new(df: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows whose key is new, the first by ``order`` for each key.

    The first row is a minimum, so copies of one key fold before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)],
                           *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])).alias("_first")
    out = df.groupBy(*keys).agg(first).select(
        *keys, *[F.col(f"_first._v{i}").alias(c) for i, c in enumerate(rest)]
    ).select(*df.columns)
    return out if existing is None else out.join(existing.select(*keys), keys, "left_anti")
