"""Interleaved bookings and cancellations without a replay.

Whoever holds a seat booked before everyone in the queue, since a freed seat goes
to the head of the queue. So a status depends only on how many active passengers
of the scope booked no later: a running sum of +1 per booking and -1 per effective
cancellation. That holds at booking time and, over the survivors, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.operators.allocate import CANCELLED, CONFIRMED, RAC, RAC_CAPACITY, WL
from berth.operators.rank import ranked, running_sum


def place_status(place: Column, seats: Column, rac_capacity: int) -> tuple[Column, Column]:
    """Status and queue number of the ``place``-th active passenger of a scope."""
    over = place - seats
    status = F.when(over <= 0, F.lit(CONFIRMED)).when(over <= rac_capacity, F.lit(RAC)).otherwise(F.lit(WL))
    number = F.when(over <= 0, F.lit(None)).when(over <= rac_capacity, over).otherwise(over - rac_capacity)
    return status, number.cast("long")


def replay_bookings(
    events: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    rac_capacity: int = RAC_CAPACITY,
) -> DataFrame:
    """Status of every passenger when booked and after all events.

    ``events``: scope and ``order`` columns, action ('book' or 'cancel'),
    passenger_id (booked once) and n_seats of the scope. A cancellation counts if
    it is the first one after the booking and names the same scope.
    """
    scope, order = list(scope), list(order)
    at = F.struct(*order)
    booked = events.where(F.col("action") == "book").select(*scope, "passenger_id", "n_seats", *order)
    seen = booked.select(*scope, "passenger_id", at.alias("_booked"))
    cancelled = (
        events.where(F.col("action") == "cancel").select(*scope, "passenger_id", at.alias("_at"))
        .join(seen, [*scope, "passenger_id"])
        .where(F.col("_at") > F.col("_booked"))
        .groupBy(*scope, "passenger_id")
        .agg(F.min("_at").alias("_at"))
        .select(*scope, "passenger_id", "_at.*")
    )
    steps = booked.withColumn("_step", F.lit(1)).unionByName(
        cancelled.withColumn("n_seats", F.lit(None).cast("int")).withColumn("_step", F.lit(-1)).select(*booked.columns, "_step")
    )
    active = running_sum(steps, scope, order, "_step", "_place", slice_by)
    status, number = place_status(F.col("_place"), F.col("n_seats"), rac_capacity)
    first = active.where(F.col("_step") == 1).select(
        *scope, "passenger_id", status.alias("booked_status"), number.alias("booked_queue_no")
    )
    rest = ranked(
        booked.join(cancelled.select("passenger_id"), "passenger_id", "left_anti"), scope, order, "_place", slice_by,
    ).select("passenger_id", status.alias("final_status"), number.alias("final_queue_no"))
    return first.join(rest, "passenger_id", "left").withColumn("final_status", F.coalesce("final_status", F.lit(CANCELLED)))
