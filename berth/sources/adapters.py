"""The two application schemas as the operators' logical frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.functions import hms_to_seconds, parse_seat_code, running_days


def frames_a(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Denormalised schema: stops belong to a schedule, stations are names, and
    the seat code of a passenger says confirmed, RAC or WL."""
    services = t["services"]
    if dict(services.dtypes)["running_days"] == "string":
        services = services.withColumn("running_days", running_days("running_days"))
    stops = t["stops"]
    if "arr_s" not in stops.columns:
        stops = stops.withColumn("arr_s", hms_to_seconds("arrival")).withColumn("dep_s", hms_to_seconds("departure"))
    out = {
        "trains": t["trains"],
        "services": services.withColumn("route_id", F.col("schedule_id")),
        "stops": stops.select(
            F.col("schedule_id").alias("route_id"), F.col("station").alias("station_id"), "stop_no", "arr_s", "dep_s", "distance"
        ),
        "coaches": t["coaches"].withColumn("class_no", F.col("class_name")),
    }
    if "seats" in t:
        out["seats"] = t["seats"].join(out["coaches"].select("coach_id", "train_id", "class_no"), "coach_id")
    if "passengers" in t and "tickets" in t:
        code = parse_seat_code("seat_code", "class_name")
        journey = t["tickets"].select("ticket_id", "pnr", "user_id", "train_id", "schedule_id", "journey_date", "total_fare")
        out["tickets"] = t["tickets"]
        # A cancelled passenger keeps the old code, so the stored status wins.
        state = F.when(F.col("status") == "cancelled", F.lit("cancelled")).otherwise(F.col("_code.status"))
        out["passengers"] = (
            t["passengers"].join(journey, "ticket_id")
            .withColumn("_code", code)
            .withColumn("status", state)
            .withColumn("class_no", F.col("class_name"))
            .withColumn("seat_no", F.col("_code.seat_no"))
            .withColumn("queue_no", F.col("_code.queue_no").cast("long"))
            .drop("_code")
        )
    return out


def frames_b(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Normalised schema: stops belong to a train, services are dated, queue
    numbers live in their own table."""
    out = {
        "trains": t["trains"],
        "stations": t["stations"],
        "classes": t["classes"],
        "dated": t["services"].withColumn("route_id", F.col("train_id")),
        "stops": t["routes"].select(
            F.col("train_id").alias("route_id"), "station_id", "stop_no",
            hms_to_seconds("arrival").alias("arr_s"), hms_to_seconds("departure").alias("dep_s"), "distance",
        ),
    }
    if "seats" in t and "seat_availability" in t:
        # A train's seats of a class form one pool; the seat id stands for the coach.
        out["seats"] = t["seat_availability"].join(t["seats"], "seat_id").withColumn("coach_id", F.col("seat_id"))
    if "tickets" in t and "queue" in t:
        queue = t["queue"].select("ticket_id", "queue_no")
        out["tickets"] = t["tickets"].join(queue, "ticket_id", "left")
    return out
