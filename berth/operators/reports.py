"""Reports over tickets, passengers, payments and services.

Ticket frames carry one row per passenger: ticket_id, booking_id, pnr, user_id,
schedule_id, class_no, passenger columns, status, coach_id, seat_no, queue_no.
Dimension joins carry no broadcast hint: Spark broadcasts a side it has measured
to be small and shuffles otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.functions import money, queue_code
from berth.operators.allocate import CONFIRMED, RAC, WL

OPEN_START, OPEN_END = dt.date(2000, 1, 1), dt.date(2099, 12, 31)  # fixed values


def booking_history(
    tickets: DataFrame, passengers: DataFrame, trains: DataFrame, cancellations: DataFrame,
    status: str = "all", start: dt.date | None = None, end: dt.date | None = None,
    passenger_order: Sequence[str] = ("passenger_id",), users: DataFrame | None = None,
) -> DataFrame:
    """Bookings of the given users with names, seats and refund.

    A ticket cancelled in several steps shows one row per cancellation. ``active``
    means confirmed only. Show ordered by journey and booking date, newest first. Passengers
    are dealt by ticket before they are listed, as a half-made list holds the order twice.
    """
    chosen = tickets.where(F.col("journey_date").between(F.lit(start or OPEN_START), F.lit(end or OPEN_END)))
    if status == "active":
        chosen = chosen.where(F.lower("status") == "confirmed")
    elif status == "cancelled":
        chosen = chosen.where(F.col("status") == "cancelled")
    elif status != "all":
        raise ValueError(f"status must be all, active or cancelled, not {status!r}")
    if users is not None:
        chosen = chosen.join(users.select("user_id"), "user_id", "left_semi")
    order = ", ".join(f"`{c}`" for c in passenger_order)
    people = passengers.select("ticket_id", *passenger_order, "name", "seat_code").repartition("ticket_id")
    names = people.groupBy("ticket_id").agg(
        F.expr(f"listagg(name, ', ') within group (order by {order})").alias("passenger_names"),
        F.expr(f"listagg(seat_code, ', ') within group (order by {order})").alias("seat_allocations"),
    )
    refunds = cancellations.select("ticket_id", "refund_amount", "refund_status")
    return (
        chosen.join(trains.select("train_id", "train_name"), "train_id")
        .join(names, "ticket_id", "left")
        .join(refunds, "ticket_id", "left")
        .withColumn("refund_amount", F.coalesce("refund_amount", F.lit(0).cast("decimal(12,2)")))
        .withColumn("refund_status", F.coalesce("refund_status", F.lit("N/A")))
    )


def pnr_status(
    tickets: DataFrame, services: DataFrame, trains: DataFrame, classes: DataFrame, pnrs: DataFrame | None = None
) -> DataFrame:
    """Status, seat, class, train and date of the tickets of the asked references."""
    chosen = tickets if pnrs is None else tickets.join(pnrs.select("pnr"), "pnr", "left_semi")
    return (
        chosen.join(services.select("schedule_id", "train_id"), "schedule_id")
        .join(trains.select("train_id", "train_name"), "train_id")
        .join(classes.select("class_no", "class_name"), "class_no")
        .select("ticket_id", "pnr", "status", "coach_id", "seat_no", "class_name", "train_name", "journey_date")
    )


def train_schedule(services: DataFrame, trains: DataFrame | None = None) -> DataFrame:
    """Services of the asked trains (all trains without a filter)."""
    chosen = services if trains is None else services.join(trains.select("train_id"), "train_id", "left_semi")
    return chosen.select("train_id", "schedule_id", "season", F.concat_ws(",", "running_days").alias("running_days"), "status")


PASSENGER = ("passenger_id", "name", "concession", "pnr", "status", "seat_no")


def manifest(tickets: DataFrame, services: DataFrame, asked: DataFrame | None = None, columns: Sequence[str] = PASSENGER) -> DataFrame:
    """Distinct passengers of the asked services (train_id, journey_date).

    ``columns`` tell passengers apart; texts that follow from others may be added afterwards.
    """
    rows = tickets.join(services.select("schedule_id", "train_id"), "schedule_id")
    if asked is not None:
        rows = rows.join(asked.select("train_id", "journey_date"), ["train_id", "journey_date"], "left_semi")
    return rows.select("train_id", "journey_date", *columns).distinct()


def waitlist(tickets: DataFrame, services: DataFrame, trains: DataFrame | None = None) -> DataFrame:
    """Waitlisted passengers with their queue number."""
    rows = tickets.where(F.col("status") == WL).join(services.select("schedule_id", "train_id"), "schedule_id")
    if trains is not None:
        rows = rows.join(trains.select("train_id"), "train_id", "left_semi")
    return rows.select("train_id", "schedule_id", "class_no", "passenger_id", "name", "pnr", "journey_date", "queue_no", "status")


def revenue(payments: DataFrame, start: dt.date, end: dt.date, by: Sequence[str] = ()) -> DataFrame:
    """Payments not refunded in the closed date range; null where there are none."""
    kept = payments.where(F.col("payment_date").between(F.lit(start), F.lit(end)) & (F.col("refund_status") == "No"))
    return kept.groupBy(*by).agg(F.sum("amount").alias("total_revenue"))


def cancelled_refunds(payments: DataFrame, tickets: DataFrame, services: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """Refunded payments of tickets on cancelled services, per train."""
    gone = services.where(F.col("status") == cancelled).select("schedule_id", "train_id")
    refunded = payments.where(F.col("refund_status") == "Yes").select("ticket_id", "amount")
    return (
        refunded.join(tickets.select("ticket_id", "schedule_id"), "ticket_id")
        .join(gone, "schedule_id")
        .groupBy("train_id")
        .agg(F.sum("amount").alias("total_refund"))
    )


def cancellation_records(
    tickets: DataFrame, services: DataFrame, payments: DataFrame, cancellations: DataFrame, cancelled: str = "Cancelled"
) -> DataFrame:
    """Paid tickets that were cancelled or whose service was."""
    return (
        payments.select("ticket_id", "refund_status")
        .join(tickets.select("ticket_id", "pnr", "schedule_id"), "ticket_id")
        .join(services.select("schedule_id", F.col("status").alias("service_status")), "schedule_id")
        .join(cancellations.select("ticket_id", "cancellation_date", "reason", "charge", F.lit(True).alias("_has")), "ticket_id", "left")
        .where((F.col("service_status") == cancelled) | F.col("_has"))
        .select("ticket_id", "pnr", "service_status", "refund_status", "cancellation_date", "reason", "charge")
    )


def busiest_stations(tickets: DataFrame, services: DataFrame, stops: DataFrame, stations: DataFrame, k: int = 1) -> DataFrame:
    """Stations by tickets of trains calling there; ties go to the smaller id.

    Tickets are counted per service and per route before they meet the stops.
    """
    per_service = tickets.groupBy("schedule_id").agg(F.count("ticket_id").alias("n"))
    per_route = per_service.join(services.select("schedule_id", "route_id"), "schedule_id").groupBy("route_id").agg(F.sum("n").alias("n"))
    return (
        stops.select("route_id", "station_id")
        .join(per_route, "route_id")
        .groupBy("station_id")
        .agg(F.sum("n").alias("passenger_count"))
        .join(stations, "station_id")
        .orderBy(F.desc("passenger_count"), "station_id")
        .limit(k)
    )


def itemized_bills(tickets: DataFrame, classes: DataFrame, payments: DataFrame) -> DataFrame:
    """Distance times fare per km beside the amount paid.

    ``tickets``: ticket_id, pnr, class_no, distance. One payment join serves the
    amount, mode and date.
    """
    return (
        tickets.select("ticket_id", "pnr", "class_no", "distance")
        .join(classes.select("class_no", "class_name", "fare_per_km"), "class_no")
        .join(payments.select("ticket_id", F.col("amount").alias("total_amount"), "payment_mode", "payment_date"), "ticket_id")
        .withColumn("base_amount", money(F.col("distance") * F.col("fare_per_km"), 12))
        .drop("class_no")
    )


def ticket_detail(
    tickets: DataFrame, services: DataFrame, trains: DataFrame, stations: DataFrame, classes: DataFrame,
    seats: DataFrame, payments: DataFrame | None = None, passenger: Sequence[str] = ("ticket_id", "pnr", "name", "concession"),
) -> DataFrame:
    """One wide row per ticket with its seat or queue text and payment.

    ``seats``: schedule_id, coach_id, seat_no, seat_type. Without ``payments`` the tickets
    hold amount and payment_mode. ``passenger`` are columns of the ticket that go through;
    texts that follow from others may be added afterwards. The seats of a service, by
    coach, and the texts of its train meet the tickets in one join.
    """
    source = stations.select(F.col("station_id").alias("src_station"), F.col("station").alias("source_station"))
    target = stations.select(F.col("station_id").alias("dst_station"), F.col("station").alias("destination_station"))
    lines = trains.join(source, "src_station").join(target, "dst_station").select(
        "train_id", "train_name", "train_type", "source_station", "destination_station"
    )
    if payments is not None:
        tickets = tickets.join(payments.select("ticket_id", "amount", "payment_mode"), "ticket_id", "left")
    coaches = seats.where(F.col("coach_id").isNotNull()).groupBy("schedule_id", "coach_id").agg(
        F.collect_list(F.struct("seat_no", "seat_type")).alias("_seats")
    )
    by_coach = coaches.groupBy("schedule_id").agg(F.map_from_entries(F.collect_list(F.struct("coach_id", "_seats"))).alias("_coaches"))
    lines = services.select("schedule_id", "train_id").join(lines, "train_id").join(by_coach, "schedule_id", "left").drop("train_id")
    seat = F.filter(F.try_element_at("_coaches", F.col("coach_id")), lambda s: s["seat_no"] == F.col("seat_no"))
    seat_text = F.concat("_seat.seat_type", F.lit("-"), "seat_no")
    columns = ("class_no", "schedule_id", "journey_date", "status", "coach_id", "seat_no", "queue_no", "booking_date", "amount", "payment_mode")
    return (
        tickets.select(*passenger, *[c for c in columns if c not in passenger])
        .join(classes.select("class_no", "class_name"), "class_no")
        .join(lines, "schedule_id")
        .select("*", F.explode_outer(seat).alias("_seat"))
        .withColumn("seat_info", F.when(F.col("status").isin(RAC, WL), queue_code("status", "queue_no")).otherwise(seat_text))
        .select(
            *passenger, "class_name", "train_name", "train_type", "source_station",
            "destination_station", *[c for c in ("journey_date",) if c not in passenger], "status", "seat_info", "amount", "payment_mode", "booking_date",
        )
    )


def status_counts(tickets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tickets per status for any grouping, one pass."""
    return tickets.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (CONFIRMED, RAC, WL)]
    )


def flag_refunds(before: DataFrame, after: DataFrame, tickets: DataFrame, payments: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """Payments with ``refund_status`` 'Yes' where the ticket's service has just
    been cancelled. ``before``/``after``: schedule_id, status."""
    old = before.select("schedule_id", F.col("status").alias("_old"))
    changed = after.where(F.col("status") == cancelled).join(old, "schedule_id").where(F.col("_old") != cancelled)
    hit = (
        tickets.select("ticket_id", "schedule_id")
        .join(changed.select("schedule_id"), "schedule_id", "left_semi")
        .select("ticket_id")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        payments.join(hit, "ticket_id", "left")
        .withColumn("refund_status", F.when(F.col("_hit"), F.lit("Yes")).otherwise(F.col("refund_status")))
        .drop("_hit")
    )
