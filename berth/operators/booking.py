"""Booking pipelines: price, check the wallet, allocate, summarise."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.functions import money, pnr
from berth.operators.allocate import CONFIRMED, RAC, RAC_CAPACITY, SCOPE, WL, allocate
from berth.operators.pricing import price_distance, price_route
from berth.operators.wallet import DEBIT, wallet_ledger
from berth.session import durable

MAX_PASSENGERS = 4  # fixed value

NO_LIST, TOO_MANY, NO_FARE = "no passenger list", "too many passengers", "no fare"
NO_FUNDS = "Insufficient wallet balance"  # fixed value

PASSENGER_JSON = (
    "array<struct<name:string,age:int,gender:string,contact:string,email:string,concession:string>>"
)


def explode_passengers(
    bookings: DataFrame, column: str = "passengers", cap: int = MAX_PASSENGERS
) -> tuple[DataFrame, DataFrame]:
    """Passenger JSON as rows: those within the cap, and the rest with a reason.

    ``passenger_no`` counts from 1 in array order. A list that is no list, or is empty, is
    one row of the rest, without a passenger.
    """
    rows = (
        bookings.withColumn("_list", F.from_json(column, PASSENGER_JSON))
        .select(*[c for c in bookings.columns if c != column], F.posexplode_outer("_list").alias("_pos", "_p"))
        .select("*", (F.col("_pos") + 1).alias("passenger_no"), "_p.*")
        .drop("_pos", "_p")
    )
    within = F.coalesce(F.col("passenger_no") <= cap, F.lit(False))
    reason = F.when(F.col("passenger_no").isNull(), F.lit(NO_LIST)).otherwise(F.lit(TOO_MANY))
    return rows.where(within), rows.where(~within).withColumn("reason", reason)


def book_tickets(
    requests: DataFrame,
    stops: DataFrame,
    coaches: DataFrame,
    seats: DataFrame,
    opening: DataFrame,
    passenger_order: Sequence[Column | str],
    slice_by: Column | None,
    event_order: Sequence[str] = ("ts", "event_id"),
    rac_capacity: int = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
    wallet_slice: Column | None = None,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Book whole requests: distance fare, wallet check, then seats; tickets and rejects.

    ``requests``: one row per passenger with user_id, method, train, route, class,
    stations, scope and order columns. The fare never depends on the seat, so all
    requests are priced first, then the wallets, then the accepted ones seated.
    The priced requests are written once, since all steps read them. A request without
    a fare, or whose user's wallet is short, is a reject with its reason. ``keep`` names the
    columns, total_fare among them, that go on from the prices, where not all are asked for.
    """
    asked = price_distance(requests.drop("kind", "amount"), stops, coaches, how="left")
    asked = durable(asked if keep is None else asked.select(*keep))
    priced = asked.where(F.col("total_fare").isNotNull())
    unpriced = asked.where(F.col("total_fare").isNull()).withColumn("reason", F.lit(NO_FARE))
    by_wallet = priced.where(F.col("method") == "wallet").drop("method").withColumnRenamed("total_fare", "amount").withColumn("kind", F.lit(DEBIT))
    paid = wallet_ledger(by_wallet, opening, event_order, wallet_slice)
    paid = paid.withColumns({"method": F.lit("wallet"), "total_fare": F.col("amount")}).select(*priced.columns, "accepted")
    accepted = paid.where("accepted").drop("accepted")
    refused = paid.where(~F.coalesce("accepted", F.lit(False))).drop("accepted")
    others = priced.where(~F.coalesce(F.col("method") == "wallet", F.lit(False)))
    rejects = unpriced.unionByName(refused.withColumn("reason", F.lit(NO_FUNDS)), allowMissingColumns=True)
    seated = durable(others.unionByName(accepted))
    return allocate(seated, seats, passenger_order, slice_by, rac_capacity=rac_capacity, scope=scope), rejects


def book_groups(
    bookings: DataFrame,
    route_fares: DataFrame,
    seats: DataFrame,
    as_of: dt.datetime,
    order: Sequence[Column | str] = ("booking_id", "passenger_no"),
    slice_by: Column | None = None,
    rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
    cap: int = MAX_PASSENGERS,
) -> tuple[DataFrame, DataFrame]:
    """Book up to ``cap`` passengers per request from their JSON.

    ``bookings``: booking_id, train_id, class_no, src_station, dst_station, the
    scope columns and ``passengers``. Returns tickets and rejects: passengers over the
    cap or without a fare, and bookings without a list, each with a reason.
    """
    rows, rejects = explode_passengers(bookings, cap=cap)
    asked = price_route(rows, route_fares, how="left")
    priced = asked.where(F.col("fare").isNotNull())
    unpriced = asked.where(F.col("fare").isNull()).withColumn("reason", F.lit(NO_FARE))
    tickets = allocate(priced, seats, order, slice_by, rac_capacity=rac_capacity, scope=scope)
    return tickets.withColumn("pnr", pnr("booking_id", as_of)), rejects.unionByName(unpriced.drop("fixed_fare", "fare"))


def group_payments(tickets: DataFrame, bookings: DataFrame, ticket: Sequence[str] = ("booking_id", "passenger_no")) -> DataFrame:
    """One payment per booking: the fares of its tickets, held by the last of them.

    ``bookings``: booking_id, payment_mode and booking_date. Bookings without a ticket pay nothing.
    """
    paid = tickets.groupBy("booking_id").agg(
        money(F.sum("fare"), 12).alias("amount"), F.count(F.lit(1)).alias("n_tickets"), F.max(F.struct(*ticket)).alias("last_ticket")
    )
    return paid.join(bookings.select("booking_id", "payment_mode", F.col("booking_date").alias("payment_date")), "booking_id").withColumn("refund_status", F.lit("No"))


def booking_summary(tickets: DataFrame, by: Sequence[str] = ("booking_id",), amount: str = "fare") -> DataFrame:
    """Tickets per status and the total amount of each booking, in one pass."""
    return tickets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("status") == CONFIRMED).alias("confirmed"),
        F.count_if(F.col("status") == RAC).alias("rac"),
        F.count_if(F.col("status") == WL).alias("waitlist"),
        F.sum(amount).alias("total_amount"),
    )
