"""Seat allocation and queue promotion for whole batches.

Without cancellations a position in a scope only grows, so the loop "take a
seat, else join the reserve queue, else the waitlist" is a rank: the first F
requests take the F free seats in seat order, the next fill the reserve queue up
to its capacity, the rest wait. A batch of cancellations keeps the survivors'
order, so it is a rank again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.functions import queue_code, seat_code, seat_sort_key
from berth.operators.rank import ranked
from berth.session import durable

# A seat is sold once per service and date; services that run once may leave the date out.
SCOPE = ("schedule_id", "journey_date", "class_no")
SEAT_KEY = ("schedule_id", "journey_date", "coach_id", "seat_no")
RAC_CAPACITY = 8  # fixed value

CONFIRMED, RAC, WL, CANCELLED = "Confirmed", "RAC", "WL", "cancelled"


def rac_fraction(seats: DataFrame, fraction: float = 0.5, by: Sequence[str] = ("class_no",)) -> DataFrame:
    """Reserve capacity as a share of all seats of a class (rounded down)."""
    return seats.groupBy(*by).agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("rac_capacity"))


def queue_counts(queue: DataFrame | None, scope: Sequence[str]) -> DataFrame | None:
    """Members of the reserve queue and the waitlist per scope, and the last number of either.

    Without a queue_no the queues count as dense, and the last number is the count.
    """
    if queue is None:
        return None
    parts = []
    for name, status in (("_rac", RAC), ("_wl", WL)):
        member = F.col("status") == status
        count = F.count_if(member)
        last = F.coalesce(F.max(F.when(member, F.col("queue_no"))), F.lit(0)) if "queue_no" in queue.columns else count
        parts += [count.alias(name), last.cast("long").alias(f"{name}_no")]
    return queue.groupBy(*scope).agg(*parts)


def first_coach_only(seats: DataFrame, coaches: DataFrame) -> DataFrame:
    """Seats of the smallest coach id of each train and class, for callers who sell
    one coach of a class only; by default all coaches are pooled."""
    first = coaches.groupBy("train_id", "class_no").agg(F.min("coach_id").alias("coach_id"))
    return seats.join(first.select("coach_id"), "coach_id", "left_semi")


def seat_pool(seats: DataFrame, scope: Sequence[str], seat_order: str) -> DataFrame:
    """Free seats of a scope pooled over its coaches: a list per coach in seat order, and how many seats come before it."""
    seat = F.struct("coach_id", seat_sort_key("seat_no", seat_order).alias("key"), "seat_no")
    coaches = seats.groupBy(*scope, "coach_id").agg(F.sort_array(F.collect_list(seat)).alias("_items"))
    earlier = Window.partitionBy(*scope).orderBy("coach_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("_items")).over(earlier), F.lit(0)).cast("long")
    items = F.transform("_items", lambda s: F.struct(s["coach_id"].alias("coach_id"), s["seat_no"].alias("seat_no")))
    return coaches.select(*scope, before.alias("_from"), items.alias("_items"))


def allocate(
    requests: DataFrame,
    seats: DataFrame,
    order: Sequence[Column | str],
    slice_by: Column | None,
    existing: DataFrame | None = None,
    rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
    queue_scope: Sequence[str] | None = None,
    seat_order: str = "lexical",
) -> DataFrame:
    """Add status, coach_id, seat_no and queue_no to every request.

    ``seats``: the free seats (scope columns, coach_id, seat_no). ``existing``:
    passengers already queued (queue scope columns, status, queue_no): their count
    takes of the capacity, new numbers go on from their largest, gaps stay. ``queue_scope`` may
    be coarser than ``scope``, such as the class alone. ``order`` must be total;
    ``slice_by`` is a long that never falls along it. ``rac_capacity`` is a
    number or a frame with that column and some of the queue scope's columns.
    """
    scope = list(scope)
    queue_scope = scope if queue_scope is None else list(queue_scope)
    free = seats.groupBy(*scope).agg(F.count(F.lit(1)).alias("_free"))
    queued = queue_counts(existing, queue_scope)

    capacity, pool = _capacity(rac_capacity, queue_scope), seat_pool(seats, scope, seat_order)
    if queue_scope == scope:
        facts = free if queued is None else free.join(queued, scope, "full")
        rows = ranked(requests, scope, order, "_r", slice_by, facts, capacity, pool)
        rows = rows.withColumn("_q", F.col("_r") - F.coalesce("_free", F.lit(0)))
    else:
        rows = ranked(requests, scope, order, "_r", slice_by, free, lists=pool)
        has_seat = F.col("_r") <= F.coalesce("_free", F.lit(0))
        over = ranked(rows.where(~has_seat), queue_scope, order, "_q", slice_by, queued, capacity)
        rows = rows.where(has_seat).withColumn("_q", F.lit(0).cast("long")).unionByName(over, allowMissingColumns=True)
    return _place(rows, rac_capacity, requests.columns)


def _capacity(rac_capacity: int | DataFrame, queue_scope: list[str]) -> DataFrame | None:
    """A capacity that differs by queue, to travel with the ranks of the queue."""
    if not isinstance(rac_capacity, DataFrame):
        return None
    return rac_capacity.select(*[c for c in rac_capacity.columns if c in queue_scope], F.col("rac_capacity").alias("_cap"))


def _place(rows: DataFrame, rac_capacity: int | DataFrame, keep: Sequence[str]) -> DataFrame:
    """Turn ranks and the seats met by them (``_item``) into status, seat and queue number."""
    cap = F.coalesce("_cap", F.lit(0)) if isinstance(rac_capacity, DataFrame) else F.lit(rac_capacity)
    rac = F.coalesce("_rac", F.lit(0)) if "_rac" in rows.columns else F.lit(0)
    last_rac = F.coalesce("_rac_no", F.lit(0)) if "_rac_no" in rows.columns else F.lit(0)
    last_wl = F.coalesce("_wl_no", F.lit(0)) if "_wl_no" in rows.columns else F.lit(0)
    space = F.greatest(cap - rac, F.lit(0))
    q = F.col("_q")
    return rows.select(
        *keep,
        F.when(q <= 0, F.lit(CONFIRMED)).when(q <= space, F.lit(RAC)).otherwise(F.lit(WL)).alias("status"),
        F.col("_item.coach_id").alias("coach_id"),
        F.col("_item.seat_no").alias("seat_no"),
        F.when(q <= 0, F.lit(None)).when(q <= space, last_rac + q).otherwise(last_wl + q - space).cast("long").alias("queue_no"),
    )


def with_seat_code(passengers: DataFrame, class_column: str = "class_name") -> DataFrame:
    """Add the allocation text: ``3A-S12``, ``RAC-3`` or ``WL-7``."""
    return passengers.withColumn(
        "seat_code",
        F.when(F.col("status") == CONFIRMED, seat_code(class_column, "seat_no")).otherwise(queue_code("status", "queue_no")),
    )


def ticket_status(passengers: DataFrame, ticket: str = "ticket_id") -> DataFrame:
    """Status of a ticket: the best status among its passengers."""
    best = F.min(
        F.when(F.col("status") == CONFIRMED, 0).when(F.col("status") == RAC, 1).when(F.col("status") == WL, 2).otherwise(3)
    )
    return passengers.groupBy(ticket).agg(
        F.element_at(F.array(*[F.lit(s) for s in (CONFIRMED, RAC, WL, CANCELLED)]), best + 1).alias("ticket_status"),
        F.count(F.lit(1)).alias("n_passengers"),
    )


def promote(
    queue: DataFrame,
    free_seats: DataFrame,
    rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
    seat_order: str = "lexical",
) -> DataFrame:
    """Move queued passengers up: the k-th takes the k-th free seat, the rest
    close up as RAC 1..n and WL 1..m.

    ``queue``: scope columns, status (RAC or WL), queue_no, further columns kept.
    """
    scope = list(scope)
    is_wl = F.when(F.col("status") == WL, F.lit(1)).otherwise(F.lit(0)).cast("long")
    free = free_seats.groupBy(*scope).agg(F.count(F.lit(1)).alias("_free"))
    slice_by = is_wl * (1 << 40) + F.floor(F.col("queue_no") / (1 << 20)).cast("long")
    rows = ranked(queue, scope, [is_wl, "queue_no"], "_r", slice_by, free, _capacity(rac_capacity, scope), seat_pool(free_seats, scope, seat_order))
    rows = rows.withColumn("_q", F.col("_r") - F.coalesce("_free", F.lit(0)))
    keep = [c for c in queue.columns if c not in ("status", "coach_id", "seat_no", "queue_no")]
    return _place(rows, rac_capacity, keep)


def state_after(gone: Column) -> Column:
    """What becomes of a passenger, where ``gone`` says who is cancelled now."""
    return (
        F.when((F.col("status") == CANCELLED) | gone, F.lit(CANCELLED)).when(F.col("status") == CONFIRMED, F.lit(CONFIRMED)).otherwise(F.lit("queued"))
    )


def cancel(
    cancels: DataFrame,
    passengers: DataFrame,
    free_seats: DataFrame | None = None,
    key: Sequence[str] = ("passenger_id",),
    rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
    seat_order: str = "lexical",
) -> DataFrame:
    """Cancel a batch of passengers and promote the queue behind them.

    ``passengers``: key, scope columns, status, coach_id, seat_no, queue_no.
    Returns every passenger with the new status; cancelled ones lose seat and
    queue number. ``free_seats`` are seats that were free before. Who is cancelled is
    settled once and written, as the seats, the queue and the rest all need it.
    """
    key = list(key)
    gone = cancels.select(*key).distinct().withColumn("_gone", F.lit(True))
    marked = durable(passengers.join(gone, key, "left").withColumn("_state", state_after(F.col("_gone"))).drop("_gone"))
    return closed_up(marked, passengers.columns, free_seats, rac_capacity, scope, seat_order)


def closed_up(
    marked: DataFrame, columns: Sequence[str], free_seats: DataFrame | None = None, rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE, seat_order: str = "lexical",
) -> DataFrame:
    """Passengers (``columns``) after a batch whose outcome stands in ``_state``: cancelled, Confirmed or queued.

    Cancelled ones lose seat and queue number, the queue moves up. ``marked`` is a stored table.
    """
    freed = marked.where((F.col("_state") == CANCELLED) & (F.col("status") == CONFIRMED)).select(*scope, "coach_id", "seat_no")
    if free_seats is not None:
        freed = freed.unionByName(free_seats.select(*scope, "coach_id", "seat_no"))
    queue = marked.where(F.col("_state") == "queued").select(*columns)
    settled = marked.where(F.col("_state") != "queued")
    lost = F.col("_state") == CANCELLED
    settled = settled.select(
        *[
            F.when(~lost, F.col(c)).alias(c) if c in ("coach_id", "seat_no", "queue_no")
            else F.col("_state").alias(c) if c == "status"
            else F.col(c)
            for c in columns
        ]
    )
    moved = promote(queue, freed, rac_capacity, scope, seat_order)
    return settled.unionByName(moved.select(*columns))


def cancel_tickets(ticket_ids: DataFrame, passengers: DataFrame, key: Sequence[str] = ("passenger_id",)) -> DataFrame:
    """Passengers that go with a whole-ticket cancellation, as input for ``cancel``."""
    return passengers.join(ticket_ids.select("ticket_id").distinct(), "ticket_id", "left_semi").select(*key)


def emptied_tickets(passengers: DataFrame) -> DataFrame:
    """Tickets whose last active passenger is gone."""
    return passengers.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("n_passengers"), F.count_if(F.col("status") == CANCELLED).alias("n_cancelled")
    ).where(F.col("n_passengers") == F.col("n_cancelled"))


def seat_status(seats: DataFrame, tickets: DataFrame, key: Sequence[str] = SEAT_KEY) -> DataFrame:
    """Seats with ``is_booked`` set where a confirmed ticket holds them."""
    key = list(key)
    held = tickets.where(F.col("status") == CONFIRMED).select(*key).distinct().withColumn("_held", F.lit(True))
    return seats.join(held, key, "left").withColumn("is_booked", F.coalesce("_held", F.lit(False))).drop("_held")


def availability_status(
    requests: DataFrame, free_seats: DataFrame, queue: DataFrame, rac_capacity: int | DataFrame = RAC_CAPACITY,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """What the next passenger of each asked scope would get.

    ``Available`` with the number of free seats, else ``RAC`` or ``Waitlist``
    with the next queue number.
    """
    scope = list(scope)
    free = free_seats.groupBy(*scope).agg(F.count(F.lit(1)).alias("_free"))
    asked = requests.select(*scope).distinct().join(free, scope, "left").join(queue_counts(queue, scope), scope, "left")
    if isinstance(rac_capacity, DataFrame):
        on = [c for c in rac_capacity.columns if c in scope]
        asked = asked.join(rac_capacity.withColumnRenamed("rac_capacity", "_cap"), on, "left")
        cap = F.coalesce("_cap", F.lit(0))
    else:
        cap = F.lit(rac_capacity)
    n, rac, last_rac, last_wl = (F.coalesce(c, F.lit(0)) for c in ("_free", "_rac", "_rac_no", "_wl_no"))
    return asked.select(
        *scope,
        F.when(n > 0, F.lit("Available")).when(rac < cap, F.lit("RAC")).otherwise(F.lit("Waitlist")).alias("status"),
        F.when(n > 0, n).alias("available_seats"),
        F.when(n > 0, F.lit(None)).when(rac < cap, last_rac + 1).otherwise(last_wl + 1).cast("long").alias("queue_no"),
    )


def available_seats(seats: DataFrame, tickets: DataFrame, key: Sequence[str] = SEAT_KEY, asked: DataFrame | None = None) -> DataFrame:
    """Seats no confirmed ticket holds; of the asked services, dates or classes if given.

    ``asked`` has some of the columns of ``seats``, such as train, date and class; it cuts
    the seats down before they meet the tickets.
    """
    if asked is not None:
        seats = seats.join(asked.distinct(), asked.columns, "left_semi")
    return seats.join(tickets.where(F.col("status") == CONFIRMED).select(*key), list(key), "left_anti")
