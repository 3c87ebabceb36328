"""Wallet ledger with a funds check, and the transaction log.

A debit that exceeds the balance is refused and leaves the balance alone. A refund that
names its debit is void if that debit was refused. While nothing is refused a balance is
a running sum, so histories are cut into runs of ``RUN_ROWS`` counted events, and a run
whose running sum cannot fall below zero is answered by that sum. Only the others are
folded event by event, by built-in functions over sorted arrays of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.functions import money
from berth.operators.rank import accumulated, time_slice
from berth.session import durable

TOPUP, DEBIT, REFUND = "topup", "debit", "refund"
#: Events of a run, the most that are gathered in one row, and of a piece of it.
RUN_ROWS, PIECE_ROWS = 1 << 14, 128


def wallet_events(
    topups: DataFrame | None = None, debits: DataFrame | None = None, refunds: DataFrame | None = None
) -> DataFrame:
    """One event frame (user_id, ts, event_id, kind, amount) from the given parts."""
    parts = [
        part.select("user_id", "ts", "event_id", F.lit(kind).alias("kind"), "amount")
        for kind, part in ((TOPUP, topups), (DEBIT, debits), (REFUND, refunds))
        if part is not None
    ]
    return reduce(DataFrame.unionByName, parts)


def wallet_ledger(
    events: DataFrame,
    opening: DataFrame | None = None,
    order: Sequence[str] = ("ts", "event_id"),
    slice_by: Column | None = None,
    refund_of: str | None = None,
    key: str = "event_id",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add ``accepted`` and ``balance`` (after the event) to wallet events.

    ``events``: user_id, kind, amount (two digits) and the ``order`` columns, total per
    user. ``opening``: user_id, balance; users without a row start at 0. ``slice_by``
    cuts histories to number them (see ``rank``); by default hours of ``ts``.
    ``refund_of`` names a column of refunds with the ``key`` of their debit: a refund of a
    refused debit, or of none that came before, is void. A refund without one counts.

    Rounds: each folds, for every user, the next run that can run short or holds a refund
    of a refused debit; what it refused moves the sums of all later runs. Users never
    short take no round, others one per such run.
    """
    columns = events.columns
    rows = durable(_numbered(events, order, time_slice("ts") if slice_by is None else slice_by, refund_of, key, run_rows))
    heads = _heads(rows, opening)
    refunds = rows.where(F.col("_ref").isNotNull()).select("_u", "_run", "_ref") if refund_of else None
    history, folded, refused, shifts = [], [], None, None
    while True:
        due = durable(_due(heads, shifts, refunds, refused))
        if due.isEmpty():
            break
        piece = durable(_fold(rows.join(due.select("_u", "_run", "_start"), ["_u", "_run"]), refused, refund_of is not None))
        folded.append(piece)
        lost = piece.where(~F.col("accepted")).groupBy("_u").agg(F.sum(-F.col("_delta")).alias("_lost"))
        shifts = due.join(lost, "_u", "left").select("_u", F.col("_run").alias("_after"), (F.col("_shift") + F.coalesce("_lost", F.lit(0))).alias("_shift"))
        history.append(shifts)
        if refund_of:
            new = piece.where((F.col("_delta") < 0) & ~F.col("accepted")).select("_u", F.col("_key").alias("_refused"))
            refused = new if refused is None else refused.unionByName(new)
    if not folded:
        return _closed(rows.join(heads.select("_u", "_run", F.col("_open").alias("_from")), ["_u", "_run"]), columns)
    closed = _closed(rows.join(_in_force(heads, history), ["_u", "_run"]), columns)
    return reduce(DataFrame.unionByName, [closed, *[_told(p, columns, F.col("_cents")) for p in folded]])


def _numbered(events: DataFrame, order: Sequence[str], slice_by: Column, refund_of: str | None, key: str, run_rows: int) -> DataFrame:
    """Events with user, signed cents, number, running sum and run; void ones with 0 cents."""
    cents = (F.col("amount") * 100).cast("long")
    rows = events.withColumns({
        "_delta": F.when(F.col("kind") == DEBIT, -cents).otherwise(cents), "_ok": F.lit(True),
        "_key": F.col(key) if refund_of else F.lit(None).cast("long"),
        "_ref": F.when(F.col("kind") == REFUND, F.col(refund_of)) if refund_of else F.lit(None).cast("long"),
    })
    if refund_of:
        debits = rows.where(F.col("kind") == DEBIT).select(F.struct("user_id").alias("_du"), F.col("_key").alias("_dk"), F.struct(*order).alias("_at"))
        rows = rows.join(debits, (F.struct("user_id") == F.col("_du")) & (F.col("_ref") == F.col("_dk")), "left")
        known = F.col("_ref").isNull() | F.coalesce(F.col("_at") < F.struct(*order), F.lit(False))
        rows = rows.withColumns({"_ok": known, "_delta": F.when(known, F.col("_delta")).otherwise(F.lit(0))}).drop("_du", "_dk", "_at")
    rows = accumulated(rows, ["user_id"], order, {"_no": None, "_sum": "_delta"}, slice_by)
    return rows.withColumns({"_u": F.struct("user_id"), "_run": F.floor((F.col("_no") - 1) / run_rows).cast("long")})


def _heads(rows: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Per user and run: opening balance, sum before the run, and the lowest sum within."""
    heads = rows.groupBy("_u", "_run").agg(F.min("_sum").alias("_dip"), F.min_by(F.col("_sum") - F.col("_delta"), "_no").alias("_base"))
    if opening is None:
        return heads.withColumn("_open", F.lit(0).cast("long"))
    start = opening.select(F.struct("user_id").alias("_u"), (F.col("balance") * 100).cast("long").alias("_open"))
    return heads.join(start, "_u", "left").withColumn("_open", F.coalesce("_open", F.lit(0)))


def _due(heads: DataFrame, shifts: DataFrame | None, refunds: DataFrame | None, refused: DataFrame | None) -> DataFrame:
    """The next run of each user that has to be folded, with the balance it starts from."""
    left = heads.withColumns({"_after": F.lit(-1).cast("long"), "_shift": F.lit(0).cast("long")}) if shifts is None else heads.join(shifts, "_u")
    left = left.where(F.col("_run") > F.col("_after"))
    short = F.col("_open") + F.col("_dip") + F.col("_shift") < 0
    if refused is not None:
        void = refunds.join(refused.withColumnRenamed("_u", "_ru"), (F.col("_u") == F.col("_ru")) & (F.col("_ref") == F.col("_refused")), "left_semi")
        left = left.join(void.select("_u", "_run").distinct().withColumn("_void", F.lit(True)), ["_u", "_run"], "left")
        short = short | F.coalesce("_void", F.lit(False))
    start = F.struct((F.col("_open") + F.col("_base") + F.col("_shift")).alias("_start"), "_shift", "_run")
    return left.where(short).groupBy("_u").agg(F.min_by(start, "_run").alias("s")).select("_u", "s.*")


def _fold(todo: DataFrame, refused: DataFrame | None, linked: bool) -> DataFrame:
    """Events of runs that start from ``_start``, in order: accepted and _cents after each.

    A run is one sorted array, folded in pieces: what is told of a piece grows with the
    piece only, and the balance goes on from piece to piece.
    """
    todo = todo.withColumn("_row", F.struct(*[c for c in todo.columns if c not in ("_u", "_run", "_start")]))
    if refused is not None:
        known = refused.select(F.col("_u").alias("_ru"), "_refused")
        todo = todo.join(known, (F.col("_u") == F.col("_ru")) & (F.col("_ref") == F.col("_refused")), "left")
    void = ~F.col("_ok") if refused is None else ~F.col("_ok") | F.col("_refused").isNotNull()
    each = F.struct("_no", "_delta", "_key", "_ref", void.alias("_void"), "_row")
    runs = todo.groupBy("_u", "_run").agg(F.first("_start").alias("_start"), F.sort_array(F.collect_list(each)).alias("_events"))

    def step(state: Column, e: Column) -> Column:
        """Balance, what is told, and the refused debits that a refund may name."""
        counts = ~e["_void"]
        if linked:
            counts = counts & ~F.coalesce(F.array_contains(state["gone"], e["_ref"]), F.lit(False))
        accepted = counts & ((e["_delta"] >= 0) | (state["cents"] + e["_delta"] >= 0))
        cents = state["cents"] + F.when(accepted, e["_delta"]).otherwise(F.lit(0))
        gone = state["gone"]
        if linked:
            gone = F.when((e["_delta"] < 0) & ~accepted, F.concat(gone, F.array(e["_key"]))).otherwise(gone)
        told = F.struct(accepted.alias("accepted"), cents.alias("_cents"))
        return F.struct(cents.alias("cents"), gone.alias("gone"), F.concat(state["told"], F.array(told)).alias("told"))

    keys = todo.schema["_key"].dataType.simpleString()
    tells = "array<struct<accepted: boolean, _cents: bigint>>"
    state = f"struct<cents: bigint, gone: array<{keys}>, told: {tells}>"
    nobody, nothing = F.array().cast(f"array<{keys}>"), F.array().cast(tells)
    size, width = F.size("_events"), PIECE_ROWS
    pieces = F.transform(F.sequence(F.lit(1), size, F.lit(width)), lambda i: F.slice("_events", i, width))

    def piece(acc: Column, events: Column) -> Column:
        begun = F.struct(acc["last"]["cents"].alias("cents"), acc["last"]["gone"].alias("gone"), nothing.alias("told"))
        return F.struct(F.aggregate(events, begun, step).alias("last"), F.concat(acc["told"], F.array(acc["last"]["told"])).alias("told"))

    first = F.struct(F.struct(F.col("_start").alias("cents"), nobody.alias("gone"), nothing.alias("told")).cast(state).alias("last"), F.array().cast(f"array<{tells}>").alias("told"))
    told = F.aggregate(pieces, first, piece, lambda acc: F.flatten(F.concat(acc["told"], F.array(acc["last"]["told"]))))
    pairs = F.zip_with("_events", told, lambda e, t: F.struct(e["_row"].alias("_row"), t["accepted"].alias("accepted"), t["_cents"].alias("_cents")))
    return runs.select("_u", "_run", F.inline(pairs)).select("_u", "_run", "_row.*", "accepted", "_cents")


def _in_force(heads: DataFrame, history: Sequence[DataFrame]) -> DataFrame:
    """Runs that were not folded, with what their running sums start from."""
    marks = reduce(DataFrame.unionByName, history)
    line = heads.select("_u", F.col("_run").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_shift"), "_open").unionByName(
        marks.select("_u", F.col("_after").alias("_at"), F.lit(1).alias("_kind"), "_shift"), allowMissingColumns=True
    )
    so_far = Window.partitionBy("_u").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = line.withColumn("_now", F.coalesce(F.last("_shift", ignorenulls=True).over(so_far), F.lit(0))).where(F.col("_kind") == 0)
    runs = now.select("_u", F.col("_at").alias("_run"), (F.col("_open") + F.col("_now")).alias("_from"))
    return runs.join(marks.select("_u", F.col("_after").alias("_run")), ["_u", "_run"], "left_anti")


def _closed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _told(rows.withColumn("accepted", F.col("_ok")), columns, F.col("_from") + F.col("_sum"))


def _told(rows: DataFrame, columns: Sequence[str], cents: Column) -> DataFrame:
    return rows.select(*columns, "accepted", money(cents * F.lit(0.01).cast("decimal(3,2)"), 18).alias("balance"))


def wallet_balances(ledger: DataFrame, opening: DataFrame | None = None, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Closing balance per user; users without events keep their opening balance."""
    closing = ledger.groupBy("user_id").agg(F.max_by("balance", F.struct(*order)).alias("_closing"))
    if opening is None:
        return closing.select("user_id", F.col("_closing").alias("balance"))
    return opening.select("user_id", F.col("balance").alias("_opening")).join(closing, "user_id", "full").select(
        "user_id", money(F.coalesce("_closing", "_opening"), 18).alias("balance")
    )


def transactions(bookings: DataFrame, refunds: DataFrame) -> DataFrame:
    """Booking and refund entries of the transaction log in one frame.

    ``bookings``: ticket_id, user_id, amount, ts, method. ``refunds`` the same
    with refund_to.
    """
    entry = ["ticket_id", "user_id", "amount", "transaction_type", "ts", "method", "payment_status", "remarks"]
    booked = bookings.select(
        "*", F.lit("booking").alias("transaction_type"), F.lit("confirmed").alias("payment_status"),
        F.lit(None).cast("string").alias("remarks"),
    ).select(entry)
    refunded = refunds.select(
        "*", F.lit("cancellation").alias("transaction_type"), F.lit("refunded").alias("payment_status"),
        F.concat(F.lit("Refunded to "), "refund_to").alias("remarks"),
    ).select(entry)
    return booked.unionByName(refunded)
