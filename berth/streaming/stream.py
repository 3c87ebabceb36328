"""Streams of registrations, wallet events, bookings, cancellations and status
changes.

Wallets and seat scopes are keyed state in Spark's state store (RocksDB), so a batch
touches the keys that it names and no others. Revenue, duplicates and refund flags are
built-in stateful operators under watermarks. Where a micro-batch is written as a whole,
its folder is named by batch id, so a batch run again replaces its own output.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from berth.functions import money, utc_clock, utc_instant
from berth.operators.wallet import DEBIT
from berth.session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def read_stream(spark: SparkSession, directory: str, glob: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, at most ``max_files`` per batch."""
    schema = spark.read.parquet(f"{directory}/{glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed everything that is there to ``step`` and stop."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _finish(query)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the finished rows of a stream to Parquet and stop."""
    with state_store(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        _finish(query)


def _finish(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def stream_ingest(stream: DataFrame, valid: Column, out: str) -> None:
    """Split a stream by a validity rule into ``out/valid`` and ``out/rejects``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        batch.where(ok).write.mode("overwrite").parquet(batch_folder(f"{out}/valid", batch_id))
        batch.where(~ok).write.mode("overwrite").parquet(batch_folder(f"{out}/rejects", batch_id))

    run_available(stream, step, f"{out}/checkpoint")


ENTRY = "user_id bigint, ts timestamp_ntz, event_id bigint, kind string, amount decimal(12,2), accepted boolean, cents bigint"


class WalletDesk(StatefulProcessor):
    """Wallet events of one user in order; the state is the balance in cents."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "cents bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.balance.update((initialState.cents,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        cents = self.balance.get()[0] if self.balance.exists() else 0
        for e in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            amount = int(e.amount * 100)
            accepted = e.kind != DEBIT or cents >= amount
            if accepted:
                cents += -amount if e.kind == DEBIT else amount
            yield Row(user_id=key[0], ts=e.ts, event_id=e.event_id, kind=e.kind, amount=e.amount, accepted=accepted, cents=cents)
        self.balance.update((cents,))

    def close(self) -> None:
        pass


def stream_wallet(stream: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Wallet ledger of a stream of events: the events with accepted and balance.

    Each user's balance is state of its own, begun from ``opening`` (user_id, balance); a
    batch reads and writes the users that it names. Events of a batch are taken in order
    of time and id, and must not be earlier than those of the batches before.
    """
    events = stream.select("user_id", "ts", "event_id", "kind", F.col("amount").cast("decimal(12,2)").alias("amount"))
    initial = None
    if opening is not None:
        initial = opening.select("user_id", (F.col("balance") * 100).cast("long").alias("cents")).groupBy("user_id")
    out = events.groupBy("user_id").transformWithState(WalletDesk(), ENTRY, "append", "none", initialState=initial)
    balance = money(F.col("cents") * F.lit(0.01).cast("decimal(3,2)"), 18)
    return out.select("user_id", "ts", "event_id", "kind", "amount", "accepted", balance.alias("balance"))


def stream_revenue(stream: DataFrame, watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """Revenue per event-time window; a window appears once the watermark passes."""
    return (
        stream.where(F.col("refund_status") == "No")
        .withColumn("_at", utc_instant("ts"))
        .withWatermark("_at", watermark)
        .groupBy(F.window("_at", width).alias("w"))
        .agg(F.sum("amount").alias("total_revenue"), F.count(F.lit(1)).alias("n_payments"))
        .select(utc_clock("w.start").alias("window_start"), utc_clock("w.end").alias("window_end"), "total_revenue", "n_payments")
    )


def stream_dedup(stream: DataFrame, key: str = "event_id", watermark: str = "1 day") -> DataFrame:
    """First event of each key; copies within the watermark are dropped."""
    timed = stream.withColumn("_at", utc_instant("ts")).withWatermark("_at", watermark)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def stream_refund_flags(
    changes: DataFrame, tickets: DataFrame, cancelled: str = "Cancelled", watermark: str = "1 day", reach: str = "400 days"
) -> DataFrame:
    """Payments to refund, as services become cancelled: a join of two streams.

    ``changes``: schedule_id, old_status, status, ts. ``tickets``: ticket_id, schedule_id,
    amount, ts. A ticket and the cancellation of its service meet whichever comes first, if
    their times lie within ``reach`` of each other; beyond that and the watermark both leave
    the state. Of the changes of a service the first cancellation within ``reach`` counts.
    """
    gone = changes.where((F.col("status") == cancelled) & ~F.col("old_status").eqNullSafe(F.lit(cancelled)))
    gone = gone.select(F.col("schedule_id").alias("_gone"), utc_instant("ts").alias("_when")).withWatermark("_when", reach)
    gone = gone.dropDuplicatesWithinWatermark(["_gone"])
    held = tickets.withColumn("_at", utc_instant("ts")).withWatermark("_at", watermark)
    near = (F.col("_at") >= F.col("_when") - F.expr(f"interval {reach}")) & (F.col("_at") <= F.col("_when") + F.expr(f"interval {reach}"))
    flagged = held.join(gone, (F.col("schedule_id") == F.col("_gone")) & near)
    return flagged.select("ticket_id", "schedule_id", "amount", F.lit("Yes").alias("refund_status"))


DECISION = "scope bigint, event_id bigint, passenger_id bigint, status string, seat_no string, queue_no bigint"
CLOSED = "closed"


class SeatDesk(StatefulProcessor):
    """Bookings and cancellations of one scope in event order.

    State: who holds which seat, and where each waiting passenger stands, by passenger; the
    reserve queue and the waitlist, by a number that only grows; and one row of counters.
    A decision touches the entries that it names. Seats are counted in the order in which
    they are sold; those that come back while nobody waits are kept apart and go first.

    A timer closes the scope when the journey is over: its entries go, a mark stays, and
    whatever comes later is refused.
    """

    LINES = ("rac", "wl")

    def __init__(self, rac_capacity: int):
        self.rac_capacity = rac_capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "closed boolean, seats int, sold int, back array<int>, next bigint, heads array<bigint>, sizes array<int>")
        self.held = handle.getMapState("held", "passenger bigint", "seat int")
        self.place = handle.getMapState("place", "passenger bigint", "line int, no bigint")
        self.lines = [handle.getMapState(name, "no bigint", "passenger bigint") for name in self.LINES]

    def _first(self, line: int) -> int:
        """Take the first passenger of a line, who is there."""
        no = self.heads[line]
        while not self.lines[line].containsKey((no,)):
            no += 1
        passenger = self.lines[line].getValue((no,))[0]
        self._leave(passenger, line, no)
        self.heads[line] = no + 1
        return passenger

    def _leave(self, passenger: int, line: int, no: int) -> None:
        self.lines[line].removeKey((no,))
        self.place.removeKey((passenger,))
        self.sizes[line] -= 1

    def _join(self, passenger: int, line: int) -> None:
        if not self.sizes[line]:
            self.heads[line] = self.next
        self.lines[line].updateValue((self.next,), (passenger,))
        self.place.updateValue((passenger,), (line, self.next))
        self.sizes[line] += 1
        self.next += 1

    def _close_up(self, said: Callable) -> Iterator[Row]:
        if self.sizes[1] and self.sizes[0] < self.rac_capacity:
            first = self._first(1)
            self._join(first, 0)
            yield said(first, "RAC", None, self.sizes[0])

    def _book(self, p: int, said: Callable) -> Row:
        if self.back or self.sold < self.seats:
            seat = self.back.pop(0) if self.back else self.sold
            self.sold = max(self.sold, seat + 1)
            self.held.updateValue((p,), (seat,))
            return said(p, "Confirmed", self.names[seat])
        line = 0 if self.sizes[0] < self.rac_capacity else 1
        self._join(p, line)
        return said(p, ("RAC", "WL")[line], None, self.sizes[line])

    def _cancel(self, p: int, said: Callable) -> Iterator[Row]:
        if self.held.containsKey((p,)):
            yield said(p, "cancelled")
            seat = self.held.getValue((p,))[0]
            self.held.removeKey((p,))
            if any(self.sizes):
                first = self._first(0 if self.sizes[0] else 1)
                self.held.updateValue((first,), (seat,))
                yield said(first, "Confirmed", self.names[seat])
                yield from self._close_up(said)
            else:
                self.back.insert(bisect_left(self.back, seat), seat)
        elif self.place.containsKey((p,)):
            yield said(p, "cancelled")
            self._leave(p, *self.place.getValue((p,)))
            yield from self._close_up(said)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r.ts, r.event_id))
        if self.counters.exists():
            closed, self.seats, self.sold, back, self.next, heads, sizes = self.counters.get()
            self.back, self.heads, self.sizes = list(back), list(heads), list(sizes)
        else:
            closed, self.seats, self.sold, self.next = False, events[0].n_seats, 0, 0
            self.back, self.heads, self.sizes = [], [0, 0], [0, 0]
            self.handle.registerTimer(int(events[0].closes_ms))
        self.names = sorted(f"S{i + 1}" for i in range(self.seats))
        for e in events:

            def said(passenger: int, status: str, seat: str | None = None, number: int | None = None, e: Row = e) -> Row:
                return Row(scope=key[0], event_id=e.event_id, passenger_id=passenger, status=status, seat_no=seat, queue_no=number)

            if closed:
                yield said(e.passenger_id, CLOSED)
            elif e.action == "book":
                yield self._book(e.passenger_id, said)
            else:
                yield from self._cancel(e.passenger_id, said)
        self.counters.update((closed, self.seats, self.sold, self.back, self.next, self.heads, self.sizes))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        seats = self.counters.get()[1]
        for state in (self.held, self.place, *self.lines):
            state.clear()
        self.counters.update((True, seats, 0, [], 0, [0, 0], [0, 0]))
        return iter(())

    def close(self) -> None:
        pass


def stream_allocate(stream: DataFrame, rac_capacity: int = 8, watermark: str = "1 day") -> DataFrame:
    """Decisions on an interleaved stream of bookings and cancellations.

    ``stream``: scope, ts, event_id, action ('book' or 'cancel'), passenger_id,
    n_seats and closes_ms (epoch milliseconds after which the scope is closed).
    One row per booking, cancellation and promotion, in event order per scope. A
    cancellation of a passenger who holds nothing is ignored; whatever comes for a
    scope that is closed has the status ``closed``.
    """
    return (
        stream.withColumn("_at", utc_instant("ts"))
        .withWatermark("_at", watermark)
        .groupBy("scope")
        .transformWithState(SeatDesk(rac_capacity), DECISION, "append", "eventTime")
    )


class Collected:
    """Output of a stream that is run over what is there, again and again, and read back."""

    def __init__(self, spark: SparkSession, stream: DataFrame, name: str):
        self.spark, self.stream, self.out = spark, stream, scratch(spark, name)

    def run(self) -> None:
        write_available(self.stream, f"{self.out}/rows", f"{self.out}/checkpoint")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.stream.schema).parquet(f"{self.out}/rows")


def collected(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read its output back."""
    found = Collected(spark, stream, name)
    found.run()
    return found.rows()
