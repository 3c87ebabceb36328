"""Streams split into several files and batches equal the batch operators."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from berth.operators.rank import time_slice
from berth.operators.replay import replay_bookings
from berth.operators.wallet import wallet_ledger
from berth.streaming import stream as st
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def files(spark, folder, data, schema, parts):
    """Write ``data`` as one file per part, in time order."""
    size = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return st.read_stream(spark, str(folder), "*.parquet", max_files=1)


def test_wallet_stream(spark, tmp_path):
    rng = random.Random(3)
    schema = "user_id bigint, ts timestamp_ntz, event_id bigint, kind string, amount decimal(12,2)"
    data = [
        (rng.randrange(3), T0 + dt.timedelta(hours=i), i, rng.choice(["topup", "debit"]), Decimal(rng.randrange(1, 900)) / 100) for i in range(90)
    ]
    opening = spark.createDataFrame([(0, Decimal("3.00")), (7, Decimal("1.00"))], "user_id bigint, balance decimal(12,2)")
    got = st.collected(spark, st.stream_wallet(files(spark, tmp_path / "in", data, schema, 4), opening), "wallet")
    want = wallet_ledger(spark.createDataFrame(data, schema), opening)
    columns = "user_id", "event_id", "accepted", "balance"
    assert rows(got.select(*columns)) == rows(want.select(*columns))


def desk_events(seed, n=150):
    rng = random.Random(seed)
    closes = int((T0 + dt.timedelta(days=900)).timestamp() * 1000)
    out = []
    for i in range(n):
        s = 0 if rng.random() < 0.5 else rng.randrange(3)
        earlier = [e for e in out if e[0] == s and e[3] == "book"]
        if earlier and rng.random() < 0.4:
            out.append((s, T0 + dt.timedelta(minutes=i), i, "cancel", rng.choice(earlier)[4], 4, closes))
        else:
            out.append((s, T0 + dt.timedelta(minutes=i), i, "book", i, 4, closes))
    return out


DESK = "scope bigint, ts timestamp_ntz, event_id bigint, action string, passenger_id bigint, n_seats int, closes_ms bigint"


def test_desk_stream_equals_running_sums(spark, tmp_path):
    data = desk_events(5)
    said = st.collected(spark, st.stream_allocate(files(spark, tmp_path / "in", data, DESK, 3), rac_capacity=3), "desk").cache()
    first = said.where("event_id = passenger_id").select("passenger_id", "status", "queue_no")
    last = said.groupBy("passenger_id").agg(F.max_by("status", "event_id").alias("status"))
    want = replay_bookings(spark.createDataFrame(data, DESK), ["scope"], ["ts", "event_id"], time_slice("ts"), 3).cache()
    assert rows(first) == rows(want.select("passenger_id", "booked_status", "booked_queue_no"))
    assert rows(last) == rows(want.select("passenger_id", "final_status"))
    # nobody is given a seat that is still held
    held = {}
    for r in sorted(said.collect(), key=lambda r: (r.scope, r.event_id, r.status != "cancelled")):
        key = (r.scope, r.seat_no)
        if r.status == "cancelled":
            held = {k: v for k, v in held.items() if not (k[0] == r.scope and v == r.passenger_id)}
        elif r.status == "Confirmed":
            assert key not in held
            held[key] = r.passenger_id


def test_desk_state_ends_with_the_journey(spark, tmp_path):
    closes = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
    data = [
        (1, T0, 0, "book", 0, 1, closes),
        (2, T0 + dt.timedelta(days=9), 1, "book", 1, 1, closes + 10**10),
        (2, T0 + dt.timedelta(days=9, hours=1), 2, "book", 2, 1, closes + 10**10),
        (1, T0 + dt.timedelta(days=9, hours=2), 3, "book", 3, 1, closes + 10**10),
    ]
    said = st.collected(spark, st.stream_allocate(files(spark, tmp_path / "in", data, DESK, 4)), "desk")
    # the journey of scope 1 is over: its seat is not sold again
    assert rows(said.where("scope = 1").select("event_id", "status")) == [(0, "Confirmed"), (3, st.CLOSED)]
    assert rows(said.where("scope = 2").select("event_id", "status")) == [(1, "Confirmed"), (2, "RAC")]


def test_ingest_split_and_duplicates(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, phone string"
    data = [(i // 2, T0 + dt.timedelta(minutes=i // 2), None if i % 4 < 2 else "1") for i in range(20)]
    stream = files(spark, tmp_path / "in", data, schema, 2)
    unique = st.collected(spark, st.stream_dedup(stream), "dedup")
    assert rows(unique.select("event_id")) == sorted(((i,) for i in range(10)), key=lambda t: str(t[0]))
    st.stream_ingest(files(spark, tmp_path / "in2", data, schema, 2), F.col("phone").isNotNull(), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "valid")).count() == 10
    assert spark.read.parquet(str(tmp_path / "out" / "rejects")).count() == 10


def test_revenue_windows_close_behind_the_watermark(spark, tmp_path):
    schema = "ts timestamp_ntz, amount decimal(12,2), refund_status string"
    data = [(T0 + dt.timedelta(hours=8 * i), Decimal("1.50"), "Yes" if i % 5 == 0 else "No") for i in range(15)]
    got = st.collected(spark, st.stream_revenue(files(spark, tmp_path / "in", data, schema, 3)), "revenue")
    assert rows(got.select(F.to_date("window_start"), "total_revenue")) == [
        (dt.date(2024, 1, 1), Decimal("3.00")), (dt.date(2024, 1, 2), Decimal("3.00")), (dt.date(2024, 1, 3), Decimal("4.50")),
    ]


def test_refund_flags(spark, tmp_path):
    """Tickets before and after the change meet it, copies of a change flag nothing twice."""
    day = lambda n: T0 + dt.timedelta(days=n)
    changes = [(1, "Running", "Cancelled", day(1)), (2, "Cancelled", "Cancelled", day(2)), (1, "Running", "Cancelled", day(3)), (3, "Running", "Running", day(4)), (4, None, "Cancelled", day(30))]
    tickets = [(10, 1, day(0)), (20, 2, day(0)), (30, 3, day(2)), (11, 1, day(9)), (40, 4, day(29)), (12, 1, day(31))]
    one = files(spark, tmp_path / "a", changes, "schedule_id bigint, old_status string, status string, ts timestamp_ntz", 3)
    two = files(spark, tmp_path / "b", [(t, s, Decimal("1.00"), at) for t, s, at in tickets], "ticket_id bigint, schedule_id bigint, amount decimal(12,2), ts timestamp_ntz", 3)
    got = st.collected(spark, st.stream_refund_flags(one, two, watermark="60 days", reach="60 days"), "flags")
    assert rows(got.select("ticket_id", "refund_status")) == [(t, "Yes") for t in (10, 11, 12, 40)]
