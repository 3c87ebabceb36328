"""What is not shuffled or worked out twice."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from berth.operators import allocate as al
from berth.operators import cancellation, lossless, reports
from berth.operators.rank import id_slice, ranked
from tests.conftest import rows


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [None, 1, 2, 100])
def test_items_travel_with_the_slices(spark, width):
    """The k-th row of a key gets the k-th item, over lists and slices cut anywhere; a null key gets none."""
    df = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 0), (None, 0)], "k int, id long")
    lists = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 3, ["d"]), (1, 4, ["e"]), (3, 0, ["x"]), (None, 0, ["y"])], "k int, _from long, _items array<string>")
    out = ranked(df, ["k"], ["id"], "r", None if width is None else id_slice("id", width), lists=lists)
    assert out.columns == ["k", "id", "r", "_item"]
    assert rows(out) == rows(spark.createDataFrame([(1, i, i + 1, "abcde"[i] if i < 5 else None) for i in range(7)] + [(2, 0, 1, None), (None, 0, 1, None)], "k int, id long, r long, i string"))


def test_requests_are_not_shuffled_to_meet_seats(spark, no_broadcast):
    requests = spark.createDataFrame([(1, i) for i in range(4)], "k int, id long")
    seats = spark.createDataFrame([(1, 7, "S10"), (1, 6, "S3"), (1, 7, "S2")], "k int, coach_id long, seat_no string")
    done = al.allocate(requests, seats, ["id"], id_slice("id", 2), scope=("k",))
    assert not [line for line in plan(done).splitlines() if "Exchange" in line and "_r#" in line]
    assert [r[1:5] for r in rows(done)] == [(0, "Confirmed", 6, "S3"), (1, "Confirmed", 7, "S10"), (2, "Confirmed", 7, "S2"), (3, "RAC", None, None)]


def test_cancelled_are_marked_once(spark, no_broadcast):
    people = spark.createDataFrame([(1, 1, "Confirmed", 1, "S1", None), (2, 1, "RAC", None, None, 1)], "passenger_id int, k int, status string, coach_id long, seat_no string, queue_no long")
    after = al.cancel(spark.createDataFrame([(1,), (1,)], "passenger_id int"), people, scope=("k",))
    assert "_gone" not in plan(after)
    assert [(r.passenger_id, r.status, r.seat_no) for r in after.orderBy("passenger_id").collect()] == [(1, "cancelled", None), (2, "Confirmed", "S1")]


def test_history_deals_passengers_by_ticket(spark):
    day = dt.date(2024, 1, 1)
    tickets = spark.createDataFrame([(1, 1, day, "confirmed")], "ticket_id long, train_id long, journey_date date, status string")
    people = spark.createDataFrame([(1, 2, "B", "WL-1"), (1, 1, "A", None), (2, 3, "C", "WL-2")], "ticket_id long, passenger_id long, name string, seat_code string")
    trains = spark.createDataFrame([(1, "T")], "train_id long, train_name string")
    refunds = spark.createDataFrame([], "ticket_id long, refund_amount decimal(12,2), refund_status string")
    found = reports.booking_history(tickets, people, trains, refunds)
    assert "REPARTITION_BY_COL" in plan(found)
    assert [(r.passenger_names, r.seat_allocations) for r in found.collect()] == [("A, B", "WL-1")]


def test_detail_meets_service_and_seats_in_one_join(spark, no_broadcast):
    """Equal seats give a row each, as a join by seat did; a seat that is not known gives none."""
    day = dt.date(2024, 1, 1)
    tickets = spark.createDataFrame(
        [(1, 0, 10, day, "Confirmed", 5, "S1", None, day, None, None), (2, 0, 10, day, "RAC", None, None, 3, day, None, None), (3, 0, 10, day, "Confirmed", 6, "S1", None, day, None, None)],
        "no long, class_no long, schedule_id long, journey_date date, status string, coach_id long, seat_no string, queue_no long, booking_date date, amount decimal(12,2), payment_mode string",
    )
    services = spark.createDataFrame([(10, 1)], "schedule_id long, train_id long")
    trains = spark.createDataFrame([(1, "T", "Express", 1, 2)], "train_id long, train_name string, train_type string, src_station long, dst_station long")
    stations = spark.createDataFrame([(1, "A"), (2, "B")], "station_id long, station string")
    classes = spark.createDataFrame([(0, "1A")], "class_no long, class_name string")
    seats = spark.createDataFrame([(10, 5, "S1", "Lower"), (10, 5, "S1", "Upper"), (10, None, "S1", "Lower"), (11, 6, "S1", "Lower")], "schedule_id long, coach_id long, seat_no string, seat_type string")
    found = reports.ticket_detail(tickets, services, trains, stations, classes, seats, passenger=("no",))
    assert rows(found.select("no", "seat_info", "train_name")) == [(1, "Lower-S1", "T"), (1, "Upper-S1", "T"), (2, "RAC-3", "T"), (3, None, "T")]


def test_turns_work_rows_out_once(spark):
    from berth.plans.stream_queries import Turns

    source = spark.range(9).select("id", F.make_date(F.lit(2024), F.lit(1), (F.col("id") + 1).cast("int")).cast("timestamp_ntz").alias("ts"))
    turns = Turns(SimpleNamespace(spark=spark), source)
    assert turns.rows.inputFiles()
    for turn in range(3):
        turns.arrive(turn)
    assert sorted(r.id for r in spark.read.parquet(turns.path).collect()) == list(range(9))


def test_last_ticket_pays_once_per_order(spark, tmp_path):
    """Two equal orders pay twice, two equal last tickets each; earlier tickets pay nothing."""
    from berth.plans.bind import Bound

    day = dt.datetime(1996, 1, 2)
    orders = [(1, 1, "P", 10.0, day, "1-URGENT"), (1, 1, "P", 10.0, day, "1-URGENT"), (2, 1, "P", None, day, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 1, 1), (None, 1, 1, 1)]
    spark.createDataFrame(
        [(*line, 3.0, 1.0, "R", day) for line in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    paid = Bound(spark, str(tmp_path)).paid_tickets.select("booking_id", "line_no", "amount")
    assert [(r.booking_id, r.line_no, None if r.amount is None else float(r.amount)) for r in paid.orderBy("booking_id").collect()] == [(1, 2, 10.0)] * 4 + [(2, 1, None)]


def test_parts_are_folded_before_they_meet(spark, no_broadcast):
    """What no later step needs of a part is summed away before the part is shuffled."""
    df = spark.createDataFrame([(i, i % 5, i % 3, i % 2) for i in range(60)], "ticket int, service int, season int, seat int")
    parts = (("ticket", "service"), ("service", "season"), ("ticket", "seat"))
    assert lossless.join_tree(parts) == [(2, 0, ["ticket"]), (1, 0, ["service"])]
    size = lossless.joined_size(df, parts)
    assert tuple(size.first()) == (60, 180)
    text = size._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [service#" in line and "sum(_" in line for line in text.splitlines()) == 1, text


def test_cancels_with_tickets_shuffle_passengers_once(spark, no_broadcast):
    """Passengers, cancels and fares meet by ticket; repeated rows, nulls and cancels without tickets give what joins by passenger gave."""
    people = spark.createDataFrame(
        [(1, 7, 1, "Confirmed", 1, "S1", None), (2, 7, 1, "cancelled", None, None, None), (3, 8, 1, "RAC", None, None, 1), (3, 8, 1, "RAC", None, None, 2),
         (4, 9, 1, "Confirmed", 1, "S2", None), (5, 9, 1, "WL", None, None, 1), (None, 9, 1, "WL", None, None, 2), (6, 10, 1, "WL", None, None, 3)],
        "passenger_id long, ticket_id long, k int, status string, coach_id long, seat_no string, queue_no long",
    )
    tickets = spark.createDataFrame(
        [(7, 70, 10.0, "card", "confirmed"), (8, 80, 20.0, "wallet", "confirmed"), (8, 81, 40.0, "wallet", "confirmed"), (9, 90, 30.0, "card", "confirmed")],
        "ticket_id long, user_id long, total_fare double, method string, status string",
    ).withColumn("total_fare", F.col("total_fare").cast("decimal(12,2)"))
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    cancels = spark.createDataFrame(
        [(1, 7, late, "card"), (1, 7, early, "wallet"), (2, 7, early, "card"), (3, 8, early, "card"), (4, 9, late, "card"), (None, 9, late, "card"), (99, 9, late, "card"), (6, 10, late, "card")],
        "passenger_id long, ticket_id long, ts timestamp, refund_to string",
    )
    text = plan(cancellation._marked(cancels, people, tickets, "active"))
    shuffles = [line for line in text.splitlines() if "Exchange" in line]
    assert len(shuffles) == 2 and all("hashpartitioning(ticket_id" in line and "passenger_id" not in line for line in shuffles), text
    for asked in (cancels, cancels.drop("ticket_id")):
        out = cancellation.cancellation(asked, people, tickets, scope=("k",))
        after = sorted((r.passenger_id or 0, r.status, r.seat_no or "", r.queue_no or 0) for r in out["passengers"].collect())
        assert after == [(0, "Confirmed", "S2", 0), (1, "cancelled", "", 0), (2, "cancelled", "", 0), (3, "cancelled", "", 0), (3, "cancelled", "", 0), (4, "cancelled", "", 0), (5, "Confirmed", "S1", 0), (6, "cancelled", "", 0)]
        assert rows(out["tickets"].where("status = 'cancelled'").select("ticket_id", "user_id")) == [(7, 70), (8, 80), (8, 81)]
        paid = [(r.passenger_id, r.user_id, r.ts, float(r.amount), r.refund_to) for r in out["refunds"].orderBy("passenger_id", "user_id", "amount").collect()]
        assert paid == [(1, 70, early, 9.0, "wallet"), *[(3, u, early, a, "card") for u in (80, 81) for a in (9.0, 18.0) for _ in range(4)], (4, 90, late, 9.0, "card")]
