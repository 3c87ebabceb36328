"""What travels with ranks, and what tells passengers apart."""

import datetime as dt

from pyspark.sql import functions as F

from berth.operators import allocate as al
from berth.operators import reports
from berth.operators.rank import id_slice, ranked
from berth.plans.bind import Bound
from tests.conftest import rows


def test_capacity_travels_with_the_slices(spark):
    """A capacity per queue is joined to the slices, not to the rows; a null key finds none."""
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 70000), (None, 3), (None, 4)], "k int, id long")
    cap = spark.createDataFrame([(1, 5), (None, 9)], "k int, _cap int")
    for slice_by in (id_slice("id"), None):
        out = ranked(df, ["k"], ["id"], "r", slice_by, None, cap).select("k", "id", "r", "_cap")
        assert rows(out) == rows(spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 5), (2, 70000, 1, None), (None, 3, 1, None), (None, 4, 2, None)], "k int, id long, r long, _cap int"))
    seats = spark.createDataFrame([(1, 1, "S1")], "k int, coach_id long, seat_no string")
    done = al.allocate(df, seats, ["id"], id_slice("id"), rac_capacity=cap.select("k", F.col("_cap").alias("rac_capacity")), scope=("k",))
    assert {(r.k, r.id): (r.status, r.seat_no, r.queue_no) for r in done.collect()} == {
        (1, 1): ("Confirmed", "S1", None), (1, 2): ("RAC", None, 1), (2, 70000): ("WL", None, 1), (None, 3): ("WL", None, 1), (None, 4): ("WL", None, 2),
    }


def test_manifest_by_numbers(spark):
    services = spark.createDataFrame([(10, 1)], "schedule_id long, train_id long")
    day = dt.date(2024, 1, 1)
    tickets = spark.createDataFrame([(10, day, 7, 1, "WL"), (10, day, 7, 1, "WL"), (10, day, 7, 2, "WL"), (11, day, 8, 1, "WL")], "schedule_id long, journey_date date, booking_id long, line_no long, status string")
    assert rows(reports.manifest(tickets, services, columns=("booking_id", "line_no", "status"))) == [(1, day, 7, 1, "WL"), (1, day, 7, 2, "WL")]


def test_ticket_id_of_another_date(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, dt.date(2024, 5, 6))], "booking_id long, line_no long, part_id long, train_id long, asked_for date")
    assert df.select(Bound.ticket_id("asked_for")).first()[0] == "1-2-3-4-20240506"
