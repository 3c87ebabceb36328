"""Bookings of a small invented network, traced by hand, and the CSV layout."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from berth.operators import allocate as al
from berth.operators import inventory, pricing, search
from berth.operators.rank import id_slice
from berth.sources import read_fixture
from berth.sources.adapters import frames_a, frames_b
from tests.conftest import rows

# A small sample in the file layout: two routes between the same towns, one reversed.
TRAINS = "71,Coast Line,Fast\r\n72,Night Line,Slow\r\n"
SCHEDULE = '1,"Mon,Wed",active\r\n2,"Mon,Sat,Sun",active\r\n'
STOPS = (
    "1,Arden,1,NULL,7:30:00,0\r\n1,Brook,2,9:05:00,9:15:00,120\r\n1,Castle,3,11:00:00,11:08:00,260\r\n1,Dunes,4,14:20:00,NULL,400\r\n"
    "2,Elm,1,NULL,15:00:00,0\r\n2,Dunes,2,22:30:00,22:40:00,310\r\n2,Castle,3,1:15:00,1:25:00,450\r\n2,Arden,4,5:50:00,NULL,710\r\n"
)
COACHES = "1,1A,A1,12,12,4.5\r\n1,2A,B1,20,20,3.0\r\n1,SL,S1,30,0,1\r\n2,1A,A1,12,12,4.5\r\n"


@pytest.fixture(scope="module")
def a(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    out = {}
    for name, key, text in (("Trains", "trains", TRAINS), ("TrainSchedule", "services", SCHEDULE), ("TrainStops", "stops", STOPS), ("Coaches", "coaches", COACHES)):
        path = folder / f"{name}.csv"
        path.write_bytes(text.encode())
        out[key] = read_fixture(spark, name, str(path))
    return frames_a(out)


def ask(spark, day):
    return spark.createDataFrame([("Arden", "Dunes", day)], "from_station string, to_station string, journey_date date")


def test_csv_layout(a):
    assert rows(a["trains"].select("train_id", "train_number")) == [(1, "71"), (2, "72")]
    assert a["services"].where("schedule_id = 1").first().running_days == ["Mon", "Wed"]
    assert rows(a["stops"].where("route_id = 1").select("stop_no", "arr_s", "dep_s")) == [
        (1, None, 27000), (2, 32700, 33300), (3, 39600, 40080), (4, 51600, None),
    ]
    assert a["coaches"].where("coach_id = 1").first().base_fare == Decimal("4.50")


def test_search_needs_order_day_and_seats(spark, a):
    found = search.search_trips(ask(spark, dt.date(2025, 4, 30)), a["trains"], a["services"], a["stops"], a["coaches"])
    assert rows(found.select("schedule_id", "class_name", "distance", "fare")) == [(1, "1A", 400, Decimal("18.00")), (1, "2A", 400, Decimal("12.00"))]
    tuesday = search.search_trips(ask(spark, dt.date(2025, 4, 29)), a["trains"], a["services"], a["stops"], a["coaches"])
    assert tuesday.isEmpty()
    every_day = search.train_availability(ask(spark, dt.date(2025, 4, 29)), a["trains"], a["services"], a["stops"])
    assert rows(every_day.select("schedule_id", "dep_s", "arr_s")) == [(1, 27000, 51600)]


def test_overnight_duration(spark, a):
    dated = inventory.expand_services(a["services"], dt.date(2025, 4, 28), dt.date(2025, 4, 28))
    night = spark.createDataFrame([("Dunes", "Arden", dt.date(2025, 4, 28))], "from_station string, to_station string, journey_date date")
    trains = a["trains"].withColumn("src_station", F.lit("x")).withColumn("dst_station", F.lit("y"))
    found = search.find_dated_trips(night, trains, dated, a["stops"])
    assert rows(found.select("duration_s", "elapsed_s")) == [(21000 - 81600, 21000 - 81600 + 86400)]


def test_inventory(a):
    two_days = inventory.populate_seats(a["coaches"], a["services"], [dt.date(2025, 4, 30), dt.date(2025, 5, 1)])
    assert two_days.count() == 2 * (12 + 20 + 30 + 12)
    again = inventory.populate_seats(a["coaches"], a["services"], [dt.date(2025, 4, 30)], existing=two_days)
    assert again.isEmpty()
    with pytest.raises(ValueError):
        inventory.populate_seats(a["coaches"], a["services"], [])


def test_two_bookings_and_a_cancellation(spark, a):
    day, other = dt.date(2025, 4, 30), dt.date(2025, 4, 14)
    seats = inventory.populate_seats(a["coaches"], a["services"], [day])
    people = spark.createDataFrame(
        [(1, 1, 1, other, "1A", "Arden", "Dunes"), (2, 2, 1, day, "1A", "Arden", "Dunes"), (3, 2, 1, day, "1A", "Arden", "Dunes")],
        "passenger_id bigint, ticket_id bigint, schedule_id bigint, journey_date date, class_no string, from_station string, to_station string",
    ).withColumn("train_id", F.lit(1).cast("long")).withColumn("route_id", F.col("schedule_id"))
    priced = pricing.price_distance(people, a["stops"], a["coaches"])
    assert {r.fare for r in priced.collect()} == {Decimal("18.00")}
    done = al.allocate(priced, seats, ["passenger_id"], id_slice("passenger_id"))
    coded = al.with_seat_code(done, "class_no")
    # no inventory on the first date: first place of the reserve queue
    assert rows(coded.select("passenger_id", "seat_code")) == [(1, "RAC-1"), (2, "1A-S1"), (3, "1A-S10")]
    gone = done.where("passenger_id = 2").select("passenger_id", "ticket_id")
    tickets = priced.groupBy("ticket_id").agg(F.sum("fare").alias("total_fare"))
    refund = pricing.refund_amount(gone, done, tickets)
    assert refund.first().refund == Decimal("16.20")
    after = al.cancel(gone, done, al.available_seats(seats, done))
    # the reserve of another date is not moved up
    assert rows(after.select("passenger_id", "status", "seat_no")) == [(1, "RAC", None), (2, "cancelled", None), (3, "Confirmed", "S10")]


def test_passengers_of_the_denormalised_schema(spark, a):
    tables = {
        "trains": a["trains"], "services": a["services"].drop("route_id"),
        "stops": spark.createDataFrame([(1, "Arden", 1, None, "7:30:00", 0)], "schedule_id bigint, station string, stop_no int, arrival string, departure string, distance int"),
        "coaches": a["coaches"].drop("class_no"),
        "tickets": spark.createDataFrame(
            [(1, "PNR1", 7, 1, 1, dt.date(2025, 4, 30), Decimal("10.00"))],
            "ticket_id bigint, pnr string, user_id bigint, train_id bigint, schedule_id bigint, journey_date date, total_fare decimal(10,2)",
        ),
        "passengers": spark.createDataFrame(
            [(1, 1, "A", 30, "F", "3A", "3A-S12", "confirmed"), (2, 1, "B", 31, "M", "3A", "WL-7", "WL"), (3, 1, "C", 32, "M", "3A", "3A-S2", "cancelled")],
            "passenger_id bigint, ticket_id bigint, name string, age int, gender string, class_name string, seat_code string, status string",
        ),
    }
    people = frames_a(tables)["passengers"]
    assert rows(people.select("passenger_id", "status", "seat_no", "queue_no")) == [
        (1, "Confirmed", "S12", None), (2, "WL", None, 7), (3, "cancelled", "S2", None),
    ]


def test_normalised_schema(spark):
    out = frames_b(
        {
            "trains": spark.createDataFrame([(1, "T", "Express", 1, 2)], "train_id bigint, train_name string, train_type string, src_station bigint, dst_station bigint"),
            "stations": spark.createDataFrame([(1, "Arden"), (2, "Dunes")], "station_id bigint, station string"),
            "classes": spark.createDataFrame([(1, "Sleeper", Decimal("1.00"))], "class_no bigint, class_name string, fare_per_km decimal(6,2)"),
            "services": spark.createDataFrame([(5, 1, dt.date(2025, 4, 30), "Running")], "schedule_id bigint, train_id bigint, service_date date, status string"),
            "routes": spark.createDataFrame(
                [(1, 1, None, "7:30:00", 1, Decimal("0.00")), (1, 2, "14:20:00", None, 2, Decimal("400.00"))],
                "train_id bigint, station_id bigint, arrival string, departure string, stop_no int, distance decimal(10,2)",
            ),
            "seats": spark.createDataFrame([(9, 1, 1, "S1", "Window")], "seat_id bigint, train_id bigint, class_no bigint, seat_no string, seat_type string"),
            "seat_availability": spark.createDataFrame([(5, 9, False)], "schedule_id bigint, seat_id bigint, is_booked boolean"),
        }
    )
    request = spark.createDataFrame([(1, 2, dt.date(2025, 4, 30))], "from_station bigint, to_station bigint, journey_date date")
    found = search.find_dated_trips(request, out["trains"], out["dated"], out["stops"])
    assert rows(found.select("schedule_id", "duration_s", "src_station")) == [(5, 24600, 1)]
    assert rows(out["seats"].select("schedule_id", "class_no", "coach_id", "seat_no")) == [(5, 1, 9, "S1")]
