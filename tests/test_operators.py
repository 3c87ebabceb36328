"""Small literal cases: nulls, empty input, ties, rejects."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from berth.functions import hms_to_seconds, parse_seat_code, pnr, utc_clock, utc_instant
from berth.operators import audit, booking, ingest, inventory, pricing, reports
from berth.sources import application_tables, constraints, read_ledger, schemas, write_ledger
from tests.conftest import rows


def test_times(spark):
    df = spark.createDataFrame([("6:00:00",), ("23:59:59",), (None,), ("bad",)], "t string")
    assert [r[0] for r in df.select(hms_to_seconds("t")).where("t <> 'bad' or t is null").collect()] == [21600, 86399, None]


def test_seat_codes(spark):
    df = spark.createDataFrame([("3A-S12",), ("RAC-3",), ("WL-10",), (None,), ("WL-x",)], "code string").withColumn("cls", F.lit("3A"))
    got = [tuple(r[0]) for r in df.select(parse_seat_code("code", "cls")).collect()]
    assert got == [("Confirmed", "S12", None), ("RAC", None, 3), ("WL", None, 10), (None, None, None), ("WL", None, None)]


def test_pnr_is_repeatable(spark):
    df = spark.range(3).select(pnr("id", dt.datetime(2002, 1, 1)).alias("p"))
    first = [r.p for r in df.collect()]
    assert first == [r.p for r in df.collect()]
    assert all(p.endswith("1009843200") and len(p) == 20 for p in first)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clock_round_trip(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as t")
        assert df.select(utc_clock(utc_instant("t")) == F.col("t")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_charge_bands(spark):
    days = [0, 1, 2, 7, 8, 15, 16, -3]
    base = dt.date(2025, 1, 1)
    df = spark.createDataFrame([(d, Decimal("100.00"), base + dt.timedelta(days=d)) for d in days], "d int, amount decimal(12,2), journey_date date")
    got = {r.d: r.charge for r in pricing.cancellation_charge(df, F.lit(base)).collect()}
    assert got == {d: Decimal(c) for d, c in zip(days, ("75.00", "75.00", "50.00", "50.00", "25.00", "25.00", "10.00", "75.00"))}


def test_refund_denominators(spark):
    people = spark.createDataFrame([(1, 1, "cancelled"), (2, 1, "Confirmed"), (3, 1, "WL")], "passenger_id bigint, ticket_id bigint, status string")
    tickets = spark.createDataFrame([(1, Decimal("100.00"))], "ticket_id bigint, total_fare decimal(12,2)")
    gone = people.where("passenger_id = 2")
    assert pricing.refund_amount(gone, people, tickets).first().refund == Decimal("30.00")
    assert pricing.refund_amount(gone, people, tickets, denominator="active").first().refund == Decimal("45.00")
    with pytest.raises(ValueError):
        pricing.refund_amount(gone, people, tickets, denominator="none")


def test_concessions(spark):
    ask = spark.createDataFrame([(1, 1, 1, 2, c) for c in ("Senior Citizen", "Student", "Disabled", "None", None)],
                                "train_id bigint, class_no bigint, src_station bigint, dst_station bigint, concession string")
    fares = spark.createDataFrame([(1, 1, 1, 2, Decimal("10.01"))], "train_id bigint, class_no bigint, src_station bigint, dst_station bigint, fixed_fare decimal(10,2)")
    got = {r.concession: str(r.fare) for r in pricing.price_route(ask, fares).collect()}
    assert got == {"Senior Citizen": "6.01", "Student": "7.51", "Disabled": "5.01", "None": "10.01", None: "10.01"}


def test_passenger_cap(spark):
    people = ",".join(f'{{"name":"P{i}","age":{20 + i},"gender":"Male"}}' for i in range(6))
    df = spark.createDataFrame([(1, f"[{people}]"), (2, "[]"), (3, None)], "booking_id bigint, passengers string")
    kept, rest = booking.explode_passengers(df)
    assert rows(kept.select("passenger_no", "name", "age")) == [(i + 1, f"P{i}", 20 + i) for i in range(4)]
    assert rows(rest.select("booking_id", "passenger_no", "reason")) == [
        (1, 5, booking.TOO_MANY), (1, 6, booking.TOO_MANY), (2, None, booking.NO_LIST), (3, None, booking.NO_LIST),
    ]


def test_append_new_keeps_the_first(spark):
    new = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, "a"), (3, 1, None)], "k int, o int, v string")
    old = spark.createDataFrame([(2,)], "k int")
    assert rows(inventory.append_new(new, old, ["k"], ["o"])) == [(1, 2, "b"), (3, 1, None)]
    assert inventory.append_new(new, None, ["k"], ["o"]).count() == 3


def test_registration(spark):
    columns = "user_id bigint, username string, dob date, email string, phone_primary string, phone_secondary string, user_type string, card_number string, card_expiry string, card_holder string, upi_id string"
    day = dt.date(1990, 1, 1)
    raw = spark.createDataFrame(
        [
            (1, "a", day, "a@x", None, None, None, None, None, None, None),  # no phone: the name stays free
            (2, "a", day, "a@x", "1", None, None, "4111", "12/26", "A", None),
            (3, "a", day, "b@x", "1", None, None, None, None, None, None),  # name taken: the email stays free
            (4, "b", day, "b@x", None, "2", "admin", None, None, None, "b@upi"),
            (5, "c", day, "b@x", "1", None, None, None, None, None, None),  # email taken
            (6, "d", None, "d@x", "1", None, None, None, None, None, None),
            (7, "e", day, "e@x", "1", None, None, None, None, None, None),
        ],
        columns,
    )
    got = ingest.ingest_users(raw, dt.datetime(2025, 1, 1))
    assert rows(got.users.select("user_id", "user_type")) == [(2, "normal"), (4, "admin"), (7, "normal")]
    assert rows(got.payment_methods.select("user_id", "is_active")) == [(2, True), (4, True)]
    assert rows(got.wallets.select("user_id", "balance")) == [(2, Decimal("0.00")), (4, Decimal("0.00")), (7, Decimal("0.00"))]
    assert rows(got.rejects.select("user_id", "reason")) == [
        (1, ingest.NO_PHONE), (3, ingest.TAKEN_NAME), (5, ingest.TAKEN_EMAIL), (6, ingest.MISSING_FIELD),
    ]


def test_ledger_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2025, 1, 5)), (2, dt.date(2025, 2, 6))], "id int, journey_date date")
    path = str(tmp_path / "ledger")
    write_ledger(df, path)
    write_ledger(df, path)  # the same batch again
    write_ledger(df.withColumn("id", F.col("id") + 10), path, batch="1")
    assert rows(read_ledger(spark, path, "2025-02").select("id")) == [(12,), (2,)]
    plan = read_ledger(spark, path, "2025-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(journey_month" in plan


def test_revenue_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "amount decimal(12,2), payment_date date, refund_status string")
    assert rows(reports.revenue(empty, dt.date(2025, 1, 1), dt.date(2025, 1, 2))) == [(None,)]


def test_busiest_tie_goes_to_the_smaller_station(spark):
    tickets = spark.createDataFrame([(1, 1), (2, 1)], "ticket_id bigint, schedule_id bigint")
    services = spark.createDataFrame([(1, 1)], "schedule_id bigint, route_id bigint")
    stops = spark.createDataFrame([(1, 5), (1, 3)], "route_id bigint, station_id bigint")
    stations = spark.createDataFrame([(3, "C"), (5, "E")], "station_id bigint, station string")
    assert rows(reports.busiest_stations(tickets, services, stops, stations)) == [(3, 2, "C")]


def test_flag_refunds_only_on_change(spark):
    before = spark.createDataFrame([(1, "Running"), (2, "Cancelled"), (3, "Running")], "schedule_id bigint, status string")
    after = spark.createDataFrame([(1, "Cancelled"), (2, "Cancelled"), (3, "Running")], "schedule_id bigint, status string")
    tickets = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "ticket_id bigint, schedule_id bigint")
    payments = spark.createDataFrame([(10, "No"), (20, "No"), (30, "No")], "ticket_id bigint, refund_status string")
    assert rows(reports.flag_refunds(before, after, tickets, payments)) == [(10, "Yes"), (20, "No"), (30, "No")]


def test_history_status_switch(spark):
    tickets = spark.createDataFrame(
        [(1, 1, 1, dt.date(2025, 1, 1), "confirmed"), (2, 1, 1, dt.date(2025, 1, 2), "RAC"), (3, 1, 1, dt.date(2025, 1, 3), "cancelled")],
        "ticket_id bigint, user_id bigint, train_id bigint, journey_date date, status string",
    )
    people = spark.createDataFrame([(2, 1, "B", "S2"), (1, 1, "A", "S1")], "passenger_id bigint, ticket_id bigint, name string, seat_code string")
    trains = spark.createDataFrame([(1, "T")], "train_id bigint, train_name string")
    refunds = spark.createDataFrame([(3, Decimal("1.00"), "processed"), (3, Decimal("2.00"), "processed")], "ticket_id bigint, refund_amount decimal(12,2), refund_status string")
    history = lambda **o: rows(reports.booking_history(tickets, people, trains, refunds, **o).select("ticket_id", "passenger_names", "refund_amount", "refund_status"))
    assert history(status="active") == [(1, "A, B", Decimal("0.00"), "N/A")]
    assert len(history(status="all")) == 4  # one row per cancellation step
    assert len(history(status="cancelled")) == 2
    assert history(start=dt.date(2025, 1, 2), end=dt.date(2025, 1, 2)) == [(2, None, Decimal("0.00"), "N/A")]
    with pytest.raises(ValueError):
        history(status="other")


def test_audits(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "a", 5), (None, "a", 5), (None, "a", 5)], "k int, v string, n int")
    assert rows(audit.unique_violations(df, ["k"])) == [(1, 2)]
    assert rows(audit.orphans(df, spark.createDataFrame([(1,)], "id int"), ["k"], ["id"])) == [(2, "a", 5)]
    assert rows(audit.null_violations(df, ["k", "v", "n"])) == [("k", 2), ("n", 1)]
    assert rows(audit.fd_violations(df, ["k"], ["v", "n"])) == [(1, "n"), (1, "v")]
    assert audit.cascade_delete(df, spark.createDataFrame([(1,)], "k int"), ["k"]).count() == 3
    assert rows(audit.null_out(df.where("k is not null"), spark.createDataFrame([(1,)], "k int"), "k").select("k")) == [(None,), (None,), (2,)]
    rules = {"v in list": audit.one_of("v", ["a"]), "n small": F.col("n") < 5, "v short": audit.max_length("v", 1)}
    assert rows(audit.domain_violations(df.where("k is not null"), rules).select("k", "rule")) == [(1, "n small"), (1, "v in list"), (2, "n small")]


def test_join_loss(spark):
    lossless = spark.createDataFrame([(1, a, b) for a in "xy" for b in "pq"], "k int, a string, b string")
    lossy = lossless.where("not (a = 'x' and b = 'q')")
    assert audit.join_loss(lossless, ["k", "a"], ["k", "b"]).isEmpty()
    assert rows(audit.join_loss(lossy, ["k", "a"], ["k", "b"])) == [(1, 3, 4)]
    with pytest.raises(ValueError):
        audit.join_loss(lossy, ["a"], ["b"])


@pytest.mark.parametrize("width", [1 << 16, 2])
def test_double_bookings(spark, width):
    held = [(3, 1, "Confirmed"), (1, 1, "Confirmed"), (2, 2, "Confirmed"), (5, 1, "Confirmed"), (4, 1, "RAC"), (6, None, "RAC"), (7, None, "RAC"), (8, None, "Confirmed"), (9, 1, None)]
    df = spark.createDataFrame(held, "id bigint, seat int, status string")
    got = audit.double_bookings(df, ["id"], F.floor(F.col("id") / width), ["seat"])
    assert rows(got.select("id", "claim_no")) == [(3, 2), (5, 3)]


def test_declared_rules(spark, tmp_path):
    tables = {
        "users": ("user_id bigint, username string, password string, email string, phone string, is_verified boolean, created_at timestamp_ntz, last_login timestamp_ntz, role string",
                  [(1, "a", "x", "a@x", None, True, None, None, "Admin"), (2, "a", "x", None, "1" * 16, True, None, None, "Boss")]),
        "passengers": ("passenger_id bigint, name string, age int, gender string, contact string, email string, concession string, user_id bigint",
                       [(1, "P", 0, "Male", "1", None, None, 9), (2, "Q", None, "Male", "1", None, "None", None)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    got = audit.audit_tables(application_tables(spark, str(tmp_path), "b", tables), "b")
    assert rows(got.where("n_violations > 0")) == [
        ("passengers", "age over 0", 1), ("passengers", "user_id in users", 1), ("users", "length phone <= 15", 1),
        ("users", "required email", 1), ("users", "unique username", 1), ("users", "values role", 1),
    ]
    assert got.count() > 15


def test_declared_rules_name_declared_columns():
    for unique, foreign, required, lengths, schema in (
        (constraints.UNIQUE_A, constraints.FOREIGN_A, constraints.REQUIRED_A, constraints.LENGTHS_A, schemas.SCHEMA_A),
        (constraints.UNIQUE_B, constraints.FOREIGN_B, constraints.REQUIRED_B, constraints.LENGTHS_B, schemas.SCHEMA_B),
    ):
        columns = {t: {c.split()[0] for c in re.sub(r"\([^)]*\)", "", ddl).split(", ")} for t, ddl in schema.items()}
        used = [(t, c) for t, keys in unique.items() for k in keys for c in k]
        used += [(t, c) for t, cs in required.items() for c in cs] + [(t, c) for t, cs in lengths.items() for c, _ in cs]
        used += [(t, c) for t, c, _, _ in foreign] + [(t, c) for _, _, t, c in foreign]
        assert [u for u in used if u[1] not in columns[u[0]]] == []


def test_refused_registrations_own_nothing(spark):
    raw = spark.createDataFrame(
        [(1, "a", "x@m"), (2, "b", "x@m"), (3, "b", "y@m"), (4, "c", "y@m"), (5, "c", "z@m"), (6, "c", "w@m")], "user_id bigint, username string, email string"
    )
    text = {c: F.lit(None).cast("string") for c in ("phone_secondary", "user_type", "card_number", "card_expiry", "card_holder", "upi_id")}
    got = ingest.ingest_users(raw.withColumns({"dob": F.lit(dt.date(2000, 1, 1)), "phone_primary": F.lit("1"), **text}), dt.datetime(2025, 1, 1))
    assert rows(got.users.select("user_id")) == [(1,), (3,), (5,)]
    assert rows(got.rejects.select("user_id", "reason")) == [(2, ingest.TAKEN_EMAIL), (4, ingest.TAKEN_EMAIL), (6, ingest.TAKEN_NAME)]


def test_no_booking_vanishes(spark):
    person = '{"name": "n", "age": 3, "concession": "None"}'
    bookings = spark.createDataFrame(
        [(1, 1, f"[{person}, {person}, {person}]"), (2, 1, "no list"), (3, 9, f"[{person}]"), (4, 1, "[]"), (5, 1, None)], "booking_id bigint, train_id bigint, passengers string"
    ).withColumns({"class_no": F.lit(1), "src_station": F.lit(1), "dst_station": F.lit(2), "schedule_id": F.lit(1), "journey_date": F.lit(dt.date(2025, 1, 1))})
    fares = spark.createDataFrame([(1, 1, 1, 2, Decimal("10.00"))], "train_id bigint, class_no int, src_station int, dst_station int, fixed_fare decimal(10,2)")
    seats = spark.createDataFrame([(1, dt.date(2025, 1, 1), 1, 10, "S1")], "schedule_id int, journey_date date, class_no int, coach_id bigint, seat_no string")
    tickets, rejects = booking.book_groups(bookings, fares, seats, dt.datetime(2025, 1, 1), cap=2)
    assert rows(tickets.select("booking_id", "passenger_no", "status")) == [(1, 1, "Confirmed"), (1, 2, "RAC")]
    assert rows(rejects.select("booking_id", "reason")) == [(1, booking.TOO_MANY), (2, booking.NO_LIST), (3, booking.NO_FARE), (4, booking.NO_LIST), (5, booking.NO_LIST)]


def test_refused_and_unpriced_requests_are_rejects(spark):
    day = dt.date(2025, 1, 1)
    asked = [(1, 1, "wallet", 1, 2), (2, 2, "wallet", 1, 2), (3, 1, "card", 1, 2), (4, 1, "card", 1, 7), (5, 1, None, 1, 2)]
    requests = spark.createDataFrame(asked, "event_id bigint, user_id bigint, method string, from_station int, to_station int").withColumns(
        {"route_id": F.lit(1), "train_id": F.lit(1), "class_no": F.lit(1), "schedule_id": F.lit(1), "journey_date": F.lit(day), "ts": F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz")}
    )
    stops = spark.createDataFrame([(1, 1, 0), (1, 2, 100)], "route_id int, station_id int, distance int")
    coaches = spark.createDataFrame([(1, 1, 10, Decimal("50.00"))], "train_id int, class_no int, coach_id bigint, base_fare decimal(10,2)")
    seats = spark.createDataFrame([(1, day, 1, 10, "S1")], "schedule_id int, journey_date date, class_no int, coach_id bigint, seat_no string")
    opening = spark.createDataFrame([(1, Decimal("50.00")), (2, Decimal("49.99"))], "user_id bigint, balance decimal(12,2)")
    tickets, rejects = booking.book_tickets(requests, stops, coaches, seats, opening, ["event_id"], None)
    assert rows(tickets.select("event_id", "status")) == [(1, "Confirmed"), (3, "RAC"), (5, "RAC")]
    assert rows(rejects.select("event_id", "reason")) == [(2, booking.NO_FUNDS), (4, booking.NO_FARE)]
