import datetime as dt
from functools import partial
import random

import pytest
from pyspark.sql import functions as F

from berth.operators import allocate as al
from berth.operators.rank import id_slice, time_slice
from berth.operators.replay import replay_bookings
from tests import replay
from tests.conftest import rows

REQUEST = "rid bigint, schedule_id bigint, class_no bigint"
SEAT = "schedule_id bigint, class_no bigint, coach_id bigint, seat_no string"

# The services of these cases run once.
SERVICE = ("schedule_id", "class_no")
allocate, cancel = partial(al.allocate, scope=SERVICE), partial(al.cancel, scope=SERVICE)
promote, availability_status = partial(al.promote, scope=SERVICE), partial(al.availability_status, scope=SERVICE)
available_seats = partial(al.available_seats, key=("schedule_id", "coach_id", "seat_no"))


def batch(seed, scopes=4, requests=120, seats=7):
    rng = random.Random(seed)
    # scope 0 draws about half of the requests
    ask = [(i, 0 if rng.random() < 0.5 else rng.randrange(scopes), 1) for i in range(requests)]
    have = [(s, 1, 10 * s + c, f"S{n}") for s in range(scopes) for c in (1, 2) for n in range(1, seats + 1) if rng.random() < 0.7]
    return ask, have


@pytest.mark.parametrize("width", [1 << 16, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_allocate_equals_replay(spark, seed, width):
    ask, have = batch(seed)
    got = allocate(
        spark.createDataFrame(ask, REQUEST), spark.createDataFrame(have, SEAT), ["rid"], id_slice("rid", width), rac_capacity=3
    )
    want = []
    for s in {a[1] for a in ask}:
        seats = [(h[2], h[3]) for h in have if h[0] == s]
        want += [(r, st, *(seat or (None, None)), q) for r, st, seat, q in replay.allocate([a[0] for a in ask if a[1] == s], seats, 3)]
    assert {tuple(r) for r in got.select("rid", "status", "coach_id", "seat_no", "queue_no").collect()} == set(want)


@pytest.mark.parametrize("width", [1 << 16, 8])
def test_class_wide_queue(spark, width):
    ask, have = batch(3)
    old = [(1, "RAC")] * 2 + [(1, "WL")] * 4
    got = allocate(
        spark.createDataFrame(ask, REQUEST), spark.createDataFrame(have, SEAT), ["rid"], id_slice("rid", width),
        existing=spark.createDataFrame(old, "class_no bigint, status string"), rac_capacity=6, queue_scope=["class_no"],
    )
    free = {s: sum(h[0] == s for h in have) for s in range(4)}
    want, rac, wl = {}, 2, 4
    for rid, s, _ in ask:
        if free[s]:
            free[s] -= 1
            want[rid] = ("Confirmed", None)
        elif rac < 6:
            rac += 1
            want[rid] = ("RAC", rac)
        else:
            wl += 1
            want[rid] = ("WL", wl)
    assert {r.rid: (r.status, r.queue_no) for r in got.collect()} == want


def test_no_seats_queue_starts_at_one(spark):
    got = allocate(
        spark.createDataFrame([(1, 1, 1)], REQUEST), spark.createDataFrame([], SEAT), ["rid"], id_slice("rid")
    )
    assert rows(got.select("status", "seat_no", "queue_no")) == [("RAC", None, 1)]


def test_seat_order(spark):
    ask = spark.createDataFrame([(i, 1, 1) for i in range(2)], REQUEST)
    seats = spark.createDataFrame([(1, 1, 9, "S2"), (1, 1, 9, "S10"), (1, 1, 9, "S1")], SEAT)
    lexical = allocate(ask, seats, ["rid"], id_slice("rid"))
    numeric = allocate(ask, seats, ["rid"], id_slice("rid"), seat_order="numeric")
    assert rows(lexical.select("rid", "seat_no")) == [(0, "S1"), (1, "S10")]
    assert rows(numeric.select("rid", "seat_no")) == [(0, "S1"), (1, "S2")]
    with pytest.raises(ValueError):
        allocate(ask, seats, ["rid"], id_slice("rid"), seat_order="random")


@pytest.mark.parametrize("width", [1 << 16, 8])
@pytest.mark.parametrize("seed", [5, 6])
def test_cancel_equals_replay(spark, seed, width):
    ask, have = batch(seed, requests=100, seats=4)
    rng = random.Random(seed)
    gone = [a[0] for a in ask if rng.random() < 0.35]
    done = allocate(spark.createDataFrame(ask, REQUEST), spark.createDataFrame(have, SEAT), ["rid"], id_slice("rid", width), rac_capacity=3).cache()
    after = cancel(
        spark.createDataFrame([(g,) for g in gone], "rid bigint"), done, available_seats(spark.createDataFrame(have, SEAT), done),
        key=["rid"], rac_capacity=3,
    ).collect()
    want = {}
    for s in {a[1] for a in ask}:
        desk = replay.Desk([(h[2], h[3]) for h in have if h[0] == s], 3)
        mine = [a[0] for a in ask if a[1] == s]
        for p in mine:
            desk.book(p)
        for p in gone:
            if p in mine:
                desk.cancel(p)
        want.update({p: desk.status(p) for p in mine})
    assert {r.rid: (r.status, r.queue_no) for r in after} == want
    held = [(r.schedule_id, r.coach_id, r.seat_no) for r in after if r.status == "Confirmed"]
    assert None not in {h[2] for h in held} and len(held) == len(set(held))


@pytest.mark.parametrize("width", [1 << 16, 8])
@pytest.mark.parametrize("seed", [8, 9])
def test_interleaved_equals_replay(spark, seed, width):
    rng = random.Random(seed)
    events, booked = [], []
    for i in range(300):
        if booked and rng.random() < 0.4:
            events.append((rng.choice(booked)[0] if rng.random() < 0.5 else rng.randrange(3), i, "cancel", rng.choice(booked)[1], 5))
        else:
            s = 0 if rng.random() < 0.6 else rng.randrange(3)
            booked.append((s, i))
            events.append((s, i, "book", i, 5))
    df = spark.createDataFrame(events, "scope bigint, n bigint, action string, passenger_id bigint, n_seats int")
    got = replay_bookings(df, ["scope"], ["n"], id_slice("n", width), 4).collect()
    desks, first = {s: replay.Desk([f"S{k}" for k in range(5)], 4) for s in range(3)}, {}
    for s, _, action, p, _ in events:
        if action == "book":
            first[p] = desks[s].book(p)
        else:
            desks[s].cancel(p)
    scope_of = {p: s for s, p in booked}
    assert {r.passenger_id: (r.booked_status, r.booked_queue_no) for r in got} == first
    assert {r.passenger_id: (r.final_status, r.final_queue_no) for r in got} == {p: desks[scope_of[p]].status(p) for p in first}


def test_partition_count_does_not_matter(spark):
    ask, have = batch(11)
    results = []
    for n in ("3", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(allocate(spark.createDataFrame(ask, REQUEST), spark.createDataFrame(have, SEAT), ["rid"], id_slice("rid"))))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert results[0] == results[1]


def test_availability(spark):
    free = spark.createDataFrame([(1, 1, 9, "S1")], SEAT)
    queue = spark.createDataFrame([(2, 1, "RAC")] * 3 + [(3, 1, "RAC")] * 8 + [(3, 1, "WL")] * 2, "schedule_id bigint, class_no bigint, status string")
    asked = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "schedule_id bigint, class_no bigint")
    got = availability_status(asked, free, queue)
    assert rows(got.drop("class_no")) == [(1, "Available", 1, None), (2, "RAC", None, 4), (3, "Waitlist", None, 3), (4, "RAC", None, 1)]


def test_ticket_level_helpers(spark):
    people = spark.createDataFrame(
        [(1, 1, "cancelled"), (2, 1, "cancelled"), (3, 2, "WL"), (4, 2, "RAC")], "passenger_id bigint, ticket_id bigint, status string"
    )
    assert rows(al.emptied_tickets(people).select("ticket_id")) == [(1,)]
    assert rows(al.ticket_status(people)) == [(1, "cancelled", 2), (2, "RAC", 2)]
    assert rows(al.cancel_tickets(spark.createDataFrame([(2,)], "ticket_id bigint"), people)) == [(3,), (4,)]


def test_rac_fraction_rounds_down(spark):
    seats = spark.createDataFrame([(1, 1, 9, f"S{i}") for i in range(5)], SEAT)
    assert rows(al.rac_fraction(seats)) == [(1, 2)]


def test_time_slice_never_falls(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7, 0) as ts from range(500)")
    got = [r[0] for r in df.orderBy("ts").select(time_slice("ts")).collect()]
    assert got == sorted(got) and len(set(got)) > 50
    assert df.select(F.max(time_slice("ts", 60))).first()[0] is not None


def test_first_coach_only(spark):
    coaches = spark.createDataFrame([(7, 1, 1), (8, 1, 1), (9, 1, 2)], "coach_id bigint, train_id bigint, class_no bigint")
    seats = spark.createDataFrame([(1, 1, 7, "S1"), (1, 1, 8, "S1"), (1, 2, 9, "S1")], SEAT)
    assert rows(al.first_coach_only(seats, coaches).select("coach_id")) == [(7,), (9,)]


def test_seats_are_sold_per_date(spark):
    one, two = dt.date(2025, 1, 1), dt.date(2025, 1, 2)
    seats = spark.createDataFrame([(1, one, 1, 10, "S1"), (1, two, 1, 10, "S1")], "schedule_id bigint, journey_date date, class_no bigint, coach_id bigint, seat_no string")
    ask = spark.createDataFrame([(i, 1, one, 1) for i in (1, 2, 3)], "rid bigint, schedule_id bigint, journey_date date, class_no bigint")
    done = al.allocate(ask, seats, ["rid"], id_slice("rid"))
    assert rows(done.select("rid", "status", "seat_no", "queue_no")) == [(1, "Confirmed", "S1", None), (2, "RAC", None, 1), (3, "RAC", None, 2)]
    assert rows(al.available_seats(seats, done).select("journey_date")) == [(two,)]
    assert rows(al.seat_status(seats, done).select("journey_date", "is_booked")) == [(one, True), (two, False)]
    after = al.cancel(spark.createDataFrame([(1,)], "rid bigint"), done, key=["rid"])
    assert rows(after.select("rid", "status", "seat_no", "queue_no")) == [(1, "cancelled", None, None), (2, "Confirmed", "S1", None), (3, "RAC", None, 1)]
