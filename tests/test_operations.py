"""Whole operations: commits, cancellations, refunds of refused debits, ledgers, fixtures, first rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from berth.operators import allocate as al
from berth.operators import audit, cancellation, lossless, wallet
from berth.operators.rank import accumulated, first_rows, id_slice, ranked
from berth.sources import commit, committed, read_fixture, read_ledger, write_ledger
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
EVENT = "user_id bigint, ts timestamp_ntz, event_id bigint, kind string, amount decimal(12,2), refund_of bigint"


def plain_wallet(events, balance):
    """Refunds of refused debits, or of none before, are void."""
    stood, out = set(), {}
    for _, _, key, kind, amount, ref in events:
        cents = int(amount * 100)
        ok = balance >= cents if kind == "debit" else ref is None or ref in stood
        if ok:
            balance += -cents if kind == "debit" else cents
            if kind == "debit":
                stood.add(key)
        out[key] = (ok, Decimal(balance) / 100)
    return out


@pytest.mark.parametrize("run_rows", [1 << 16, 25])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refunds_of_refused_debits_are_void(spark, seed, run_rows):
    r, events = random.Random(seed), []
    for i in range(300):
        user = 0 if r.random() < 0.5 else r.randrange(5)
        debits = [e[2] for e in events if e[0] == user and e[3] == "debit"]
        kind = r.choices(["topup", "debit", "refund"], [2, 5, 4])[0]
        ref = None
        if kind == "refund" and r.random() < 0.9:
            ref = r.choice([*debits, 10_000]) if debits else 10_000 + i
        events.append((None if user == 4 else user, T0 + dt.timedelta(minutes=17 * i), i, kind, Decimal(r.randrange(1, 4000)) / 100, ref))
    opening = spark.createDataFrame([(0, Decimal("70.00")), (1, Decimal("5.00"))], "user_id bigint, balance decimal(12,2)")
    got = wallet.wallet_ledger(spark.createDataFrame(events, EVENT), opening, refund_of="refund_of", run_rows=run_rows)
    want = {}
    for user, start in ((0, 7000), (1, 500), (2, 0), (3, 0), (None, 0)):
        want |= plain_wallet([e for e in events if e[0] == user], start)
    assert {x.event_id: (x.accepted, x.balance) for x in got.collect()} == want


def test_wallet_has_no_python_step(spark):
    events = spark.createDataFrame([(1, T0, 1, "debit", Decimal("2.00"), None), (1, T0, 2, "refund", Decimal("1.00"), 1)], EVENT)
    for ledger in (wallet.wallet_ledger(events), wallet.wallet_ledger(events, refund_of="refund_of")):
        assert "Python" not in ledger._jdf.queryExecution().toString() and "InArrow" not in ledger._jdf.queryExecution().toString()


def test_ranks_have_one_plan_for_all_keys(spark):
    data = [(None if i % 7 == 0 else 0 if i % 2 else i % 5, i, i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "k int, id int, v int")
    wide, narrow = (accumulated(df, ["k"], ["id"], {"no": None, "total": "v"}, id_slice("id", width)) for width in (1 << 16, 8))
    assert rows(wide) == rows(narrow)
    plain = {}
    for k, i, v in data:
        no, total = plain.get(k, (0, 0))
        plain[k] = no + 1, total + v
    assert {r.k: (r.no, r.total) for r in narrow.orderBy("id").collect()} == plain
    facts = spark.createDataFrame([(0, 9), (None, 8)], "k int, f int")
    assert {(r.k, r.f) for r in ranked(df, ["k"], ["id"], "no", id_slice("id", 8), facts).collect()} == {(k, {0: 9, None: 8}.get(k)) for k in plain}


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = first_rows(df, ["k"], [F.desc("id")], 2)
    assert rows(got) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    assert "Partial" in got._jdf.queryExecution().executedPlan().toString() and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def booked(spark):
    ask = spark.createDataFrame([(i, 100 + i // 3, 1, dt.date(2024, 5, 1), 0) for i in range(24)], "passenger_id bigint, ticket_id bigint, schedule_id bigint, journey_date date, class_no bigint")
    seats = spark.createDataFrame([(1, dt.date(2024, 5, 1), 0, 1, f"S{i}") for i in range(8)], "schedule_id bigint, journey_date date, class_no bigint, coach_id bigint, seat_no string")
    people = al.allocate(ask, seats, ["passenger_id"], id_slice("passenger_id"), rac_capacity=4)
    tickets = spark.createDataFrame([(100 + i, i % 2, Decimal("10.00"), "card", "confirmed") for i in range(8)], "ticket_id bigint, user_id bigint, total_fare decimal(12,2), method string, status string")
    return people, tickets


def asked(spark, ids):
    return spark.createDataFrame([(i, T0, "wallet" if i % 2 else "card") for i in ids], "passenger_id bigint, ts timestamp_ntz, refund_to string")


def test_cancellation_as_one_operation(spark):
    people, tickets = booked(spark)
    out = cancellation.cancellation(asked(spark, [0, 1, 2, 2, 9, 99]), people, tickets, rac_capacity=4)
    after = {r.passenger_id: (r.status, r.seat_no, r.queue_no) for r in out["passengers"].collect()}
    assert [p for p, s in after.items() if s[0] == "cancelled"] == [p for p in after if p in (0, 1, 2, 9)]
    assert after[8][:2] == ("Confirmed", "S0") and after[11] == ("Confirmed", "S2", None) and after[12] == ("RAC", None, 1) and after[16] == ("WL", None, 1)
    assert rows(out["tickets"].where("status = 'cancelled'").select("ticket_id")) == [(100,)]
    assert rows(out["refunds"].select("passenger_id", "amount")) == [(0, Decimal("3.00")), (1, Decimal("3.00")), (2, Decimal("3.00")), (9, Decimal("3.00"))]
    assert rows(out["wallet_events"].select("user_id", "event_id", "kind")) == [(0, 1, "refund"), (1, 9, "refund")]
    assert rows(out["transactions"].select("remarks").distinct()) == [("Refunded to card",), ("Refunded to wallet",)]
    assert out["cancellations"].count() == 4


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    out, one = str(tmp_path / "out"), spark.createDataFrame([(1,)], "x int")
    broken = one.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    commit({"a": one, "b": one}, out, "b1")
    with pytest.raises(Exception, match="lost"):
        commit({"a": one.withColumn("x", F.lit(5)), "b": broken}, out, "b2")
    assert rows(committed(spark, out, "a")) == [(1, "b1")]
    commit({"a": one.withColumn("x", F.lit(7)), "b": one}, out, "b1")
    commit({"a": one.withColumn("x", F.lit(5)), "b": one}, out, "b2")
    assert rows(committed(spark, out, "a")) == [(5, "b2"), (7, "b1")] and rows(committed(spark, out, "b")) == [(1, "b1"), (1, "b2")]
    with pytest.raises(ValueError):
        committed(spark, out, "c")


def test_ledger_months_are_pruned_by_a_frame(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, dt.date(2025, 1 + i % 6, 5)) for i in range(60)], "id int, journey_date date")
    write_ledger(df, path)
    months = spark.createDataFrame([("2025-02", "x"), ("2025-03", "y")], "journey_month string, tag string").where("tag = 'x'")
    got = read_ledger(spark, path, months=months)
    assert got.count() == 10 and "dynamicpruning" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_fixture_of_several_files(spark, tmp_path):
    lines = [f"{i},Train {i},Fast" for i in range(900)]
    for n, (a, b) in enumerate([(0, 10), (10, 400), (400, 401), (401, 900)]):
        (tmp_path / f"{n}.csv").write_text("\n".join(lines[a:b]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = read_fixture(spark, "Trains", str(tmp_path))
        assert sorted((r.train_id, r.train_number) for r in got.collect()) == [(i + 1, str(i)) for i in range(900)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cascade_follows_chains_and_cycles(spark):
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id long"),
        "payment_methods": spark.createDataFrame([(5, 1), (6, 2)], "payment_id long, user_id long"),
        "tickets": spark.createDataFrame([(10, 1, 5), (11, 2, 5), (12, 2, 6)], "ticket_id long, user_id long, payment_id long"),
        "passengers": spark.createDataFrame([(100, 10), (101, 11)], "passenger_id long, ticket_id long"),
    }
    left = audit.cascade(tables, {"users": spark.createDataFrame([(1,), (9,)], "user_id long")})
    assert rows(left["users"]) == [(2,)] and rows(left["payment_methods"].select("payment_id")) == [(6,)] and rows(left["passengers"].select("passenger_id")) == [(101,)]
    assert rows(left["tickets"].select("ticket_id", "payment_id")) == [(11, None), (12, 6)]
    people = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id long, boss long")
    ring = audit.cascade({"people": people}, {"people": people.where("id = 2")}, [("people", "boss", "people", "id")], [], {"people": [("id",)]})
    assert rows(ring["people"].select("id")) == [(4,), (5,)]


def test_joined_size_is_that_of_the_join(spark):
    r = random.Random(4)
    df = spark.createDataFrame([tuple(r.randrange(4) for _ in range(4)) for _ in range(60)], "a int, b int, c int, d int")
    for parts in ((("a", "b"), ("b", "c"), ("c", "d")), (("a", "b"), ("a", "c"), ("a", "d")), (("a", "b", "c"), ("b", "d"))):
        joined = df.select(*parts[0]).distinct()
        for part in parts[1:]:
            joined = joined.join(df.select(*part).distinct(), [c for c in part if c in joined.columns])
        got = lossless.joined_size(df, parts).first()
        assert (got.n_rows, got.n_joined) == (df.distinct().count(), joined.count())
    for parts in ((("a", "b"), ("b", "c"), ("c", "a", "d"), ("d", "b")), (("a", "b"), ("c", "d"))):
        with pytest.raises(ValueError):
            lossless.joined_size(df, parts)


def test_chase_decides_by_dependencies():
    flight, parts = ["ticket", "service", "train", "season"], [["ticket", "service"], ["service", "train"], ["service", "season"]]
    rules = [(["ticket"], ["service"]), (["service"], ["train", "season"])]
    assert lossless.closure(["ticket"], rules) == set(flight)
    assert lossless.lossless_by_chase(flight, parts, rules) and not lossless.lossless_by_chase(flight, parts, rules[:1])
    ring = [["a", "b"], ["b", "c"], ["c", "a"]]
    assert lossless.join_tree(ring) is None and lossless.lossless_by_chase(["a", "b", "c"], ring, [(["a"], ["b"]), (["b"], ["c"])]) and not lossless.lossless_by_chase(["a", "b", "c"], ring, [])
