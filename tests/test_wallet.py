import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from berth.operators import wallet
from tests import replay
from tests.conftest import rows

EVENT = "user_id bigint, ts timestamp_ntz, event_id bigint, kind string, amount decimal(12,2)"
T0 = dt.datetime(2024, 1, 1)


def history(seed, users=4, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = 0 if rng.random() < 0.5 else rng.randrange(users)
        kind = rng.choices(["topup", "debit", "refund"], [2, 5, 1] if seed % 2 else [5, 3, 1])[0]
        out.append((user, T0 + dt.timedelta(minutes=13 * i), i, kind, Decimal(rng.randrange(1, 5000)) / 100))
    return out


@pytest.mark.parametrize("run_rows", [1 << 16, 30])
@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_ledger_equals_replay(spark, seed, run_rows):
    events = history(seed)
    opening = {0: 12000, 1: 0, 2: 500000}
    frame = spark.createDataFrame([(u, Decimal(c) / 100) for u, c in opening.items()], "user_id bigint, balance decimal(12,2)")
    got = wallet.wallet_ledger(spark.createDataFrame(events, EVENT), frame, run_rows=run_rows).collect()
    want = {}
    for user in {e[0] for e in events}:
        mine = [e for e in events if e[0] == user]
        result = replay.wallet([(e[3], int(e[4] * 100)) for e in mine], opening.get(user, 0))
        want.update({e[2]: (ok, Decimal(cents) / 100) for e, (ok, cents) in zip(mine, result)})
    assert {r.event_id: (r.accepted, r.balance) for r in got} == want
    assert all(r.balance >= 0 for r in got)


def test_smoke_script_balance(spark):
    """Top-up 4000, two bookings and a refund, each posted once."""
    steps = [("topup", "4000.00"), ("debit", "34.65"), ("debit", "69.30"), ("refund", "31.19")]
    events = [(1, T0 + dt.timedelta(hours=i), i, k, Decimal(a)) for i, (k, a) in enumerate(steps)]
    ledger = wallet.wallet_ledger(spark.createDataFrame(events, EVENT))
    assert rows(wallet.wallet_balances(ledger)) == [(1, Decimal("3927.24"))]


def test_idle_users_keep_their_opening_balance(spark):
    opening = spark.createDataFrame([(1, Decimal("5.00")), (2, Decimal("7.50"))], "user_id bigint, balance decimal(12,2)")
    events = spark.createDataFrame([(1, T0, 1, "debit", Decimal("9.00"))], EVENT)
    ledger = wallet.wallet_ledger(events, opening)
    assert rows(ledger.select("accepted", "balance")) == [(False, Decimal("5.00"))]
    assert rows(wallet.wallet_balances(ledger, opening)) == [(1, Decimal("5.00")), (2, Decimal("7.50"))]


def test_event_union(spark):
    part = spark.createDataFrame([(1, T0, 1, Decimal("1.00"))], "user_id bigint, ts timestamp_ntz, event_id bigint, amount decimal(12,2)")
    assert rows(wallet.wallet_events(topups=part, debits=part).select("kind")) == [("debit",), ("topup",)]


def test_transactions(spark):
    columns = "ticket_id bigint, user_id bigint, amount decimal(10,2), ts timestamp_ntz, method string"
    booked = spark.createDataFrame([(1, 1, Decimal("10.00"), T0, "card")], columns)
    log = wallet.transactions(booked, booked.withColumn("refund_to", F.lit("wallet")))
    assert rows(log.select("transaction_type", "payment_status", "remarks")) == [
        ("booking", "confirmed", None), ("cancellation", "refunded", "Refunded to wallet"),
    ]
