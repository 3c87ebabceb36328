"""Queries of whole operations, requests with an asked frame, and ordered answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.functions import money
from berth.operators import allocate as al
from berth.operators import audit, booking, cancellation, lossless, reports, search, wallet
from berth.operators.rank import first_rows
from berth.plans.bind import PASSENGER_ORDER, Bound
from berth.plans.oracle import CTES
from berth.plans.queries import _HISTORY, _HISTORY_SCHEMA, _OFFERS, _REFUND, SERVICE, SERVICE_SEAT, _alloc, _groups, _history, _manifest, _tickets, query
from berth.session import durable, scratch
from berth.sources import committed, read_fixture, read_ledger, write_ledger

# --- wallets ----------------------------------------------------------------

CTES |= {
    "b_paid_refunds": """
        SELECT o.user_id, o.ts, o.booking_id * 2 AS event_id, 'debit' AS kind, o.total_fare AS amount, CAST(NULL AS BIGINT) AS refund_of FROM b_orders o WHERE method = 'wallet'
        UNION ALL
        SELECT o.user_id, o.ts + to_days(CAST(booking_id % 30 AS INTEGER)), o.booking_id * 2 + 1, 'refund', CAST(o.total_fare * 0.9 AS DECIMAL(12,2)), o.booking_id * 2
        FROM b_orders o WHERE method = 'wallet' AND status = 'cancelled'""",
    "b_paid_refunds_order": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM b_paid_refunds",
    "b_paid_refunds_fold": """
        SELECT c_custkey AS user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, true AS accepted,
               CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 100 AS DECIMAL(18,2)) AS balance, CAST([] AS BIGINT[]) AS gone FROM customer
        UNION ALL
        SELECT o.user_id, o.n, o.event_id,
               CASE WHEN kind = 'debit' THEN f.balance >= o.amount ELSE NOT list_contains(f.gone, o.refund_of) END,
               CAST(CASE WHEN kind = 'debit' AND f.balance >= o.amount THEN f.balance - o.amount
                         WHEN kind <> 'debit' AND NOT list_contains(f.gone, o.refund_of) THEN f.balance + o.amount ELSE f.balance END AS DECIMAL(18,2)),
               CASE WHEN kind = 'debit' AND f.balance < o.amount THEN list_append(f.gone, o.event_id) ELSE f.gone END
        FROM b_paid_refunds_fold f JOIN b_paid_refunds_order o ON o.user_id = f.user_id AND o.n = f.n + 1""",
}


@query(
    "wallet_refunds", "user_id bigint, event_id bigint, kind string, amount decimal(12,2), accepted boolean, balance decimal(18,2)",
    "SELECT f.user_id, f.event_id, r.kind, r.amount, f.accepted, f.balance FROM b_paid_refunds_fold f JOIN b_paid_refunds_order r USING (user_id, n)",
)
def wallet_refunds(b: Bound) -> DataFrame:
    """Orders paid from wallets, and refunds of the cancelled ones: void where the order was refused."""
    paid = b.orders.where(F.col("method") == "wallet")
    columns = "user_id", "ts", "event_id", "kind", "amount", "refund_of"
    debits = paid.select(
        "*", (F.col("booking_id") * 2).alias("event_id"), F.lit(wallet.DEBIT).alias("kind"), F.col("total_fare").alias("amount"),
        F.lit(None).cast("long").alias("refund_of"),
    ).select(*columns)
    later = F.col("ts") + F.make_dt_interval((F.col("booking_id") % 30).cast("int"))
    refunds = paid.where(F.col("status") == "cancelled").select(
        "user_id", later.alias("ts"), (F.col("booking_id") * 2 + 1).alias("event_id"), F.lit(wallet.REFUND).alias("kind"),
        money(F.col("total_fare") * F.lit("0.9").cast("decimal(2,1)")).alias("amount"), (F.col("booking_id") * 2).alias("refund_of"),
    ).select(*columns)
    opening = b.opening.withColumn("balance", money(F.col("balance") * 100, 18))
    return wallet.wallet_ledger(debits.unionByName(refunds), opening, refund_of="refund_of")


# --- cancellation -----------------------------------------------------------

_SHARES = f"SELECT q.*, o.user_id, CASE WHEN o.method = 'wallet' THEN 'wallet' ELSE 'original_payment' END AS refund_to FROM ({_REFUND.format(where='')}) q JOIN b_orders o ON o.booking_id = q.ticket_id"


@query(
    "cancel_pipeline", "output string, id string, status string, seat_no string, queue_no bigint, amount decimal(12,2), detail string",
    f"""WITH s AS ({_SHARES})
        SELECT 'passenger' AS output, ticket_id AS id, CASE WHEN is_cancelled THEN 'cancelled' ELSE status END AS status,
               CASE WHEN NOT is_cancelled THEN seat_no END AS seat_no, NULL AS queue_no, NULL AS amount, NULL AS detail
        FROM b_alloc WHERE is_cancelled OR status = 'Confirmed'
        UNION ALL SELECT 'passenger', ticket_id, CASE WHEN q <= 0 THEN 'Confirmed' WHEN q <= 8 THEN 'RAC' ELSE 'WL' END, seat_no,
               CASE WHEN q <= 0 THEN NULL WHEN q <= 8 THEN q ELSE q - 8 END, NULL, NULL FROM b_moved
        UNION ALL SELECT 'ticket', CAST(booking_id AS VARCHAR), CASE WHEN gone THEN 'cancelled' ELSE status END, NULL, NULL, NULL, NULL
        FROM b_orders LEFT JOIN (SELECT booking_id, bool_and(is_cancelled) AS gone FROM b_requests GROUP BY 1) USING (booking_id)
        UNION ALL SELECT 'refund', passenger_id, NULL, NULL, NULL, refund, refund_to FROM s
        UNION ALL SELECT 'wallet', passenger_id, 'refund', NULL, NULL, refund, CAST(user_id AS VARCHAR) FROM s WHERE refund_to = 'wallet'
        UNION ALL SELECT 'transaction', passenger_id, 'refunded', NULL, NULL, refund, 'Refunded to ' || refund_to FROM s
        UNION ALL SELECT 'cancellation', passenger_id, 'processed', NULL, NULL, refund, refund_to FROM s""",
)
def cancel_pipeline(b: Bound) -> DataFrame:
    """All outputs of one batch of cancellations, read back from its commit."""
    done = durable(
        al.allocate(b.narrow_requests.drop("amount"), b.seats, PASSENGER_ORDER, b.slice_by, scope=SERVICE)
        .select(b.ticket_id().alias("passenger_id"), "booking_id", *SERVICE, "is_cancelled", "status", "coach_id", "seat_no", "queue_no"),
        cancellation.CODEC,
    )
    people = done.select("passenger_id", F.col("booking_id").alias("ticket_id"), *SERVICE, "status", "coach_id", "seat_no", "queue_no")
    to = F.when(F.col("method") == "wallet", F.lit("wallet")).otherwise(F.lit("original_payment"))
    asked = done.where("is_cancelled").join(b.orders.select("booking_id", "ts", to.alias("refund_to")), "booking_id")
    asked = asked.select("passenger_id", F.col("booking_id").alias("ticket_id"), "ts", "refund_to")
    tickets = b.orders.select(F.col("booking_id").alias("ticket_id"), "user_id", "total_fare", "method", "status")
    free = durable(al.available_seats(b.seats, done, SERVICE_SEAT))
    out = scratch(b.spark, "cancellation")
    cancellation.cancel_batch(out, "first", asked, people, tickets, free, scope=SERVICE)

    def told(output: str, name: str, **columns: str) -> DataFrame:
        rows, given = committed(b.spark, out, name), {"status": "string", "seat_no": "string", "queue_no": "bigint", "amount": "decimal(12,2)", "detail": "string"}
        key = "ticket_id" if output == "ticket" else "event_id" if output == "wallet" else "passenger_id"
        picked = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()]
        return rows.select(F.lit(output).alias("output"), F.col(key).cast("string").alias("id"), *picked)

    parts = [
        told("passenger", "passengers", status="status", seat_no="seat_no", queue_no="queue_no"), told("ticket", "tickets", status="status"),
        told("refund", "refunds", amount="amount", detail="refund_to"), told("wallet", "wallet_events", status="kind", amount="amount", detail="user_id"),
        told("transaction", "transactions", status="payment_status", amount="amount", detail="remarks"),
        told("cancellation", "cancellations", status="refund_status", amount="refund_amount", detail="refund_to"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query(
    "allocate_gaps", "ticket_id string, schedule_id bigint, class_no bigint, status string, coach_id bigint, seat_no string, queue_no bigint",
    """WITH early AS (SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY booking_id, line_no, part_id, train_id, journey_date) AS r
                      FROM b_requests WHERE line_no <= 3),
            old AS (SELECT schedule_id, class_no, count(*) AS n, count(*) FILTER (r BETWEEN 11 AND 18 AND NOT is_cancelled) AS rac,
                           coalesce(max(r - 10) FILTER (r BETWEEN 11 AND 18 AND NOT is_cancelled), 0) AS last_rac,
                           coalesce(max(r - 18) FILTER (r > 18 AND NOT is_cancelled), 0) AS last_wl FROM early GROUP BY ALL),
            new AS (SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY booking_id, line_no, part_id, train_id, journey_date) AS k
                    FROM b_requests WHERE line_no > 3),
            pos AS (SELECT new.*, coalesce(n, 0) + k AS r, greatest(8 - coalesce(rac, 0), 0) AS space, coalesce(last_rac, 0) AS last_rac,
                           coalesce(last_wl, 0) AS last_wl, k - greatest(10 - coalesce(n, 0), 0) AS q FROM new LEFT JOIN old USING (schedule_id, class_no))
       SELECT pos.ticket_id, pos.schedule_id, pos.class_no, CASE WHEN q <= 0 THEN 'Confirmed' WHEN q <= space THEN 'RAC' ELSE 'WL' END AS status,
              s.coach_id, s.seat_no, CASE WHEN q <= 0 THEN NULL WHEN q <= space THEN last_rac + q ELSE last_wl + q - space END AS queue_no
       FROM pos LEFT JOIN b_seat_rank s ON s.schedule_id = pos.schedule_id AND s.class_no = pos.class_no AND s.r = pos.r AND pos.q <= 0""",
)
def allocate_gaps(b: Bound) -> DataFrame:
    """A batch behind a queue that some have left: free places are filled, numbers go on from the largest."""
    early = F.col("line_no") <= 3
    done = durable(al.allocate(b.narrow_requests.where(early), b.seats, PASSENGER_ORDER, b.slice_by, scope=SERVICE))
    queue = done.where((F.col("status") != al.CONFIRMED) & ~F.col("is_cancelled"))
    free = al.available_seats(b.seats, done, SERVICE_SEAT)
    return b.label(al.allocate(b.narrow_requests.where(~early), free, PASSENGER_ORDER, b.slice_by, existing=queue, scope=SERVICE))


@query(
    "group_payments", "booking_id bigint, amount decimal(12,2), n_tickets bigint, last_passenger bigint, payment_mode string, payment_date date, refund_status string",
    """SELECT booking_id, sum(fare) AS amount, count(*) AS n_tickets, max(passenger_no) AS last_passenger, any_value(payment_mode) AS payment_mode,
              any_value(booking_date) AS payment_date, 'No' AS refund_status
       FROM b_group_tickets g JOIN (SELECT booking_id, payment_mode, booking_date FROM b_orders) o USING (booking_id) GROUP BY booking_id""",
)
def group_payments(b: Bound) -> DataFrame:
    return booking.group_payments(_groups(b)[0], b.orders).withColumn("last_passenger", F.col("last_ticket.passenger_no"))


# --- asked frames -----------------------------------------------------------


@query(
    "booking_history_asked", _HISTORY_SCHEMA,
    f"SELECT * FROM ({_HISTORY}) WHERE journey_date BETWEEN DATE '2000-01-01' AND DATE '2099-12-31' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def booking_history_asked(b: Bound) -> DataFrame:
    """Bookings of the asked users, in the default range of dates."""
    users = b.t["customer"].where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    return _history(b, users=users)


_PNR = "ticket_id string, pnr string, status string, coach_id bigint, seat_no string, class_name string, train_name string, journey_date date"


@query(
    "pnr_status_asked", _PNR,
    """SELECT a.*, class_name, train_name FROM b_tickets a JOIN b_classes USING (class_no) JOIN b_trains t ON t.train_id = a.train_id
       WHERE booking_id IN (SELECT booking_id FROM b_orders WHERE status = 'cancelled')""",
)
def pnr_status_asked(b: Bound) -> DataFrame:
    asked = b.orders.where(F.col("status") == "cancelled").select(b.reference().alias("pnr"))
    return reports.pnr_status(_tickets(b).drop("train_id"), b.services, b.trains, b.classes, asked)


@query(
    "manifest_asked", "train_id bigint, journey_date date, passenger_id string, name string, concession string, pnr string, status string, seat_no string",
    """SELECT DISTINCT train_id, journey_date, ticket_id AS passenger_id, name, concession, pnr, status, seat_no FROM b_tickets
       WHERE (train_id, journey_date) IN (SELECT (train_id, journey_date) FROM b_requests WHERE is_cancelled)""",
)
def manifest_asked(b: Bound) -> DataFrame:
    """Passengers of the trains and days on which somebody cancelled."""
    asked = b.narrow_requests.where("is_cancelled").select("train_id", "journey_date")
    return _manifest(b, asked)


@query(
    "waitlist_asked",
    "train_id bigint, schedule_id bigint, class_no bigint, passenger_id string, name string, pnr string, journey_date date, queue_no bigint, status string",
    "SELECT t.*, ticket_id AS passenger_id FROM b_tickets t JOIN b_trains USING (train_id) WHERE t.status = 'WL' AND train_type = 'Express'",
)
def waitlist_asked(b: Bound) -> DataFrame:
    return reports.waitlist(_tickets(b).drop("train_id"), b.services, b.trains.where(F.col("train_type") == "Express"))


@query(
    "available_seats_asked", "schedule_id bigint, class_no bigint, coach_id bigint, seat_no string, seat_type string",
    """SELECT s.schedule_id, s.class_no, s.coach_id, s.seat_no, s.seat_type FROM b_seats s
       LEFT JOIN b_alloc a ON a.schedule_id = s.schedule_id AND a.coach_id = s.coach_id AND a.seat_no = s.seat_no
       WHERE a.ticket_id IS NULL AND (s.schedule_id, s.class_no) IN (SELECT (schedule_id, class_no) FROM b_requests WHERE is_cancelled)""",
)
def available_seats_asked(b: Bound) -> DataFrame:
    asked = b.narrow_requests.where("is_cancelled").select("schedule_id", "class_no")
    done = al.allocate(b.narrow_requests, b.seats, PASSENGER_ORDER, b.slice_by, scope=SERVICE)
    return al.available_seats(b.seats, done, SERVICE_SEAT, asked)


@query(
    "train_availability_full", "from_station bigint, to_station bigint, journey_date date, train_id bigint, schedule_id bigint, dep_s bigint, arr_s bigint, running_days string",
    """SELECT k.from_station, k.to_station, k.journey_date, t.train_id, s.schedule_id, o.dep_s, d.arr_s, s.running_days
       FROM b_routed k JOIN b_stops o ON o.station_id = k.from_station
       JOIN b_stops d ON d.station_id = k.to_station AND d.route_id = o.route_id AND o.stop_no < d.stop_no
       JOIN b_services s ON s.train_id = o.route_id AND s.season = k.season JOIN b_trains t ON t.train_id = s.train_id""",
)
def train_availability_full(b: Bound) -> DataFrame:
    return search.train_availability_full(b.searches, b.trains, b.services, b.stops)


# --- ordered answers --------------------------------------------------------

_FIRST = 5


@query(
    "search_trips_first",
    "from_station bigint, to_station bigint, season bigint, weekday string, position bigint, schedule_id bigint, class_name string, dep_s bigint, fare decimal(10,2)",
    f"""SELECT from_station, to_station, season, weekday, schedule_id, class_name, dep_s, fare,
               row_number() OVER (PARTITION BY from_station, to_station, season, weekday ORDER BY dep_s, schedule_id, class_name) AS position
        FROM ({_OFFERS}) QUALIFY position <= {_FIRST}""",
)
def search_trips_first(b: Bound) -> DataFrame:
    """The first departures of every distinct search."""
    found = search.search_trips_by_key(b.searches, b.trains, b.services, b.stops, b.coaches, active="Running")
    return first_rows(found, ["from_station", "to_station", "season", "weekday"], ["dep_s", "schedule_id", "class_name"], _FIRST)


@query(
    "booking_history_latest", "user_id bigint, position bigint, ticket_id bigint, journey_date date, total_fare decimal(12,2)",
    f"""SELECT user_id, o.booking_id AS ticket_id, journey_date, total_fare,
               row_number() OVER (PARTITION BY user_id ORDER BY journey_date DESC, booking_date DESC, o.booking_id) AS position
        FROM b_orders o JOIN b_group_first g USING (booking_id) QUALIFY position <= {_FIRST}""",
)
def booking_history_latest(b: Bound) -> DataFrame:
    """The latest bookings of every user, by journey and booking date, newest first."""
    first = b.narrow_requests.groupBy("booking_id").agg(F.min_by("journey_date", F.struct(*PASSENGER_ORDER)).alias("journey_date"))
    tickets = b.orders.join(first, "booking_id").withColumnRenamed("booking_id", "ticket_id")
    return first_rows(tickets, ["user_id"], [F.desc("journey_date"), F.desc("booking_date"), "ticket_id"], _FIRST)


# --- sources ----------------------------------------------------------------


@query(
    "read_fixture", "train_id bigint, train_number string, train_name string, train_type string",
    "SELECT row_number() OVER (ORDER BY train_id) AS train_id, CAST(train_id AS VARCHAR) AS train_number, train_name, train_type FROM b_trains",
)
def read_fixture_parts(b: Bound) -> DataFrame:
    """Trains written as several files without header, read back with ids by position."""
    path = scratch(b.spark, "trains")
    rows = b.trains.repartitionByRange(5, "train_id").sortWithinPartitions("train_id")
    rows.select(F.col("train_id").cast("string"), "train_name", "train_type").write.csv(path)
    return read_fixture(b.spark, "Trains", path)


@query(
    "ledger_cancelled_months", "journey_month string, n_tickets bigint",
    """SELECT strftime(journey_date, '%Y-%m') AS journey_month, count(*) AS n_tickets FROM b_requests
       WHERE strftime(journey_date, '%Y-%m') IN (SELECT strftime(journey_date, '%Y-%m') FROM b_requests WHERE is_cancelled AND part_id = 1) GROUP BY 1""",
)
def ledger_cancelled_months(b: Bound) -> DataFrame:
    """Two batches, one of them written twice, read for the months in which the first part was cancelled."""
    path = scratch(b.spark, "tickets")
    tickets = b.requests.select("ticket_id", "journey_date", "line_no")
    for batch, some in (("first", F.col("line_no") <= 3), ("second", F.col("line_no") > 3), ("first", F.col("line_no") <= 3)):
        write_ledger(tickets.where(some), path, batch=batch)
    months = b.narrow_requests.where(F.col("is_cancelled") & (F.col("part_id") == 1)).select(F.date_format("journey_date", "yyyy-MM").alias("journey_month"))
    return read_ledger(b.spark, path, months=months).groupBy("journey_month").agg(F.count(F.lit(1)).alias("n_tickets"))


# --- rules over several tables ----------------------------------------------


@query(
    "cascade_users", "table_name string, id string, payment_id bigint",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
            left_over AS (SELECT booking_id, user_id % 100 AS payment_id FROM b_orders WHERE user_id NOT IN (FROM gone))
       SELECT 'users' AS table_name, CAST(c_custkey AS VARCHAR) AS id, NULL AS payment_id FROM customer WHERE c_custkey NOT IN (FROM gone)
       UNION ALL SELECT 'wallets', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey NOT IN (FROM gone)
       UNION ALL SELECT 'payment_methods', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey NOT IN (FROM gone)
       UNION ALL SELECT 'tickets', CAST(booking_id AS VARCHAR), CASE WHEN payment_id NOT IN (FROM gone) THEN payment_id END FROM left_over
       UNION ALL SELECT 'passengers', ticket_id, NULL FROM b_requests WHERE booking_id IN (SELECT booking_id FROM left_over)
       UNION ALL SELECT 'transactions', CAST(booking_id AS VARCHAR), NULL FROM left_over""",
)
def cascade_users(b: Bound) -> DataFrame:
    """Users of a segment go, and with them wallets, payment methods, tickets, passengers and transactions."""
    users = b.opening.select("user_id")
    orders = b.orders.select(F.col("booking_id").alias("ticket_id"), "user_id", (F.col("user_id") % 100).alias("payment_id"))
    tables = {
        "users": users, "wallets": users.withColumn("wallet_id", F.col("user_id")), "payment_methods": users.withColumn("payment_id", F.col("user_id")),
        "tickets": orders, "passengers": b.requests.select(F.col("ticket_id").alias("passenger_id"), F.col("booking_id").alias("ticket_id")),
        "transactions": orders.select(F.col("ticket_id").alias("transaction_id"), "ticket_id", "user_id"),
    }
    asked = b.t["customer"].where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("user_id"))
    left = audit.cascade(tables, {"users": asked})
    keys = {"users": "user_id", "wallets": "wallet_id", "payment_methods": "payment_id", "tickets": "ticket_id", "passengers": "passenger_id", "transactions": "transaction_id"}
    found = None
    for name, key in keys.items():
        payment = F.col("payment_id") if name == "tickets" else F.lit(None)
        part = left[name].select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"), payment.cast("long").alias("payment_id"))
        found = part if found is None else found.unionByName(part)
    return found


_SPLITS = {
    "sound 3": (("ticket_id", "schedule_id"), ("schedule_id", "train_id"), ("schedule_id", "season")),
    "sound 4": (("ticket_id", "schedule_id"), ("schedule_id", "train_id"), ("schedule_id", "season"), ("ticket_id", "class_no")),
    "invented 3": (("schedule_id", "train_id"), ("schedule_id", "class_no"), ("schedule_id", "line_no")),
    "invented 4": (("train_id", "season"), ("train_id", "class_no"), ("season", "line_no"), ("train_id", "from_stop")),
}


def _split_sql(name: str, parts: tuple[tuple[str, ...], ...]) -> str:
    columns, seen, joined = sorted({c for p in parts for c in p}), list(parts[0]), f"(SELECT DISTINCT {', '.join(parts[0])} FROM b_requests) p0"
    for i, part in enumerate(parts[1:], 1):
        joined += f" JOIN (SELECT DISTINCT {', '.join(part)} FROM b_requests) p{i} USING ({', '.join(c for c in part if c in seen)})"
        seen += [c for c in part if c not in seen]
    return f"SELECT '{name}' AS split, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM b_requests)) AS n_rows, (SELECT count(*) FROM {joined}) AS n_joined"


@query("join_loss_parts", "split string, n_rows bigint, n_joined bigint", " UNION ALL ".join(_split_sql(n, p) for n, p in _SPLITS.items()))
def join_loss_parts(b: Bound) -> DataFrame:
    """Splits into three and four parts, two of them sound and two that invent rows."""
    rows, found = b.requests.withColumn("season", F.year("journey_date")), None
    for name, parts in _SPLITS.items():
        size = lossless.joined_size(rows.select(*sorted({c for p in parts for c in p})), parts).withColumn("split", F.lit(name))
        found = size if found is None else found.unionByName(size)
    return found
