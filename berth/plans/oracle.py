"""The binding of ``berth.plans.bind`` as SQL fragments for the comparison engine.

Fragments are prefixed ``b_`` so that no name hides a table.
"""

CTES = {
    "b_stations": "SELECT CAST(n_nationkey AS BIGINT) AS station_id, n_name AS station FROM nation",
    "b_trains": """
        SELECT s_suppkey AS train_id, s_name AS train_name,
               ['Express', 'Superfast', 'Mail', 'Local'][1 + s_suppkey % 4] AS train_type,
               CAST(s_nationkey AS BIGINT) AS src_station, CAST((s_nationkey + 18) % 25 AS BIGINT) AS dst_station
        FROM supplier""",
    "b_stops": """
        SELECT train_id AS route_id, (src_station + 3 * (k - 1)) % 25 AS station_id, k AS stop_no,
               CASE WHEN k > 1 THEN (21600 + 7800 * (k - 1)) % 86400 END AS arr_s,
               CASE WHEN k < 7 THEN (21600 + 7800 * (k - 1) + 600) % 86400 END AS dep_s,
               150 * (k - 1) AS distance
        FROM b_trains, range(1, 8) AS r(k)""",
    "b_services": """
        SELECT train_id * 10000 + season AS schedule_id, train_id, season,
               ['Mon,Wed,Fri', 'Tue,Thu,Sat', 'Mon,Tue,Wed,Thu,Fri,Sat,Sun'][1 + train_id % 3] AS running_days,
               CASE WHEN (train_id + season) % 10 = 0 THEN 'Cancelled' ELSE 'Running' END AS status
        FROM b_trains, range(1995, 2002) AS r(season)""",
    "b_classes": """
        SELECT CAST(c AS BIGINT) AS class_no, ['1A', '2A', '3A', 'SL', 'GN'][c + 1] AS class_name,
               CAST(['3.50', '2.50', '1.75', '1.00', '0.60'][c + 1] AS DECIMAL(10,2)) AS base_fare
        FROM range(0, 5) AS r(c)""",
    "b_coaches": """
        SELECT train_id * 10 + class_no AS coach_id, train_id, class_no, class_name, 'C' || class_no AS coach_no,
               10 AS total_seats, (train_id + class_no) % 11 AS available_seats, base_fare
        FROM b_trains, b_classes""",
    "b_seats": """
        SELECT schedule_id, class_no, coach_id, 'S' || n AS seat_no, train_id,
               ['Window', 'Middle', 'Aisle', 'Lower Berth', 'Middle Berth', 'Upper Berth', 'Side Lower', 'Side Upper']
               [1 + (train_id + n) % 8] AS seat_type
        FROM b_coaches JOIN b_services USING (train_id), range(1, 11) AS r(n)""",
    "b_route_fares": """
        SELECT train_id, class_no, src_station, dst_station, CAST(base_fare * 9 AS DECIMAL(10,2)) AS fixed_fare
        FROM b_coaches JOIN b_trains USING (train_id)""",
    "b_requests": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS ticket_id,
               l_orderkey AS booking_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_id, l_suppkey AS train_id,
               CAST(l_shipdate AS DATE) AS journey_date, year(l_shipdate) AS season,
               l_suppkey * 10000 + year(l_shipdate) AS schedule_id, CAST(l_quantity AS BIGINT) % 5 AS class_no,
               1 + l_linenumber % 3 AS from_stop, 2 + l_linenumber % 3 + l_partkey % 3 AS to_stop,
               'P' || l_linenumber AS name,
               ['None', 'Senior Citizen', 'Student', 'Disabled'][1 + l_linenumber % 4] AS concession,
               l_returnflag = 'R' AS is_cancelled, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
               CAST(l_shipdate AS DATE) - CAST(l_partkey % 20 AS INTEGER) AS cancelled_on
        FROM lineitem""",
    "b_routed": """
        SELECT r.*, t.src_station, t.dst_station, (t.src_station + 3 * (from_stop - 1)) % 25 AS from_station,
               (t.src_station + 3 * (to_stop - 1)) % 25 AS to_station
        FROM b_requests r JOIN b_trains t USING (train_id)""",
    "b_orders": """
        SELECT o_orderkey AS booking_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(12,2)) AS total_fare,
               CAST(o_orderdate AS DATE) AS booking_date, o_orderdate AS ts,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'wallet'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'upi' ELSE 'card' END AS method,
               CASE WHEN o_orderstatus = 'P' THEN 'Yes' ELSE 'No' END AS refund_status,
               CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'confirmed' ELSE 'RAC' END AS status,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Online' ELSE 'Counter' END AS payment_mode
        FROM orders""",
    "b_last_ticket": """
        SELECT booking_id, ticket_id FROM b_requests
        QUALIFY row_number() OVER (PARTITION BY booking_id
            ORDER BY line_no DESC, part_id DESC, train_id DESC, journey_date DESC) = 1""",
    "b_payments": """
        SELECT ticket_id, booking_id, total_fare AS amount, booking_date AS payment_date, payment_mode, refund_status
        FROM b_orders JOIN b_last_ticket USING (booking_id)""",
    "b_seat_rank": """
        SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY coach_id, seat_no) AS r,
               count(*) OVER (PARTITION BY schedule_id, class_no) AS n_free
        FROM b_seats""",
    "b_request_rank": """
        SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no
                  ORDER BY booking_id, line_no, part_id, train_id, journey_date) AS r
        FROM b_requests""",
    "b_alloc": """
        SELECT q.* EXCLUDE (r),
               CASE WHEN q.r <= 10 THEN 'Confirmed' WHEN q.r <= 18 THEN 'RAC' ELSE 'WL' END AS status,
               s.coach_id, s.seat_no,
               CASE WHEN q.r <= 10 THEN NULL WHEN q.r <= 18 THEN q.r - 10 ELSE q.r - 18 END AS queue_no
        FROM b_request_rank q LEFT JOIN b_seat_rank s
             ON q.schedule_id = s.schedule_id AND q.class_no = s.class_no AND q.r = s.r""",
    "b_tickets": """
        SELECT a.*, upper(substring(md5(CAST(booking_id AS VARCHAR)), 1, 10)) || '1009843200' AS pnr, booking_date, user_id
        FROM b_alloc a JOIN b_orders USING (booking_id)""",
    "b_cancellations": """
        SELECT ticket_id, cancelled_on AS cancellation_date, 'passenger request' AS reason,
               datediff('day', cancelled_on, journey_date) AS days_before,
               CAST(amount * CASE WHEN datediff('day', cancelled_on, journey_date) > 15 THEN 0.10
                                  WHEN datediff('day', cancelled_on, journey_date) > 7 THEN 0.25
                                  WHEN datediff('day', cancelled_on, journey_date) > 1 THEN 0.50
                                  ELSE 0.75 END AS DECIMAL(12,2)) AS charge, amount
        FROM b_requests WHERE is_cancelled""",
    "b_pool": """
        SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY coach_id, seat_no) AS r,
               count(*) OVER (PARTITION BY schedule_id, class_no) AS n_free
        FROM (SELECT schedule_id, class_no, coach_id, seat_no FROM b_alloc WHERE is_cancelled AND status = 'Confirmed'
              UNION ALL
              SELECT schedule_id, class_no, coach_id, seat_no FROM b_seats s
              WHERE NOT EXISTS (SELECT 1 FROM b_alloc a WHERE a.status = 'Confirmed' AND a.schedule_id = s.schedule_id
                                AND a.coach_id = s.coach_id AND a.seat_no = s.seat_no)) AS f""",
    "b_queue_rank": """
        SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY status = 'WL', queue_no) AS r
        FROM b_alloc WHERE NOT is_cancelled AND status <> 'Confirmed'""",
    "b_moved": """
        SELECT q.ticket_id, q.schedule_id, q.class_no, q.r - coalesce(n.n_free, 0) AS q, p.coach_id, p.seat_no
        FROM b_queue_rank q
        LEFT JOIN (SELECT DISTINCT schedule_id, class_no, n_free FROM b_pool) n
             ON q.schedule_id = n.schedule_id AND q.class_no = n.class_no
        LEFT JOIN b_pool p ON q.schedule_id = p.schedule_id AND q.class_no = p.class_no AND q.r = p.r""",
    "b_wallet": """
        SELECT user_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'topup' WHEN 'purchase' THEN 'debit' ELSE 'refund' END AS kind,
               CASE WHEN event_type = 'click' THEN CAST(CAST(value AS DECIMAL(12,2)) * 0.1 AS DECIMAL(12,2))
                    ELSE CAST(value AS DECIMAL(12,2)) END AS amount
        FROM events WHERE event_type IN ('signup', 'purchase', 'click')""",
    "b_wallet_order": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM b_wallet",
    "b_wallet_fold": """
        SELECT user_id, event_id, n, kind <> 'debit' OR amount <= 0 AS accepted,
               CAST(CASE WHEN kind <> 'debit' THEN amount ELSE 0 END AS DECIMAL(18,2)) AS balance
        FROM b_wallet_order WHERE n = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.n, o.kind <> 'debit' OR f.balance >= o.amount,
               CAST(CASE WHEN o.kind <> 'debit' THEN f.balance + o.amount
                         WHEN f.balance >= o.amount THEN f.balance - o.amount ELSE f.balance END AS DECIMAL(18,2))
        FROM b_wallet_fold f JOIN b_wallet_order o ON o.user_id = f.user_id AND o.n = f.n + 1""",
    "b_group_first": """
        SELECT booking_id, train_id, schedule_id, class_no, journey_date FROM b_requests
        QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY line_no, part_id, train_id, journey_date) = 1""",
    "b_group_all": """
        SELECT g.*, i AS passenger_no, 'P' || i AS name, 18 + (booking_id + i) % 60 AS age,
               ['Male', 'Female', 'Other'][1 + (booking_id + i) % 3] AS gender,
               CAST(booking_id * 10 + i AS VARCHAR) AS contact, 'p' || i || '@example.org' AS email,
               ['None', 'Senior Citizen', 'Student', 'Disabled'][1 + (booking_id + i) % 4] AS concession
        FROM b_group_first g JOIN b_orders USING (booking_id), range(1, 8) AS r(i) WHERE i <= 1 + booking_id % 7""",
    "b_group_tickets": """
        SELECT q.* EXCLUDE (r), CASE WHEN q.r <= 10 THEN 'Confirmed' WHEN q.r <= 18 THEN 'RAC' ELSE 'WL' END AS status, s.seat_no,
               CASE WHEN q.r <= 10 THEN NULL WHEN q.r <= 18 THEN q.r - 10 ELSE q.r - 18 END AS queue_no,
               CAST(fixed_fare * CASE concession WHEN 'Senior Citizen' THEN 0.60 WHEN 'Student' THEN 0.75
                                 WHEN 'Disabled' THEN 0.50 ELSE 1.00 END AS DECIMAL(10,2)) AS fare
        FROM (SELECT *, row_number() OVER (PARTITION BY schedule_id, class_no ORDER BY booking_id, passenger_no) AS r
              FROM b_group_all WHERE passenger_no <= 4) q
        JOIN b_route_fares f ON q.train_id = f.train_id AND q.class_no = f.class_no
        LEFT JOIN b_seat_rank s ON q.schedule_id = s.schedule_id AND q.class_no = s.class_no AND q.r = s.r""",
    "b_registrations": """
        SELECT o_orderkey AS user_id, CASE WHEN o_orderkey % 97 <> 0 THEN 'user' || o_custkey END AS username,
               CAST(o_orderdate AS DATE) AS dob, 'mail' || (o_custkey % 500) || '@example.org' AS email,
               CASE WHEN o_orderkey % 5 <> 0 THEN '100' END AS phone_primary,
               CASE WHEN o_orderkey % 7 <> 0 THEN '200' END AS phone_secondary,
               CASE WHEN o_orderkey % 3 = 0 THEN 'agent' ELSE 'normal' END AS user_type,
               CASE WHEN o_orderkey % 2 = 0 THEN '4111' END AS card_number,
               CASE WHEN o_orderkey % 2 = 0 THEN '12/26' END AS card_expiry,
               CASE WHEN o_orderkey % 2 = 0 THEN 'holder' END AS card_holder,
               CASE WHEN o_orderkey % 3 = 0 THEN 'id@upi' END AS upi_id
        FROM orders""",
    "b_reg_valid": """
        SELECT * FROM b_registrations
        WHERE username IS NOT NULL AND (phone_primary IS NOT NULL OR phone_secondary IS NOT NULL)""",
    "b_reg_rounds": """
        SELECT user_id, username, email, user_id = min(user_id) OVER (PARTITION BY username)
               AND user_id = min(user_id) OVER (PARTITION BY email) AS stands FROM b_reg_valid
        UNION ALL
        SELECT user_id, username, email, user_id = min(user_id) OVER (PARTITION BY username)
               AND user_id = min(user_id) OVER (PARTITION BY email) FROM b_reg_rounds
        WHERE NOT stands AND username NOT IN (SELECT username FROM b_reg_rounds WHERE stands)
              AND email NOT IN (SELECT email FROM b_reg_rounds WHERE stands)""",
    "b_reg_users": "SELECT * FROM b_reg_valid WHERE user_id IN (SELECT user_id FROM b_reg_rounds WHERE stands)",
    "b_reg_late": """
        SELECT v.*, CASE WHEN EXISTS (SELECT 1 FROM b_reg_users u WHERE u.username = v.username AND u.user_id < v.user_id)
                         THEN 'username taken' ELSE 'email taken' END AS reason
        FROM b_reg_valid v WHERE user_id NOT IN (SELECT user_id FROM b_reg_users)""",
    "b_booking_events": """
        SELECT r.*, o.user_id, o.method, c.base_fare,
               CAST(round(c.base_fare * 150 * (to_stop - from_stop) * 0.01, 2) AS DECIMAL(12,2)) AS fare
        FROM b_requests r JOIN b_orders o USING (booking_id) JOIN b_classes c USING (class_no)""",
    "b_paid_order": """
        SELECT ticket_id, user_id, fare, row_number() OVER (PARTITION BY user_id
               ORDER BY booking_id, line_no, part_id, train_id, journey_date) AS n
        FROM b_booking_events WHERE method = 'wallet'""",
    "b_paid_fold": """
        SELECT o.ticket_id, o.user_id, o.n, b.balance >= o.fare AS accepted,
               CAST(CASE WHEN b.balance >= o.fare THEN b.balance - o.fare ELSE b.balance END AS DECIMAL(18,2)) AS balance
        FROM b_paid_order o
        JOIN (SELECT c_custkey AS user_id, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2)) AS balance FROM customer) b
             ON o.user_id = b.user_id
        WHERE o.n = 1
        UNION ALL
        SELECT o.ticket_id, o.user_id, o.n, f.balance >= o.fare,
               CAST(CASE WHEN f.balance >= o.fare THEN f.balance - o.fare ELSE f.balance END AS DECIMAL(18,2))
        FROM b_paid_fold f JOIN b_paid_order o ON o.user_id = f.user_id AND o.n = f.n + 1""",
    "b_booked_rank": """
        SELECT e.*, row_number() OVER (PARTITION BY schedule_id, class_no
               ORDER BY booking_id, line_no, part_id, train_id, journey_date) AS r
        FROM b_booking_events e
        WHERE method <> 'wallet' OR ticket_id IN (SELECT ticket_id FROM b_paid_fold WHERE accepted)""",
}
