"""Declared schemas; nothing is inferred when reading."""

# Header-less CSV files, in file order.
CSV_COLUMNS = {
    "Trains": "train_number string, train_name string, train_type string",
    "TrainSchedule": "train_id bigint, running_days string, status string",
    "TrainStops": "schedule_id bigint, station string, stop_no int, arrival string, departure string, distance int",
    "Coaches": "train_id bigint, class_name string, coach_no string, total_seats int, available_seats int, base_fare decimal(10,2)",
}

# Identity column numbered by row position, where the file holds none.
CSV_IDS = {"Trains": "train_id", "TrainSchedule": "schedule_id", "TrainStops": "stop_id", "Coaches": "coach_id"}

# Denormalised schema: one row per ticket with its passengers apart.
SCHEMA_A = {
    "users": "user_id bigint, username string, dob date, email string, phone_primary string, phone_secondary string, user_type string",
    "payment_methods": "payment_id bigint, user_id bigint, card_number string, card_expiry string, card_holder string, upi_id string, is_active boolean, created_on timestamp_ntz",
    "wallets": "wallet_id bigint, user_id bigint, balance decimal(10,2), last_updated timestamp_ntz",
    "trains": "train_id bigint, train_number string, train_name string, train_type string, created_on timestamp_ntz",
    "services": "schedule_id bigint, train_id bigint, running_days string, status string, last_updated timestamp_ntz",
    "stops": "stop_id bigint, schedule_id bigint, station string, stop_no int, arrival string, departure string, distance int",
    "coaches": "coach_id bigint, train_id bigint, class_name string, coach_no string, total_seats int, available_seats int, base_fare decimal(10,2)",
    "tickets": "ticket_id bigint, pnr string, user_id bigint, train_id bigint, schedule_id bigint, from_station string, to_station string, booking_ts timestamp_ntz, journey_date date, total_passengers int, total_fare decimal(10,2), method string, payment_id bigint, status string",
    "passengers": "passenger_id bigint, ticket_id bigint, name string, age int, gender string, class_name string, seat_code string, status string",
    "transactions": "transaction_id bigint, ticket_id bigint, user_id bigint, amount decimal(10,2), transaction_type string, ts timestamp_ntz, method string, payment_status string, remarks string",
    "cancellations": "cancellation_id bigint, ticket_id bigint, ts timestamp_ntz, refund_amount decimal(10,2), refund_status string, refund_to string",
    "seats": "seat_id bigint, coach_id bigint, seat_no string, is_available boolean, journey_date date, schedule_id bigint",
}

# Normalised schema: one ticket per passenger, dated services, routes by train.
SCHEMA_B = {
    "users": "user_id bigint, username string, password string, email string, phone string, is_verified boolean, created_at timestamp_ntz, last_login timestamp_ntz, role string",
    "stations": "station_id bigint, station string, location string",
    "trains": "train_id bigint, train_name string, train_type string, src_station bigint, dst_station bigint",
    "services": "schedule_id bigint, train_id bigint, service_date date, status string, remarks string",
    "routes": "route_row bigint, train_id bigint, station_id bigint, arrival string, departure string, stop_no int, distance decimal(10,2)",
    "classes": "class_no bigint, class_name string, fare_per_km decimal(6,2)",
    "train_classes": "train_id bigint, class_no bigint",
    "seats": "seat_id bigint, train_id bigint, class_no bigint, seat_no string, seat_type string",
    "seat_availability": "schedule_id bigint, seat_id bigint, is_booked boolean",
    "passengers": "passenger_id bigint, name string, age int, gender string, contact string, email string, concession string, user_id bigint",
    "tickets": "ticket_id bigint, passenger_id bigint, schedule_id bigint, class_no bigint, status string, seat_id bigint, pnr string, booking_date date, distance decimal(10,2), source string",
    "ticket_passengers": "ticket_id bigint, passenger_id bigint",
    "queue": "ticket_id bigint, queue_no bigint, status string",
    "route_fares": "route_fare_id bigint, train_id bigint, class_no bigint, src_station bigint, dst_station bigint, fixed_fare decimal(10,2)",
    "payments": "payment_id bigint, ticket_id bigint, payment_mode string, amount decimal(10,2), payment_date date, refund_status string",
    "notifications": "notification_id bigint, user_id bigint, ticket_id bigint, kind string, message string, sent_at timestamp_ntz, is_read boolean",
    "cancellations": "cancellation_id bigint, ticket_id bigint, cancellation_date timestamp_ntz, reason string, charge decimal(10,2)",
}

# Value domains (fixed values), checked by ``berth.operators.audit``.
DOMAINS = {
    "role": ("Customer", "Agent", "Admin"),
    "train_type": ("Express", "Superfast", "Mail", "Local"),
    "service_status": ("Running", "Cancelled"),
    "class_name": ("Sleeper", "AC 3-Tier", "AC 2-Tier", "First Class"),
    "seat_type": ("Window", "Middle", "Aisle", "Lower Berth", "Middle Berth", "Upper Berth", "Side Lower", "Side Upper"),
    "gender": ("Male", "Female", "Other"),
    "concession": ("Senior Citizen", "Student", "Disabled", "None"),
    "ticket_status": ("Confirmed", "RAC", "WL"),
    "booking_source": ("Mobile App", "Website", "Counter", "Agent"),
    "queue_status": ("RAC", "WL"),
    "payment_mode": ("Online", "Counter"),
    "refund_status": ("Yes", "No"),
    "notification_kind": ("Booking", "Cancellation", "Delay", "Platform Change", "General"),
}
