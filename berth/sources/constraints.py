"""Declared keys, references and required columns of the two application schemas.

Fixed values: they restate the tables' own rules; ``audit.audit_tables`` checks them.
"""

# table: one or more unique keys
UNIQUE_A = {
    "users": [("user_id",), ("username",), ("email",)],
    "payment_methods": [("payment_id",)],
    "wallets": [("wallet_id",), ("user_id",)],
    "trains": [("train_id",), ("train_number",)],
    "services": [("schedule_id",)],
    "stops": [("stop_id",), ("schedule_id", "stop_no")],
    "coaches": [("coach_id",), ("train_id", "coach_no")],
    "tickets": [("ticket_id",), ("pnr",)],
    "passengers": [("passenger_id",)],
    "transactions": [("transaction_id",)],
    "cancellations": [("cancellation_id",)],
    "seats": [("seat_id",), ("coach_id", "seat_no", "journey_date")],
}
UNIQUE_B = {
    "users": [("user_id",), ("username",), ("email",)],
    "stations": [("station_id",)],
    "trains": [("train_id",)],
    "services": [("schedule_id",)],
    "routes": [("route_row",)],
    "classes": [("class_no",)],
    "train_classes": [("train_id", "class_no")],
    "seats": [("seat_id",)],
    "seat_availability": [("schedule_id", "seat_id")],
    "passengers": [("passenger_id",)],
    "tickets": [("ticket_id",), ("pnr",)],
    "ticket_passengers": [("ticket_id", "passenger_id")],
    "queue": [("ticket_id",)],
    "route_fares": [("route_fare_id",)],
    "payments": [("payment_id",), ("ticket_id",)],
    "notifications": [("notification_id",)],
    "cancellations": [("cancellation_id",)],
}

# (child, column, parent, parent column)
FOREIGN_A = [
    ("payment_methods", "user_id", "users", "user_id"),
    ("wallets", "user_id", "users", "user_id"),
    ("services", "train_id", "trains", "train_id"),
    ("stops", "schedule_id", "services", "schedule_id"),
    ("coaches", "train_id", "trains", "train_id"),
    ("tickets", "user_id", "users", "user_id"),
    ("tickets", "train_id", "trains", "train_id"),
    ("tickets", "schedule_id", "services", "schedule_id"),
    ("tickets", "payment_id", "payment_methods", "payment_id"),
    ("passengers", "ticket_id", "tickets", "ticket_id"),
    ("transactions", "ticket_id", "tickets", "ticket_id"),
    ("transactions", "user_id", "users", "user_id"),
    ("cancellations", "ticket_id", "tickets", "ticket_id"),
    ("seats", "coach_id", "coaches", "coach_id"),
    ("seats", "schedule_id", "services", "schedule_id"),
]
# (child, column): stays with a null when its parent is deleted; all others of FOREIGN_A go along
SET_NULL_A = [("tickets", "payment_id")]
FOREIGN_B = [
    ("trains", "src_station", "stations", "station_id"),
    ("trains", "dst_station", "stations", "station_id"),
    ("services", "train_id", "trains", "train_id"),
    ("routes", "train_id", "trains", "train_id"),
    ("routes", "station_id", "stations", "station_id"),
    ("train_classes", "train_id", "trains", "train_id"),
    ("train_classes", "class_no", "classes", "class_no"),
    ("seats", "train_id", "trains", "train_id"),
    ("seats", "class_no", "classes", "class_no"),
    ("seat_availability", "schedule_id", "services", "schedule_id"),
    ("seat_availability", "seat_id", "seats", "seat_id"),
    ("passengers", "user_id", "users", "user_id"),
    ("tickets", "passenger_id", "passengers", "passenger_id"),
    ("tickets", "schedule_id", "services", "schedule_id"),
    ("tickets", "class_no", "classes", "class_no"),
    ("tickets", "seat_id", "seats", "seat_id"),
    ("ticket_passengers", "ticket_id", "tickets", "ticket_id"),
    ("ticket_passengers", "passenger_id", "passengers", "passenger_id"),
    ("queue", "ticket_id", "tickets", "ticket_id"),
    ("route_fares", "train_id", "trains", "train_id"),
    ("route_fares", "class_no", "classes", "class_no"),
    ("payments", "ticket_id", "tickets", "ticket_id"),
    ("notifications", "user_id", "users", "user_id"),
    ("notifications", "ticket_id", "tickets", "ticket_id"),
    ("cancellations", "ticket_id", "tickets", "ticket_id"),
]

REQUIRED_A = {
    "users": ["username", "dob", "email"],
    "payment_methods": ["user_id"],
    "wallets": ["user_id"],
    "trains": ["train_number", "train_name", "train_type"],
    "services": ["train_id", "running_days"],
    "stops": ["schedule_id", "station", "stop_no"],
    "coaches": ["train_id", "class_name", "coach_no", "total_seats", "available_seats", "base_fare"],
    "tickets": ["pnr", "user_id", "train_id", "schedule_id", "from_station", "to_station", "journey_date", "total_passengers", "total_fare", "method"],
    "passengers": ["ticket_id", "name", "age", "gender", "class_name"],
    "transactions": ["ticket_id", "user_id", "amount", "transaction_type", "method", "payment_status"],
    "cancellations": ["ticket_id", "refund_amount", "refund_to"],
    "seats": ["coach_id", "seat_no", "journey_date", "schedule_id"],
}
REQUIRED_B = {
    "users": ["username", "password", "email"],
    "stations": ["station"],
    "trains": ["train_name", "train_type"],
    "classes": ["class_name", "fare_per_km"],
    "seats": ["seat_no", "seat_type"],
    "passengers": ["name", "gender", "contact"],
    "tickets": ["status", "pnr", "booking_date", "source"],
    "queue": ["queue_no", "status"],
    "route_fares": ["train_id", "class_no", "src_station", "dst_station", "fixed_fare"],
    "payments": ["payment_mode", "amount", "payment_date"],
    "notifications": ["kind", "message"],
    "cancellations": ["ticket_id", "cancellation_date"],
}

# table: (column, name in DOMAINS)
ENUMS_B = {
    "users": [("role", "role")],
    "trains": [("train_type", "train_type")],
    "services": [("status", "service_status")],
    "classes": [("class_name", "class_name")],
    "seats": [("seat_type", "seat_type")],
    "passengers": [("gender", "gender"), ("concession", "concession")],
    "tickets": [("status", "ticket_status"), ("source", "booking_source")],
    "queue": [("status", "queue_status")],
    "payments": [("payment_mode", "payment_mode"), ("refund_status", "refund_status")],
    "notifications": [("kind", "notification_kind")],
}

# table: (column, greatest number of characters)
LENGTHS_A = {
    "users": [("username", 50), ("email", 100), ("phone_primary", 20), ("phone_secondary", 20), ("user_type", 20)],
    "payment_methods": [("card_number", 20), ("card_expiry", 7), ("card_holder", 100), ("upi_id", 50)],
    "trains": [("train_number", 20), ("train_name", 100), ("train_type", 20)],
    "services": [("status", 20)],
    "stops": [("station", 50)],
    "coaches": [("class_name", 10), ("coach_no", 10)],
    "tickets": [("pnr", 20), ("from_station", 50), ("to_station", 50), ("method", 20), ("status", 20)],
    "passengers": [("name", 50), ("gender", 1), ("class_name", 10), ("seat_code", 20), ("status", 20)],
    "transactions": [("transaction_type", 20), ("method", 20), ("payment_status", 20), ("remarks", 255)],
    "cancellations": [("refund_status", 20), ("refund_to", 20)],
    "seats": [("seat_no", 10)],
}
LENGTHS_B = {
    "users": [("username", 50), ("password", 255), ("email", 100), ("phone", 15)],
    "stations": [("station", 100), ("location", 100)],
    "trains": [("train_name", 100)],
    "services": [("remarks", 255)],
    "seats": [("seat_no", 10)],
    "passengers": [("name", 100), ("contact", 15), ("email", 100)],
    "tickets": [("pnr", 20)],
    "cancellations": [("reason", 255)],
}
