"""Column expressions shared by the operators."""

from berth.functions.expr import (  # noqa: F401
    cancellation_rate,
    concession_percent,
    hms_to_seconds,
    money,
    parse_seat_code,
    pnr,
    queue_code,
    running_days,
    seat_code,
    seat_sort_key,
    utc_clock,
    utc_instant,
    weekday3,
)
