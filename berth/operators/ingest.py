"""Registration of users and payment methods in bulk."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.session import durable

USER_COLUMNS = ("user_id", "username", "dob", "email", "phone_primary", "phone_secondary", "user_type")
PAYMENT_COLUMNS = ("user_id", "card_number", "card_expiry", "card_holder", "upi_id")

MISSING_FIELD = "missing username, dob or email"
NO_PHONE = "At least one phone number must be provided."  # fixed value
TAKEN_NAME = "username taken"
TAKEN_EMAIL = "email taken"


class Registered(NamedTuple):
    users: DataFrame
    payment_methods: DataFrame
    wallets: DataFrame
    rejects: DataFrame


def _clock(as_of: dt.datetime) -> Column:
    """The moment as text, so that no zone of this machine shifts it."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def phone_given(primary: str = "phone_primary", secondary: str = "phone_secondary") -> Column:
    return F.col(primary).isNotNull() | F.col(secondary).isNotNull()


def _reason() -> Column:
    missing = F.col("username").isNull() | F.col("dob").isNull() | F.col("email").isNull()
    return F.when(missing, F.lit(MISSING_FIELD)).when(~phone_given(), F.lit(NO_PHONE))


def ingest_users(raw: DataFrame, as_of: dt.datetime) -> Registered:
    """Split registrations into users, payment methods, wallets and rejects.

    ``raw``: the user and payment columns with a unique ``user_id``, which is the
    order of arrival. The first user of a name and the first of an email win; a
    name or email of a refused registration is not taken.
    """
    checked = raw.withColumn("reason", _reason())
    valid = checked.where(F.col("reason").isNull())
    winners = _winners(valid.select("user_id", "username", "email"))
    accepted = valid.join(winners.select("user_id"), "user_id", "left_semi")
    owner = winners.select("username", F.col("user_id").alias("_owner"))
    late = valid.join(winners.select("user_id"), "user_id", "left_anti").join(owner, "username", "left")
    late = late.withColumn("reason", F.when(F.col("_owner") < F.col("user_id"), F.lit(TAKEN_NAME)).otherwise(F.lit(TAKEN_EMAIL)))
    now = _clock(as_of)
    users = accepted.withColumn("user_type", F.coalesce("user_type", F.lit("normal"))).select(*USER_COLUMNS)
    payments = payment_rows(accepted.where(F.col("card_number").isNotNull() | F.col("upi_id").isNotNull()), as_of)
    wallets = accepted.select("user_id", F.lit(0).cast("decimal(10,2)").alias("balance"), now.alias("last_updated"))
    columns = ("user_id", "username", "email", "reason")
    rejects = checked.where(F.col("reason").isNotNull()).select(*columns).unionByName(
        late.select(*columns)
    )
    return Registered(users, payments, wallets, rejects)


def _winners(valid: DataFrame) -> DataFrame:
    """Registrations that stand: user_id, username, email.

    Whoever is first both for the name and for the email among those still undecided
    stands, and all others with that name or email fall, in rounds until none is left.
    A round settles at least the first one, mostly nearly all; it is written, so a lost
    executor costs no earlier round.
    """
    undecided, found = durable(valid), None
    while not undecided.isEmpty():
        by_name = undecided.groupBy("username").agg(F.min("user_id").alias("user_id"))
        by_email = undecided.groupBy("email").agg(F.min("user_id").alias("user_id"))
        first = durable(undecided.join(by_name.select("user_id"), "user_id", "left_semi").join(by_email.select("user_id"), "user_id", "left_semi"))
        found = first if found is None else found.unionByName(first)
        undecided = durable(undecided.join(first.select("username"), "username", "left_anti").join(first.select("email"), "email", "left_anti"))
    return undecided if found is None else found


def payment_rows(raw: DataFrame, as_of: dt.datetime) -> DataFrame:
    return raw.select(*PAYMENT_COLUMNS, F.lit(True).alias("is_active"), _clock(as_of).alias("created_on"))


def ingest_payment_methods(raw: DataFrame, users: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Payment methods of known users, and those of unknown users."""
    known = users.select("user_id")
    return (
        payment_rows(raw.join(known, "user_id", "left_semi"), as_of),
        raw.join(known, "user_id", "left_anti"),
    )
