"""Integrity rules as audits: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.operators.rank import ranked
from berth.sources import constraints as c
from berth.session import durable
from berth.sources.schemas import DOMAINS


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows. Null keys pass."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str], parent_keys: Sequence[str] | None = None) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    keys = list(keys)
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    known = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_keys or keys, keys)])
    return child.where(present).join(known, keys, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows that stay when the given parents are deleted with their children."""
    return child.join(deleted.select(*keys), list(keys), "left_anti")


def cascade(
    tables: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame], foreign: Sequence[tuple[str, str, str, str]] = c.FOREIGN_A,
    set_null: Sequence[tuple[str, str]] = c.SET_NULL_A, unique: Mapping[str, Sequence[Sequence[str]]] = c.UNIQUE_A,
) -> dict[str, DataFrame]:
    """What is left of all ``tables`` when the ``deleted`` rows go, with all that depends on them.

    ``deleted``: per table a frame with its first unique key. A reference of ``foreign``
    takes the child along, unless it is one of ``set_null``: then the child stays with a
    null. Rounds follow the references from what the last round deleted until nothing is
    found, so chains, diamonds and cycles all end; each round is written. Tables that
    nothing refers to stay the frames they were.
    """
    def key_of(name: str) -> list[str]:
        return list(unique[name][0])

    gone = {name: durable(tables[name].join(rows.select(*key_of(name)).distinct(), key_of(name), "left_semi")) for name, rows in deleted.items()}
    last = dict(gone)
    while last:
        found: dict[str, list[DataFrame]] = {}
        for child, column, parent, parent_column in foreign:
            if child in tables and parent in last and (child, column) not in set_null:
                keys = last[parent].select(F.col(parent_column).alias(column)).distinct()
                found.setdefault(child, []).append(tables[child].join(keys, column, "left_semi").select(*tables[child].columns))
        last = {}
        for child, hits in found.items():
            new = reduce(DataFrame.unionByName, hits).dropDuplicates(key_of(child))
            new = durable(new.join(gone[child].select(*key_of(child)), key_of(child), "left_anti") if child in gone else new)
            if not new.isEmpty():
                last[child] = new
                gone[child] = gone[child].unionByName(new) if child in gone else new
    out = {name: df.join(gone[name].select(*key_of(name)), key_of(name), "left_anti") if name in gone else df for name, df in tables.items()}
    for child, column, parent, parent_column in foreign:
        if child in out and parent in gone and (child, column) in set_null:
            out[child] = null_out(out[child], gone[parent].select(F.col(parent_column).alias(column)), column)
    return out


def null_out(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows with the key set to null where its parent is deleted."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return (
        child.join(gone, key, "left")
        .withColumn(key, F.when(F.col("_gone").isNull(), F.col(key)))
        .select(*child.columns)
    )


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of nulls per required column, columns without nulls left out."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "n_nulls").where(F.col("n_nulls") > 0)


def domain_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking a rule, one row per broken rule in ``rule``.

    A rule is a condition; as with a check constraint, null passes.
    """
    broken = F.array_compact(F.array(*[F.when(~cond, F.lit(name)) for name, cond in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def max_length(column: str, length: int) -> Column:
    return F.char_length(column) <= length


def audit_tables(tables: Mapping[str, DataFrame], schema: str) -> DataFrame:
    """Number of violations of every declared rule of schema ``a`` or ``b``.

    One row per rule (table_name, rule, n_violations) over the given tables; rules
    that need an absent table are left out. Each rule is an aggregate or an anti
    join, so only counts leave the tables.
    """
    a = schema == "a"
    unique, foreign, required, lengths, enums = (
        (c.UNIQUE_A, c.FOREIGN_A, c.REQUIRED_A, c.LENGTHS_A, {}) if a
        else (c.UNIQUE_B, c.FOREIGN_B, c.REQUIRED_B, c.LENGTHS_B, c.ENUMS_B)
    )
    parts = []

    def counted(name: str, rule: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("n_violations")).select(
            F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n_violations"
        )

    for name, df in tables.items():
        for keys in unique.get(name, ()):
            parts.append(counted(name, f"unique {', '.join(keys)}", unique_violations(df, keys)))
        # conditions on single rows share one pass over the table
        checks = {f"required {col}": F.col(col).isNotNull() for col in required.get(name, ())}
        checks |= {f"length {col} <= {n}": max_length(col, n) for col, n in lengths.get(name, ())}
        checks |= {f"values {col}": one_of(col, DOMAINS[domain]) for col, domain in enums.get(name, ())}
        if name == "users" and a:
            checks["one phone"] = F.col("phone_primary").isNotNull() | F.col("phone_secondary").isNotNull()
        if name == "passengers" and not a:
            checks["age over 0"] = F.col("age") > 0
        if checks:
            once = df.agg(*[F.count_if(~ok).alias(rule) for rule, ok in checks.items()])
            parts.append(
                once.unpivot([], [F.col(f"`{rule}`") for rule in checks], "rule", "n_violations")
                .select(F.lit(name).alias("table_name"), "rule", "n_violations")
            )
    for child, column, parent, parent_column in foreign:
        if child in tables and parent in tables:
            lost = orphans(tables[child], tables[parent], [column], [parent_column])
            parts.append(counted(child, f"{column} in {parent}", lost))
    return reduce(DataFrame.unionByName, parts)


def double_bookings(
    tickets: DataFrame, order: Sequence[Column | str], slice_by: Column | None,
    key: Sequence[str] = ("schedule_id", "journey_date", "coach_id", "seat_no"),
) -> DataFrame:
    """Confirmed tickets for a seat that an earlier confirmed ticket already holds; queued tickets hold none."""
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key], F.col("status") == "Confirmed")
    return ranked(tickets.where(held), key, order, "claim_no", slice_by).where(F.col("claim_no") > 1)


def fd_violations(df: DataFrame, lhs: Sequence[str], rhs: Sequence[str]) -> DataFrame:
    """Left-hand values with more than one right-hand value, per dependent column.

    Smallest against largest value, so it folds before the shuffle; a null beside
    a value also counts as two values.
    """
    differs = {
        c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))) for c in rhs
    }
    grouped = df.groupBy(*lhs).agg(*[F.coalesce(cond, F.lit(False)).alias(f"_{c}") for c, cond in differs.items()])
    broken = F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in rhs]))
    return grouped.select(*lhs, F.explode(broken).alias("dependent"))


def join_loss(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Common-key values for which splitting ``df`` into two projections and
    joining them back would invent rows.

    The joined size of a key is the product of its two distinct counts, so the
    join itself is never formed. Needs ``left`` and ``right`` to cover ``df``.
    """
    common = [c for c in left if c in right]
    if not common or set(left) | set(right) != set(df.columns):
        raise ValueError("the parts must overlap and cover all columns")

    def per_key(columns: Sequence[str], name: str) -> DataFrame:
        return df.select(*columns).distinct().groupBy(*common).agg(F.count(F.lit(1)).alias(name))

    return (
        per_key(df.columns, "n_rows")
        .join(per_key(left, "_l"), common)
        .join(per_key(right, "_r"), common)
        .withColumn("n_joined", F.col("_l") * F.col("_r"))
        .where(F.col("n_joined") > F.col("n_rows"))
        .drop("_l", "_r")
    )
