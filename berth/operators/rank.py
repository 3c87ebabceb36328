"""Ranks and running sums per key that hold when one key owns much of the data.

A plain window sorts a whole key in one task. Here every key is cut into slices along its
order: a slice is ranked or summed apart, and the totals of the earlier slices of its key,
one small row each, are joined back. The plan is the same for all sizes and keys, and
nothing is counted or collected while it is built. Totals are combined before they are
shuffled, so they cost little beside the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NULL_SLICE = -(2**62)  # nulls sort first, as in an ascending window
_PART = "_part"


def id_slice(column: str, width: int = 1 << 16) -> Column:
    """Slice for orders that start with a dense id."""
    return F.floor(F.col(column) / width).cast("long")


def time_slice(column: str, seconds: int = 3600) -> Column:
    """Slice for orders that start with a timestamp without zone.

    Built from the clock fields, since a cast through a zone can step back where
    clocks change.
    """
    c = F.col(column)
    clock = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.floor(clock / seconds).cast("long")


def accumulated(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: dict[str, str | None], slice_by: Column,
    facts: DataFrame | None = None, capacity: DataFrame | None = None, lists: DataFrame | None = None,
) -> DataFrame:
    """Running totals per ``keys`` along ``order``, up to and including each row.

    ``values`` names the results: the column to add up, or None for the row number.
    ``order`` must be total and ``slice_by`` a long that never falls along it. ``facts``
    (one row per key) travel with the totals of the slices, and so does ``capacity``, a frame
    on some of the keys, where a null finds nothing. Null keys are one key. Keys that are
    not part of the order are shuffled once, within the part.

    ``lists`` hands the k-th item of a key to its k-th row, for a single row number: the key
    columns (a null finds nothing), the items before a list (``_from``) and the list
    (``_items``). A slice takes along the items of its own rows, so the rows are not shuffled
    again to meet them; the result is the column ``_item``, null beyond the last.
    """
    key = F.struct(*keys)
    rows = df.withColumn(_PART, F.struct(key.alias("key"), F.coalesce(slice_by, F.lit(_NULL_SLICE)).alias("no")))
    used = [*order, *[c for c in values.values() if c is not None]]
    twice = [] if any(not isinstance(c, str) or c in keys for c in used) else [c for c in keys if c in df.columns]
    rows = rows.drop(*twice)
    total = {n: F.count(F.lit(1)) if c is None else F.sum(c) for n, c in values.items()}
    parts = rows.groupBy(_PART).agg(*[t.alias(f"_t_{n}") for n, t in total.items()])
    before = Window.partitionBy(f"{_PART}.key").orderBy(f"{_PART}.no").rowsBetween(Window.unboundedPreceding, -1)
    totals = [f"_t_{n}" for n in values] if lists is not None else []
    parts = parts.select(_PART, *totals, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    if facts is not None:
        more = [c for c in facts.columns if c not in keys]
        parts = parts.join(facts.select(key.alias("_key"), *more), F.col(f"{_PART}.key") == F.col("_key"), "left").drop("_key")
    if capacity is not None:
        parts = _with_capacity(parts, capacity, {c: F.col(f"{_PART}.key")[c] for c in keys})
    if lists is not None:
        (number,) = values
        parts = _with_items(parts, lists, keys, F.col(f"_b_{number}"), F.col(f"_t_{number}")).drop(*totals)
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = {f"_w_{n}": (F.row_number() if c is None else F.sum(c)).over(within) for n, c in values.items()}
    joined = rows.select("*", *[step.alias(n) for n, step in steps.items()]).join(parts, _PART)
    out = joined.withColumns({n: (F.col(f"_w_{n}") + F.col(f"_b_{n}")).cast("long") for n in values})
    out = out.withColumns({c: F.col(f"{_PART}.key")[c] for c in twice})
    if lists is not None:
        out = out.withColumn("_item", F.get("_items", F.col(f"_w_{number}") - 1)).drop("_items")
    more = [c for c in out.columns if c not in df.columns and c not in values and c != _PART and c[:3] not in ("_w_", "_b_")]
    return out.select(*[c for c in df.columns if c not in values], *values, *more)


def _with_capacity(df: DataFrame, capacity: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``df`` with the further columns of ``capacity``, matched on the ``keys`` it has."""
    on = {c: f"_c_{c}" for c in capacity.columns if c in keys}
    same = [keys[c] == F.col(name) for c, name in on.items()]
    return df.join(capacity.withColumnsRenamed(on), same, "left").drop(*on.values())


def _with_items(parts: DataFrame, lists: DataFrame, keys: Sequence[str], before: Column, count: Column) -> DataFrame:
    """``parts`` with the items of the ranks in them, in order (``_items``): those after ``before``, ``count`` at most."""
    known = lists.where(~F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False)))
    first, last = F.greatest("_from", before), F.least(F.col("_from") + F.size("_items"), before + count)
    meet = (F.col(f"{_PART}.key") == F.col("_key")) & (F.col("_from") < before + count) & (F.col("_from") + F.size("_items") > before)
    cut = F.struct("_from", F.slice("_items", (first - F.col("_from") + 1).cast("int"), (last - first).cast("int")).alias("items"))
    found = parts.join(known.select(F.struct(*keys).alias("_key"), "_from", "_items"), meet, "left")
    found = found.withColumn("_cut", F.when(F.col("_from").isNotNull(), cut))
    rest = [F.first(c).alias(c) for c in parts.columns if c != _PART]
    taken = F.flatten(F.transform(F.sort_array(F.collect_list("_cut")), lambda c: c["items"]))
    return found.groupBy(_PART).agg(*rest, taken.alias("_items"))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "rank",
    slice_by: Column | None = None,
    facts: DataFrame | None = None,
    capacity: DataFrame | None = None,
    lists: DataFrame | None = None,
) -> DataFrame:
    """Row number per ``keys`` along ``order``, with ``facts`` of the key, ``capacity`` of some of it and its item of ``lists``; ``order`` must be total.

    Without ``slice_by`` the caller vouches that every key fits one task: a plain window.
    """
    keys = list(keys)
    if slice_by is not None:
        return accumulated(df, keys, order, {name: None}, slice_by, facts, capacity, lists)
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    out = out if facts is None else out.join(facts, keys, "left")
    if lists is not None:
        items = lists.select(*keys, "_from", F.posexplode("_items").alias("_at", "_item"))
        met = out.join(items.select(*keys, (F.col("_from") + F.col("_at") + 1).alias(name), "_item"), [*keys, name], "left")
        out = met.select(*out.columns, "_item")
    return out if capacity is None else _with_capacity(out, capacity, {c: F.col(c) for c in keys})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "position") -> DataFrame:
    """The first ``k`` rows of every key along ``order``, with their position.

    Spark keeps ``k`` rows of a key per task before it shuffles and sorts what is left, so
    a key with most rows costs no full sort. ``order`` should be total, so that reruns agree.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(name, number).where(F.col(name) <= k)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str, slice_by: Column) -> DataFrame:
    """Sum of ``value`` up to and including each row per ``keys`` along ``order``."""
    return accumulated(df, list(keys), order, {name: value}, slice_by)
