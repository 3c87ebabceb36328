"""Whether tables split into parts lose nothing: by data, and by declared dependencies.

By data, the size of the join of all parts is counted without joining them: where the
parts form a tree, each part passes its neighbour one number per value they share. By
dependencies, the closure of columns and the chase of a tableau decide for any parts; they
work on names of columns only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COUNT = "decimal(38,0)"


def closure(columns: Iterable[str], dependencies: Sequence[tuple[Sequence[str], Sequence[str]]]) -> set[str]:
    """All columns that the given ones determine."""
    known, grown = set(columns), True
    while grown:
        grown = False
        for left, right in dependencies:
            if set(left) <= known and not set(right) <= known:
                known |= set(right)
                grown = True
    return known


def lossless_by_chase(columns: Sequence[str], parts: Sequence[Sequence[str]], dependencies: Sequence[tuple[Sequence[str], Sequence[str]]]) -> bool:
    """Whether every table that keeps the dependencies is the join of its parts."""
    rows = [{c: "" if c in part else f"{i}" for c in columns} for i, part in enumerate(parts)]  # "" is the common symbol
    changed = True
    while changed:
        changed = False
        for left, right in dependencies:
            groups: dict[tuple[str, ...], list[dict[str, str]]] = {}
            for row in rows:
                groups.setdefault(tuple(row[c] for c in left), []).append(row)
            for same in groups.values():
                for c in right:
                    symbols = {row[c] for row in same}
                    if len(symbols) > 1:
                        for row in rows:
                            if row[c] in symbols:
                                row[c] = min(symbols)
                        changed = True
    return any(all(v == "" for v in row.values()) for row in rows)


def join_tree(parts: Sequence[Sequence[str]]) -> list[tuple[int, int, list[str]]] | None:
    """Steps (part, neighbour, shared columns) that take the parts off one by one, or None for cyclic or unconnected parts."""
    left, steps = dict(enumerate(map(set, parts))), []
    while len(left) > 1:
        for i, part in reversed(left.items()):  # so that steps go towards the first part
            shared = part & set().union(*(p for j, p in left.items() if j != i))
            host = next((j for j, p in left.items() if j != i and shared <= p), None)
            if host is not None and shared:
                steps.append((i, host, sorted(shared)))
                del left[i]
                break
        else:
            return None
    return steps


def joined_size(df: DataFrame, parts: Sequence[Sequence[str]]) -> DataFrame:
    """Distinct rows of ``df`` (n_rows) and rows of the join of its ``parts`` (n_joined), one row.

    The parts must cover the columns and form a tree (``join_tree``); cyclic parts need
    ``lossless_by_chase``. Rows with a null in a shared column join with nothing.
    """
    if set().union(*parts) != set(df.columns):
        raise ValueError("the parts must cover all columns")
    steps = join_tree(parts)
    if steps is None:
        raise ValueError("the parts are no tree: ask lossless_by_chase")
    tables, counted = [df.select(*part).distinct() for part in parts], set()

    def folded(k: int, columns: Sequence[str]) -> DataFrame:
        """Rows joined so far (_m) by what later steps still need of part ``k``."""
        return tables[k].groupBy(*columns).agg((F.sum("_n") if k in counted else F.count(F.lit(1))).cast(_COUNT).alias("_m"))

    for at, (i, host, shared) in enumerate(steps):
        sent, later = folded(i, shared), {c for a, b, on in steps[at:] if host in (a, b) for c in on}
        if later < set(tables[host].columns) - {"_n"}:  # combined before it is shuffled
            tables[host] = folded(host, sorted(later)).withColumnRenamed("_m", "_n")
            counted.add(host)
        met = tables[host].join(sent, shared)
        tables[host] = met.withColumn("_n", (F.col("_n") * F.col("_m")).cast(_COUNT) if host in counted else F.col("_m")).drop("_m")
        counted.add(host)
    root = ({*range(len(parts))} - {i for i, _, _ in steps}).pop()
    joined = tables[root].select(F.lit(0).cast(_COUNT).alias("_r"), (F.col("_n") if root in counted else F.lit(1)).cast(_COUNT).alias("_j"))
    rows = df.distinct().select(F.lit(1).cast(_COUNT).alias("_r"), F.lit(0).cast(_COUNT).alias("_j"))
    return joined.unionByName(rows).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(_COUNT).alias(n) for c, n in (("_r", "n_rows"), ("_j", "n_joined"))])
