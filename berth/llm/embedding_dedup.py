"""Embedding near-dedup: an exact metric range join over pivot cells.

Vectors link when their labels are equal and their cosine is ``LEAST`` or more; for unit
vectors that is a distance of sqrt(2 - 2 * LEAST) at most. Equal vectors of a label are one
class, joined once and counted as often as they occur. Every class belongs to the cell of
its nearest pivot. A vector of another cell can only be within reach of x if x is within
reach of the plane between the two pivots, which (d(x, its pivot)^2 - d(x, own pivot)^2) /
(2 d(pivots)) tells and the triangle inequality bounds, and if d(x, its pivot) is at most
the reach beyond that cell's radius; x is copied into those cells. Each
cell is joined on its own, its own vectors against all in it, so each vector finds all its
links in its own cell, once.

Cells are cut into blocks of about ``BLOCK`` vectors, and every pair of blocks is a group
of its own, so no task holds more than two blocks, however crowded a cell is. A block pair
gives each vector's number of links and one edge per vector to its component within the
pair, never all pairs. The pivots are ``PIVOTS`` classes at most, drawn by digest; more
vectors than that make cells larger, not wrong.

Vectors that are null, empty or zero, that hold a null or a number that is not finite, or
whose label is null, link with nothing, not even their like. Vectors of different lengths
don't link. Repeated rows count as vectors of their own. A null id is a component's
smallest only if it has no other. An empty table gives an empty result. Other columns are
not read, whatever their names. Classes are known by 64 bits of a digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.llm.components import components
from berth.session import durable

LEAST = 0.98
#: Pivots at most; classes for which there is one; vectors in a block.
PIVOTS, PER_PIVOT, BLOCK = 1024, 5000, 1024
_CLOSE = 1e-12


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


def alike(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which unit vectors have that cosine; sums that are too close to tell are added exactly."""
    cosines = left @ right.T
    found = cosines >= least
    for i, j in zip(*np.nonzero(np.abs(cosines - least) < _CLOSE), strict=True):
        found[i, j] = math.fsum(left[i] * right[j]) >= least
    return found


def _assigned(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], reach: float, radii: dict[int, float] | None) -> Iterator[pa.RecordBatch]:
    """Cells of vectors: the own one alone, or (with the cells' radii) all in reach."""
    for batch in batches:
        vectors, dims = batch.column(batch.schema.get_field_index("vec")), batch.column(batch.schema.get_field_index("dim")).to_numpy()
        parts = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            points = pivots.get(int(dim))
            if points is None:
                parts.append((rows, np.full(len(rows), -1), np.ones(len(rows), bool), np.zeros(len(rows))))
                continue
            d = _distances(_matrix(vectors.take(pa.array(rows)), int(dim)), points)
            home = d.argmin(1)
            nearest = d[np.arange(len(rows)), home]
            inside = np.zeros(d.shape, bool)
            if radii is not None:
                limit = np.array([radii.get(int(k), -np.inf) for k in range(len(points))])
                apart = np.maximum(_distances(points, points), _CLOSE)[home]
                inside = ((d * d - (nearest * nearest)[:, None]) / (2 * apart) <= reach) & (d <= limit + reach)
            inside[np.arange(len(rows)), home] = True
            r, c = np.nonzero(inside)
            parts.append((rows[r], c, home[r] == c, d[r, c]))
        if not parts:
            continue
        taken, *found = (pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))
        if radii is None:
            yield pa.RecordBatch.from_arrays([found[0], found[2]], ["cell", "away"])
        else:
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(batch.num_columns)], found[0], found[1]], [*batch.schema.names, "cell", "own"])


def _block_pair(table: pa.Table, least: float) -> pa.Table:
    """Links of the own vectors of a block with those of another, and the components among them."""
    table = table.combine_chunks()
    cid, n, own, dim = (table[c].to_numpy() for c in ("cid", "n", "own", "dim"))
    left, right = np.flatnonzero(own), np.flatnonzero(~own)
    if not len(left) or not len(right):
        return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    units = _matrix(table["vec"].combine_chunks() if isinstance(table["vec"], pa.ChunkedArray) else table["vec"], int(dim[0]))
    found = alike(units[left], units[right], least) & (cid[left][:, None] != cid[right][None, :])
    links = found @ n[right]
    i, j = np.nonzero(found)
    a, b = cid[left].copy(), cid[right].copy()
    while True:
        low = a.copy()
        np.minimum.at(low, i, b[j])
        high = b.copy()
        np.minimum.at(high, j, low[i])
        if (low == a).all() and (high == b).all():
            break
        a, b = low, high
    some, others = links > 0, found.any(0)
    return pa.table(
        {
            "cid": np.concatenate([cid[left][some], cid[right][others]]),
            "links": np.concatenate([links[some], np.zeros(others.sum(), np.int64)]).astype(np.int64),
            "root": np.concatenate([a[some], b[others]]),
        }
    )


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """Per row: key, n_links, component_id and kept."""
    reach = math.sqrt(2 - 2 * least) + 1e-9
    spark = vectors.sparkSession
    vec = F.transform(vectors[vector], lambda x: x.cast("double") + F.lit(0.0))
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(vectors[key].alias("key"), vectors[label].alias("label"), vec.alias("vec"))
    rows = rows.withColumn("vec", F.when(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull(), F.col("vec")))
    rows = rows.withColumn("cid", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    rows = durable(rows)
    classes = rows.where("cid is not null").groupBy("label", "vec").agg(F.first("cid").alias("cid"), F.count("*").alias("n"))
    classes = durable(classes.select("cid", "n", "label", F.size("vec").alias("dim"), "vec"))
    count = classes.count()
    drawn = classes.orderBy(F.xxhash64(F.lit("pivot"), "cid"), "cid").limit(min(PIVOTS, -(-count // PER_PIVOT))).select("dim", "vec").collect() if count else []
    pivots = {d: _unit(np.array([r["vec"] for r in drawn if r["dim"] == d])) for d in {r["dim"] for r in drawn}}
    shared = spark.sparkContext.broadcast(pivots)
    nearest = classes.select("dim", "vec").mapInArrow(lambda batches: _assigned(batches, shared.value, reach, None), "cell long, away double")
    radii = {r["cell"]: r["r"] for r in nearest.groupBy("cell").agg(F.max("away").alias("r")).collect()}  # one for each pivot
    schema = f"cid long, n long, label {classes.schema['label'].dataType.simpleString()}, dim int, vec array<double>, cell long, own boolean"
    placed = durable(classes.mapInArrow(lambda batches: _assigned(batches, shared.value, reach, radii), schema))
    cell = ["label", "dim", "cell"]
    blocks = placed.groupBy(*cell).agg(F.ceil(F.sum(F.col("own").cast("long")) / BLOCK).cast("int").alias("k"), F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    dealt = placed.join(durable(blocks), cell).withColumns({"i": F.pmod(F.xxhash64("cid"), F.col("k")), "j": F.pmod(F.xxhash64("cid"), F.col("m"))})
    shape = ["cid", "n", "vec", *cell]
    lefts = dealt.where("own").select(*shape, "own", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    rights = dealt.where("k > 0").select(*shape, F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "j")
    pairs = lefts.select(*shape, "own", F.col("i").cast("int"), F.col("j").cast("int")).union(rights.select(*shape, "own", F.col("i").cast("int"), F.col("j").cast("int")))
    found = durable(pairs.groupBy(*cell, "i", "j").applyInArrow(lambda t: _block_pair(t, least), "cid long, links long, root long"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    facts = classes.select("cid", "n").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    facts = durable(facts.select(F.col("cid").alias("cid_"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cid").alias("root")))
    rows = durable(rows.select("key", "cid").join(facts, F.col("cid") == F.col("cid_"), "left").select("key", "links", "root"))
    smallest = durable(rows.where("root is not null").groupBy(F.col("root").alias("root_")).agg(F.min("key").alias("smallest")))
    rows = rows.join(smallest, F.col("root") == F.col("root_"), "left").withColumn("component", F.coalesce("smallest", "key"))
    return rows.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
