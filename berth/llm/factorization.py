"""Factorisation machines over hashed terms of texts.

A text is a sparse vector: its distinct words, hashed into buckets, and a few dense
statistics. The score adds a weight per feature and, for every pair, the product of their
low-rank vectors; by the identity sum of pairs = half of (square of the sum - sum of the
squares), that takes linear time. So a pair, such as an insult beside a mention of a
group, counts for more or less than its parts.

Training takes a bounded sample of labelled rows: the ``SAMPLE`` rows of either label
whose key has the smallest digest, weighed so that both labels count as often as among
all labelled rows. A bucket gets a vector if it differs between the labels alone or together
with another bucket (``interacting``), however few documents hold the two, or if it is
common; one that says nothing alone has no weight of its own. Training runs in numpy on the driver, on features that the executors extract;
scoring runs on the executors, on whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of either label at most that training takes.
SAMPLE = 3000
BUCKETS, RANK = 1 << 18, 8
EPOCHS, BATCH, RATE, DECAY = 25, 128, 0.1, 2e-4
#: A bucket needs this many documents, and this many standard errors between the labels or this share of all.
LEAST_DOCS, LEAST_ERRORS, COMMON = 4, 4.5, 0.25
#: Documents that hold a bucket, and a pair, that is looked at, standard errors of a pair, and how far beyond those of its parts.
PAIR_DOCS, PAIR_ERRORS, BEYOND = 24, 8.0, 3.0
#: Cells in which pairs are counted, and pairs that are counted at a time.
CELLS, AT_ONCE = 1 << 23, 1 << 18
KNOWN = 300_000
_words = re.compile(r"[^\W\d_]+").findall

Dense = Callable[[str], list[float]]


def buckets(text: str) -> set[int]:
    """Buckets of the distinct words of a text, in any case."""
    return {xxhash.xxh32_intdigest(w) & (BUCKETS - 1) for w in set(_words(text.lower()))}


def _errors(hits: np.ndarray, others: np.ndarray, positive: float, n: int) -> np.ndarray:
    """Standard errors between the shares of rows of either label."""
    p, q, pooled = (hits + 0.5) / (positive + 1), (others + 0.5) / (n - positive + 1), (hits + others + 1) / (n + 2)
    return np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / (positive + 1) + 1 / (n - positive + 1)))


def _pairs(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a row's buckets and their cells, a bounded number at a time."""
    step = max(1, AT_ONCE // max(1, len(some)))
    for k in range(0, len(some), step):
        left, right = np.meshgrid(some[k : k + step], some, indexing="ij")
        below = left < right
        left, right = left[below], right[below]
        yield left, right, ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 7) & (CELLS - 1)


def interacting(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seen: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Buckets that differ between the labels beside another bucket, well beyond what each does alone.

    Pairs share cells, so a few buckets too many may be found, none too few.
    """
    counts, often = np.zeros((2, CELLS), np.int32), seen >= PAIR_DOCS
    held = [b[often[b]] for b, _ in rows]
    for some, y in zip(held, labels, strict=True):
        for _, _, cell in _pairs(some):
            np.add.at(counts[int(y)], cell, 1)
    strong = np.zeros(CELLS, np.float32)
    for k in range(0, CELLS, AT_ONCE):  # in parts, as each takes several times its size
        part = counts[:, k : k + AT_ONCE]
        found = _errors(part[1], part[0], labels.sum(), len(rows))
        strong[k : k + AT_ONCE] = np.where((found < PAIR_ERRORS) | (part.sum(0) < PAIR_DOCS), 0, found)
    found = np.zeros(len(seen), bool)
    for some in held:
        for left, right, cell in _pairs(some):
            at = np.flatnonzero(strong[cell])
            left, right = left[at], right[at]
            at = strong[cell[at]] > BEYOND * np.maximum(errors[left], errors[right])
            found[left[at]] = found[right[at]] = True
    return found


class _Slots(dict):
    """Word to its place in the model, -1 for none."""

    def __init__(self, places: np.ndarray):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> int:
        place = int(self.places[xxhash.xxh32_intdigest(word) & (BUCKETS - 1)])
        if len(word) <= 64:
            self[word] = place
        return place


class Machine:
    """``fit`` on sparse rows, ``score`` texts."""

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Machine:
        n, dense = len(rows), np.array([d for _, d in rows], np.float64).reshape(len(rows), -1)
        self.centre, self.spread = dense.mean(0), dense.std(0) + 1e-6
        positive = labels.sum()
        seen = np.zeros(BUCKETS)
        hits = np.zeros(BUCKETS)
        for (b, _), y in zip(rows, labels, strict=True):
            seen[b] += 1
            hits[b] += y
        errors = _errors(hits, seen - hits, positive, n)
        alone = (seen >= LEAST_DOCS) & ((errors >= LEAST_ERRORS) | (seen >= COMMON * n))
        active = np.flatnonzero(alone | interacting(rows, labels, seen, errors))
        alone = np.append(alone[active], np.ones(dense.shape[1], bool))
        self.places = np.full(BUCKETS, -1, np.int32)
        self.places[active] = np.arange(len(active))
        self.words = len(active)
        width = self.words + dense.shape[1]
        rng = np.random.default_rng(0)
        self.bias, self.linear, self.pairs = 0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK))
        index, value = [], []
        for (b, _), d in zip(rows, (dense - self.centre) / self.spread, strict=True):
            places = self.places[b]
            places = places[places >= 0]
            index.append(np.append(places, np.arange(self.words, width)))
            value.append(np.append(np.ones(len(places)), np.clip(d, -5, 5)))
        speed = [1e-8, np.full(width, 1e-8), np.full((width, RANK), 1e-8)]
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for some in np.split(order, range(BATCH, n, BATCH)):
                i, x = np.concatenate([index[k] for k in some]), np.concatenate([value[k] for k in some])[:, None]
                of = np.repeat(np.arange(len(some)), [len(index[k]) for k in some])
                v = self.pairs[i]
                sums = np.stack([np.bincount(of, v[:, r] * x[:, 0], len(some)) for r in range(RANK)], 1)
                squares = np.bincount(of, ((v * x) ** 2).sum(1), len(some))
                score = self.bias + np.bincount(of, self.linear[i] * x[:, 0], len(some)) + 0.5 * ((sums**2).sum(1) - squares)
                error = weights[some] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
                slope = error[of][:, None] * (x * sums[of] - v * x * x)
                grads = [
                    error.sum(),
                    (np.bincount(i, error[of] * x[:, 0], width) + DECAY * self.linear) * alone,
                    np.stack([np.bincount(i, slope[:, r], width) for r in range(RANK)], 1) + DECAY * self.pairs,
                ]
                steps = []
                for k, g in enumerate(grads):
                    speed[k] = speed[k] + g**2
                    steps.append(RATE * g / np.sqrt(speed[k] + 1e-8))
                self.bias, self.linear, self.pairs = self.bias - steps[0], self.linear - steps[1], self.pairs - steps[2]
        return self

    def scorer(self) -> Callable[[str, list[float]], float]:
        slots, words = _Slots(self.places), self.words

        def score(text: str, dense: list[float]) -> float:
            if len(slots) > KNOWN:
                slots.clear()
            places = set(map(slots.__getitem__, set(_words(text.lower()))))
            places.discard(-1)
            i = np.fromiter(places, np.int64, len(places))
            x = np.clip((np.array(dense) - self.centre) / self.spread, -5, 5)
            v, d = self.pairs[i], self.pairs[words:] * x[:, None]
            sums = v.sum(0) + d.sum(0)
            total = self.bias + self.linear[i].sum() + (self.linear[words:] * x).sum() + 0.5 * ((sums**2).sum() - (v**2).sum() - (d**2).sum())
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

        return score


def _metadata(docs: DataFrame, columns: list[str]) -> Column:
    """Logarithms of numeric columns; null, negative and not finite count as 0."""
    each = [F.greatest(F.coalesce(F.nanvl(docs[c].cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for c in columns]
    return F.array(*[F.log1p(F.least(c, F.lit(1e15))) for c in each]) if columns else F.array().cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str, dense: Dense, metadata: list[str], key: str, text: str) -> Machine | None:
    """A machine from the labelled rows that ``allowed`` (a condition on the key) lets pass; None if there are none of a label."""
    known = labels.select(F.col(key), F.col(label).cast("double").alias("__y")).where(allowed & F.col("__y").isin(0.0, 1.0) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.max("__y").alias("__y"))
    totals = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    some = [known.where(F.col("__y") == y).orderBy(F.xxhash64(key), key).limit(SAMPLE) for y in (0.0, 1.0)]

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [(sorted(buckets(t or "")), dense(t or "")) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["b", "d"])

    extract = F.arrow_udf(features, "struct<b: array<int>, d: array<double>>").asNondeterministic()
    rows = docs.select(docs[key].alias(key), docs[text].alias("__t"), _metadata(docs, metadata).alias("__m"))
    rows = rows.join(F.broadcast(some[0].union(some[1])), key)  # at most 2 * SAMPLE keys
    rows = rows.withColumn("__f", extract("__t")).drop("__t").dropDuplicates([key]).orderBy(key).collect()
    if len({r["__y"] for r in rows}) < 2:
        return None
    y = np.array([r["__y"] for r in rows])
    weights = np.where(y == 1, totals[1.0] / max(1, (y == 1).sum()), totals[0.0] / max(1, (y == 0).sum()))
    return Machine().fit([(np.array(r["__f"]["b"], np.int64), np.array(r["__f"]["d"] + r["__m"])) for r in rows], y, weights / weights.mean())


def score(docs: DataFrame, machine: Machine | None, dense: Dense, metadata: list[str], text: str) -> Column:
    """Scores of whole texts, 0 to 1; a null text counts as empty; 0.5 without a machine."""
    if machine is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = shared.value.scorer()
        for texts, more in batches:
            yield pa.array([of(t or "", dense(t or "") + m) for t, m in zip(texts.to_pylist(), more.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(scored, "double").asNondeterministic()(docs[text], _metadata(docs, metadata))
