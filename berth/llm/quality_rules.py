"""Quality rules: robust multivariate outliers of text statistics.

Each text becomes a vector of transformed statistics. Per language and source a
minimum-covariance-determinant estimate gives the centre and the covariance of the
bulk: from each of three starts, concentration steps keep the ``CORE`` of the rows
nearest to the centre and estimate anew, over all rows of the group, until no determinant
falls any more or ``STEPS`` are done; the start that ends at the least determinant counts.
As the core is half of the rows, up to that share of junk is outside it. A document whose
Mahalanobis distance from the bulk is beyond the cut-off of its group goes, as does one
that fails the base rules (too short, or mostly repetition).

Every group is estimated, whatever its size: to the sums of its core come those of its
language as ``PRIOR`` rows, to those of a language such rows of the whole table. The cut-off
follows from the group's own distances: their cube roots are nearly normal, so the
median and the lower quartile, which junk hardly moves, give a centre and a spread, and ``SPREADS``
spreads above the centre is the limit; it is never below ``LEAST_CUTOFF``, which a
normal bulk would have. It is wider where few rows stand behind it, as for the prediction
of one more row of a normal sample, and infinite for seven rows or fewer in all.
``FLOORS`` is added to the variances: statistics that hardly vary within a group don't make
outliers of documents that differ by little.

The vectors are written once, packed by group and batch, and each step reads them: numpy
measures a pack against all estimates of its group, its language and the table at once and
returns counts per bin of distance (a 32nd of a power of two) or sums, which Spark combines
before it shuffles. No group meets in one task. A limit is the bin that completes the half.

A null text counts as empty: it has no words and fails. Null languages and sources are
groups of their own. Repeated rows count each, and get the same verdict. An empty table
gives an empty result. Other columns pass through ``filter_documents`` untouched,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from berth.llm.common import keeps_columns
from berth.session import durable

LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of a group in the core, concentration steps at most, rows that the wider group counts as.
CORE, STEPS, PRIOR = 0.5, 10, 200
#: What makes the covariance of the inner half that of a normal bulk in seven dimensions.
CONSISTENCY = 1.695
#: Fall of a logarithm of a determinant that still counts.
SETTLED = 1e-4
#: Spreads of the cube root of the squared distance above its centre beyond which a document goes; and the
#: least squared distance that counts as far, 99.9 % of the chi-square distribution with seven degrees of freedom.
SPREADS, LEAST_CUTOFF = 5.0, 24.32

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics and the standard deviation that is added to each one's spread.
FLOORS = {"word_length": 0.05, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.12, "capitals": 0.05, "marks": 0.04, "digits": 0.06}
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_CAPITALS, _DIGITS, _MARKS = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[!-/:-@\[-`{-~]")
_SCHEMA = "struct<" + ", ".join([f"{c}: bigint" for c in BASE] + [f"{c}: double" for c in FLOORS]) + ">"


def _share(part: int, whole: int) -> float:
    """Share on the scale where its spread doesn't depend on its size."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> tuple:
    """The counts in ``BASE`` and the transformed statistics in ``FLOORS`` of a whole text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(text) - len(text.translate(_SYMBOLS))
    lines = [line for line in text.split("\n") if line and not line.isspace() or line.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    shares = (len(_CAPITALS.findall(text)), len(_MARKS.findall(text)), len(_DIGITS.findall(text)))
    return (
        n, chars, symbols, dup_lines, repeated,
        math.log(chars / n) if n else 0.0, _share(symbols, chars), _share(dup_lines, len(lines)), _share(repeated, n),
        *(_share(part, chars) for part in shares),
    )


def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        columns = list(zip(*map(statistics, texts.to_pylist()), strict=True)) or [()] * (len(BASE) + len(FLOORS))
        kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(FLOORS)
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*BASE, *FLOORS])


def text_statistics(text: Column) -> Column:
    """Struct of the counts and statistics of a text column."""
    return F.arrow_udf(_statistics, _SCHEMA).asNondeterministic()(text)


def base_failed(at: str) -> Column:
    n, repeated = F.col(f"{at}.n_words"), F.col(f"{at}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > round(100 * MOST_REPEATED) * n)


_P = len(FLOORS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_UPPER = np.triu_indices(_P)
_FLOORS = np.array(list(FLOORS.values()))
#: Starts; numbers of a centre with its precision and limit; numbers of a count with its sums and products.
_STARTS, _FIT, _SUMS = 3, _P + _P * _P + 1, 1 + _P + len(_PAIRS)
#: Bins of a statistic in one unit, bins of a squared distance in a power of two, least distance told apart.
_FINE, _BINS, _LEAST = 512, 32, 2.0**-20
_GROUP = ["__level", "__lang", "__source"]


def distances(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    off = x - mean
    return np.einsum("ij,ij->i", off @ precision, off)


def distance_bins(squared: np.ndarray) -> np.ndarray:
    return np.floor(_BINS * np.log2(np.maximum(squared, _LEAST))).astype(np.int64)


def _reach(bins: np.ndarray, counts: np.ndarray, share: float) -> int:
    """The bin in which a share of all is reached."""
    order = np.argsort(bins)
    total = np.cumsum(counts[order])
    return int(bins[order][np.searchsorted(total, math.ceil(share * int(total[-1])))])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_row(make: Callable[..., Iterator[tuple]], kinds: list[pa.DataType | str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one of rows; a kind that is a name is that of the input's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(f"c{k}", batch.schema.field(t).type if isinstance(t, str) else t) for k, t in enumerate(kinds)])
            columns = [c.to_pylist() for c in batch.columns]
            yield _rows(schema, [out for row in zip(*columns, strict=True) for out in make(*row)])

    return run


def _mapped(df: DataFrame, make: Callable[..., Iterator[tuple]], result: dict[str, str | pa.DataType]) -> DataFrame:
    """Rows that ``make`` gives for each row of ``df``; a result without a type is a column of ``df``."""
    kinds = [name if kind is None else kind for name, kind in result.items()]
    fields = [T.StructField(f"c{k}", df.schema[t].dataType if isinstance(t, str) else from_arrow_type(t)) for k, t in enumerate(kinds)]
    return df.mapInArrow(_by_row(make, kinds), T.StructType(fields)).toDF(*result)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats, groups = batch.column(2), {}
        x = np.column_stack([stats.field(c).to_numpy(zero_copy_only=False) for c in FLOORS]) if len(batch) else np.empty((0, _P))
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            groups.setdefault(key, []).append(i)
        schema = pa.schema([("__lang", batch.schema.field(0).type), ("__source", batch.schema.field(1).type), ("x", pa.binary())])
        yield _rows(schema, [(*key, x[at].tobytes()) for key, at in groups.items()])


def _spread_of_statistics(lang, source, x: bytes) -> Iterator[tuple]:
    """Counts of a pack per statistic and bin."""
    for k, column in enumerate(np.frombuffer(x).reshape(-1, _P).T):
        bins, counts = np.unique(np.rint(column * _FINE).astype(np.int64), return_counts=True)
        yield lang, source, k, bins.tolist(), counts.tolist()


def _starts(level: int, lang, source, found: list[dict]) -> Iterator[tuple]:
    """Three centres with their spreads: median and deviation, median and floors, lower quartile and deviation."""
    middle, quarter, wide = np.zeros(_P), np.zeros(_P), np.zeros(_P)
    for k in range(_P):
        bins, counts = (np.array([f[c] for f in found if f["k"] == k]) for c in ("bin", "n"))
        at = _reach(bins, counts, 0.5)
        middle[k], quarter[k], wide[k] = at / _FINE, _reach(bins, counts, 0.25) / _FINE, _reach(abs(bins - at), counts, 0.5) / _FINE
    wide = np.diag((1.4826 * wide + _FLOORS) ** -2.0)
    starts = [(middle, wide), (middle, np.diag(_FLOORS**-2.0)), (quarter, wide)]
    yield level, lang, source, [v for m, p in starts for v in [*m, *p.ravel(), 0.0]]


def _wider(lang, source) -> list[tuple]:
    return [(0, lang, source), (1, lang, None), (2, None, None)]


def _spread_of_distances(lang, source, x: bytes, fit: list[float]) -> Iterator[tuple]:
    """Counts of a pack per bin of distance, for all estimates it is part of."""
    rows, fits = np.frombuffer(x).reshape(-1, _P), np.array(fit).reshape(3, -1, _FIT)
    for key, of_level in zip(_wider(lang, source), fits, strict=True):
        for start, f in enumerate(of_level):
            bins, counts = np.unique(distance_bins(distances(rows, f[:_P], f[_P:-1].reshape(_P, _P))), return_counts=True)
            yield *key, start, bins.tolist(), counts.tolist()


def _sums_of_core(lang, source, x: bytes, fit: list[float]) -> Iterator[tuple]:
    """Count, sums and sums of products of the rows of a pack within the limits."""
    rows, fits = np.frombuffer(x).reshape(-1, _P), np.array(fit).reshape(3, -1, _FIT)
    for key, of_level in zip(_wider(lang, source), fits, strict=True):
        for start, f in enumerate(of_level):
            core = rows[distance_bins(distances(rows, f[:_P], f[_P:-1].reshape(_P, _P))) <= f[-1]]
            yield *key, start, [float(len(core)), *core.sum(0), *(core.T @ core)[_UPPER]]


def _with_limits(level: int, lang, source, found: list[dict]) -> Iterator[tuple]:
    limits = []
    for start in range(_STARTS):
        bins, counts = (np.array([f[c] for f in found if f["start"] == start]) for c in ("bin", "n"))
        limits.append(float(_reach(bins, counts, CORE)))
    yield level, lang, source, limits


def _estimates(lang, source, fit: list[float], own: list, of_lang: list, of_all: list, sizes: list[float]) -> Iterator[tuple]:
    """Estimates from the sums of a group, its language and the table; the narrower lean on the wider."""
    fits, now = np.array(fit).reshape(3, _STARTS, _FIT), []
    for start in range(_STARTS):
        wider = None
        for level, sums in ((2, of_all), (1, of_lang), (0, own)):
            v = np.array(sums[start])
            wider = v if wider is None else v + PRIOR * wider / wider[0]
            mean, cov = wider[1 : 1 + _P] / wider[0], np.zeros((_P, _P))
            cov[_UPPER] = wider[1 + _P :] / wider[0]
            cov = CONSISTENCY * (np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)) + np.diag(_FLOORS**2)
            fits[level, start, :_P], fits[level, start, _P:-1] = mean, np.linalg.inv(cov).ravel()
            now.append((level, start, float(np.linalg.slogdet(cov)[1])))
    now = [size for _, _, size in sorted(now)]
    yield lang, source, fits.ravel().tolist(), now, max(b - a for a, b in zip(now, sizes, strict=True))


def _least(lang, source, fit: list[float], sizes: list[float]) -> Iterator[tuple]:
    best = np.array(sizes).reshape(3, _STARTS).argmin(1)
    yield lang, source, np.array(fit).reshape(3, _STARTS, _FIT)[np.arange(3), best].ravel().tolist()


def _centres(level: int, lang, source, found: list[dict]) -> Iterator[tuple]:
    """Rows, centre and spread of the cube roots of the distances of a group."""
    bins, counts = (np.array([f[c] for f in found]) for c in ("bin", "n"))
    middle, quarter = (2.0 ** ((_reach(bins, counts, p) + 1) / _BINS / 3) for p in (0.5, 0.25))
    yield level, lang, source, [float(counts.sum()), middle, (middle - quarter) / 0.6745]


def _verdicts(lang, source, fit: list[float], own: list, of_lang: list, of_all: list) -> Iterator[tuple]:
    """Centre, precision (upper triangle, off-diagonal doubled) and cut-off of a group."""
    f, (n, *found) = np.array(fit).reshape(3, _FIT)[0], own
    wider = [(w * PRIOR + v * of_lang[0]) / (PRIOR + of_lang[0]) for v, w in zip(of_lang[1:], of_all[1:], strict=True)]
    middle, spread = ((w * PRIOR + v * n) / (PRIOR + n) for v, w in zip(found, wider, strict=True))
    behind = min(of_all[0], n + PRIOR)
    cutoff = max(LEAST_CUTOFF, (middle + SPREADS * spread) ** 3) * (behind**2 - 1) / (behind * (behind - _P)) if behind > _P else math.inf
    precision = f[_P:-1].reshape(_P, _P)
    yield lang, source, f[:_P].tolist(), [precision[i, j] * (1 + (i != j)) for i, j in _PAIRS], cutoff


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])


def _of_group(groups: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """``groups`` with the values of their own, their language's and the table's row of ``found``."""
    for level, keys in enumerate((["__lang", "__source"], ["__lang"])):
        groups = _on(groups, found.where(F.col("__level") == level).select(*keys, F.col(value).alias(f"{value}{level}")), keys)
    return groups.join(F.broadcast(found.where(F.col("__level") == 2).select(F.col(value).alias(f"{value}2"))))


def _gathered(counted: DataFrame, *by: str) -> DataFrame:
    """Bins of ``counted`` summed, and all bins of a group as one list, which is as long as there are bins."""
    bins = counted.select(*_GROUP, *by, F.explode(F.arrays_zip("bin", "n")).alias("b")).select(*_GROUP, *by, "b.bin", "b.n")
    summed = bins.groupBy(*_GROUP, *by, "bin").agg(F.sum("n").alias("n"))
    return summed.groupBy(*_GROUP).agg(F.collect_list(F.struct(*by, "bin", "n")).alias("found"))


_LONG, _INT, _DOUBLE = pa.int64(), pa.int32(), pa.float64()
_KEYS = {"__lang": None, "__source": None}
_LEVELS = {"__level": _INT} | _KEYS


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of the groups in ``rows``.

    ``rows``: __lang, __source and __stats of the documents that pass the base rules.
    Result: a row per language and source with the mean, precision and cutoff, as __fit.
    """
    kinds = rows.schema
    schema = T.StructType([T.StructField("__lang", kinds["__lang"].dataType), T.StructField("__source", kinds["__source"].dataType), T.StructField("x", T.BinaryType())])
    packs = durable(rows.select("__lang", "__source", "__stats").mapInArrow(_packs, schema))
    counted = _mapped(packs, _spread_of_statistics, _KEYS | {"k": _INT, "bin": pa.list_(_LONG), "n": pa.list_(_LONG)})
    none = F.lit(None)
    levels = [(0, F.col("__lang"), F.col("__source")), (1, F.col("__lang"), none.cast(kinds["__source"].dataType)), (2, none.cast(kinds["__lang"].dataType), none.cast(kinds["__source"].dataType))]
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("l"), a.alias("a"), s.alias("s")) for n, a, s in levels])).alias("g")
    own = counted.select("__lang", "__source", "k", F.explode(F.arrays_zip("bin", "n")).alias("b")).groupBy("__lang", "__source", "k", "b.bin").agg(F.sum("b.n").alias("n"))
    counted = own.select(levels, "k", F.array("bin").alias("bin"), F.array("n").alias("n")).select(F.col("g.l").alias("__level"), F.col("g.a").alias("__lang"), F.col("g.s").alias("__source"), "k", "bin", "n")
    start = durable(_mapped(_gathered(counted, "k"), _starts, _LEVELS | {"fit": pa.list_(_DOUBLE)}))
    groups = start.where(F.col("__level") == 0).select("__lang", "__source")
    sizes = F.array_repeat(F.lit(math.inf), 3 * _STARTS).alias("sizes")
    fit = durable(_of_group(groups, start, "fit").select("__lang", "__source", F.concat("fit0", "fit1", "fit2").alias("fit"), sizes))
    spread = _LEVELS | {"start": _INT, "bin": pa.list_(_LONG), "n": pa.list_(_LONG)}

    def numbered(values: Column, width: int) -> list[Column]:
        return [F.slice(values, 1 + k * width, width) for k in range(3 * _STARTS)]

    for _ in range(STEPS):
        counted = _mapped(_on(packs, fit.drop("sizes"), ["__lang", "__source"]), _spread_of_distances, spread)
        limits = durable(_mapped(_gathered(counted, "start"), _with_limits, _LEVELS | {"limits": pa.list_(_DOUBLE)}))
        limited = _of_group(fit, limits, "limits").withColumn("limits", F.concat("limits0", "limits1", "limits2"))
        each = [F.concat(F.slice(v, 1, _FIT - 1), F.slice("limits", 1 + k, 1)) for k, v in enumerate(numbered(F.col("fit"), _FIT))]
        limited = durable(limited.select("__lang", "__source", F.concat(*each).alias("fit"), "sizes"))
        sums = _mapped(_on(packs, limited.drop("sizes"), ["__lang", "__source"]), _sums_of_core, _LEVELS | {"start": _INT, "v": pa.list_(_DOUBLE)})
        sums = sums.groupBy(*_GROUP, "start").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(_SUMS)]).alias("v"))
        sums = durable(sums.groupBy(*_GROUP).agg(F.sort_array(F.collect_list(F.struct("start", "v"))).alias("sums")).withColumn("sums", F.col("sums.v")))
        found = _of_group(limited, sums, "sums").select("__lang", "__source", "fit", "sums0", "sums1", "sums2", "sizes")
        fit = durable(_mapped(found, _estimates, _KEYS | {"fit": pa.list_(_DOUBLE), "sizes": pa.list_(_DOUBLE), "fall": _DOUBLE}))
        falls, fit = fit.where(F.col("fall") > SETTLED), fit.drop("fall")
        if falls.isEmpty():
            break
    best = durable(_mapped(fit, _least, _KEYS | {"fit": pa.list_(_DOUBLE)}))
    counted = _mapped(_on(packs, best, ["__lang", "__source"]), _spread_of_distances, spread)
    centres = durable(_mapped(_gathered(counted), _centres, _LEVELS | {"centre": pa.list_(_DOUBLE)}))
    found = _of_group(best, centres, "centre").select("__lang", "__source", "fit", "centre0", "centre1", "centre2")
    out = _mapped(found, _verdicts, _KEYS | {"mean": pa.list_(_DOUBLE), "precision": pa.list_(_DOUBLE), "cutoff": _DOUBLE})
    return durable(out.select("__lang", "__source", F.struct("mean", "precision", "cutoff").alias("__fit")))


def _distance(at: str, fit: str) -> Column:
    """Squared Mahalanobis distance of the statistics ``at`` from an estimate."""
    off = [F.col(f"{at}.{c}") - F.col(f"{fit}.mean")[i] for i, c in enumerate(FLOORS)]
    terms = [F.col(f"{fit}.precision")[k] * off[i] * off[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def judge(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with __failed (base rules), __distance (null: a group of failed rows only) and __kept."""
    fits = fits.withColumnsRenamed({"__lang": "__lang_", "__source": "__source_"})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ("__lang", "__source")]
    rows = rows.join(fits, on, "left").drop("__lang_", "__source_")
    rows = rows.withColumns({"__failed": base_failed("__stats"), "__distance": _distance("__stats", "__fit")})
    return rows.withColumn("__kept", ~F.col("__failed") & F.coalesce(F.col("__distance") <= F.col("__fit.cutoff"), F.lit(True))).drop("__fit")


def _keyed(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.withColumns({"__stats": text_statistics(docs[text]), "__lang": docs[lang], "__source": docs[source]})


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of ``docs``: the key, the base counts, base_failed, distance and kept."""
    rows = durable(_keyed(docs.select(key, text, lang, source), text, lang, source).select(key, "__lang", "__source", "__stats"))
    out = judge(rows, estimates(rows.where(~base_failed("__stats"))))
    counts = [F.col(f"__stats.{c}").alias(c) for c in BASE]
    return out.select(key, *counts, F.col("__failed").alias("base_failed"), F.col("__distance").alias("distance"), F.col("__kept").alias("kept"))


@keeps_columns
def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rows = durable(_keyed(docs.select(text, lang, source), text, lang, source).select("__lang", "__source", "__stats"))
    fits = estimates(rows.where(~base_failed("__stats")))
    return judge(_keyed(docs, text, lang, source), fits).where("__kept").select(*docs.columns)
