"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words (``targets``). A document's expected copies are its
source's target over its size, times the document's own appeal if there is a column of
it. The whole part of them is certain; the fraction is its inclusion probability p. With
a uniform u drawn from the document's digest, documents rank by (u / (1 - u)) / (p / (1 -
p)), random odds over inclusion odds, and are taken in that order as long as the words
still missing allow: a sample of fixed size in words and unequal probabilities. A document
that would overshoot ends that; ``FILL`` times the largest one that fits into the gap that
is left is added, and at last the one whose size is nearest to it, if that helps.

The cut is found from a histogram of the ranks per source; only the rows in the bin of
the cut, one in thousands, are ordered exactly. What is grouped by source is combined
before it is shuffled, and what is joined by source has one row per source.

A null text has no words: it is never short of its target and takes none. A null source
is a source of its own, the last one; a null key draws as an empty one. Rows that agree
in key and text are drawn alike. An empty table gives an empty mix. Documents keep all
columns in ``mix``, whatever their names. The same rows give the same mix, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import WORD, keeps_columns
from berth.session import durable

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BINS, FILL = 4096, 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, key: Column, text: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of a digest."""
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """__source, __total and __target of the sources of ``sizes`` (__source, __size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words. A target stops at ``most`` times its source's words; the excess goes to the
    others by weight until none is above. That is a common level: sources ordered by the
    level at which they stop, the first whose level is not reached tells the level of all.
    The windows here order one row per source.
    """
    if share > most:
        raise ValueError("no targets can hold that share")
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)]
    found = sizes.groupBy("__source").agg(F.sum("__size").alias("__total")).withColumn("__weight", weight)
    found = found.withColumn("__stop", most * F.col("__total") / F.col("__weight"))
    order = [F.col("__stop"), F.col("__source").asc_nulls_last()]
    before, after = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("__total").over(everything) - most * F.coalesce(F.sum("__total").over(before), F.lit(0))
    found = found.withColumn("__level", left / F.sum("__weight").over(after))
    found = found.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__stop"), F.struct(*["__stop", F.col("__source").isNull().alias("n"), "__source", "__level"]))).over(everything)["__level"])
    return found.select("__source", "__total", F.least(F.col("__level") * F.col("__weight"), most * F.col("__total")).alias("__target"))


def _rank() -> Column:
    u, p = F.col("__u"), F.col("__p")
    return (u / (1 - u)) / (p / (1 - p))


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source; null is a source."""
    other = sources.withColumnRenamed("__source", "__source_")
    return rows.join(other, F.col("__source").eqNullSafe(F.col("__source_"))).drop("__source_")


def _drawn(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Rows with their whole copies, inclusion probability, rank and bin; null where nothing is left to chance."""
    rows = _with(rows, plan).withColumn("__copies", F.least(F.lit(most), F.col("__rate") * F.col("__appeal")))
    rows = rows.withColumn("__whole", F.floor("__copies")).withColumn("__p", F.col("__copies") - F.col("__whole"))
    rows = rows.withColumn("__rank", F.when(F.col("__p") > 0, _rank()))
    return rows.withColumn("__bin", F.floor(BINS * F.col("__rank") / (1 + F.col("__rank"))))


def _rates(rows: DataFrame, plan: DataFrame, most: float, has_appeal: bool) -> DataFrame:
    """__rate of each source: times appeal, up to ``most``, it gives copies that add up to the target."""
    if not has_appeal:
        return plan.withColumn("__rate", F.coalesce(F.col("__target") / F.nullif(F.col("__total"), F.lit(0)), F.lit(0.0)))
    rates = plan.withColumn("__rate", F.lit(0.0))
    size, weighed = F.col("__size"), F.col("__appeal") * F.col("__size")
    while True:  # ends: a document that has reached the most stays there
        full = (F.col("__rate") > 0) & (F.col("__rate") * F.col("__appeal") >= most)
        sums = _with(rows, rates).groupBy("__source").agg(F.coalesce(F.sum(F.when(full, size)), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(~full, weighed)), F.lit(0.0)).alias("w"))
        rate = F.when(F.col("w") > 0, F.greatest(F.col("__rate"), (F.col("__target") - most * F.col("f")) / F.col("w"))).otherwise(F.col("__rate"))
        new = durable(_with(rates, sums).withColumn("__new", rate).drop("f", "w"))
        done = new.where(F.col("__new") > F.col("__rate") * (1 + 1e-12)).isEmpty()
        rates = new.drop("__rate").withColumnRenamed("__new", "__rate")
        if done:
            return rates


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, has_appeal: bool = False) -> DataFrame:
    """One row per source: its target, its rate and where its sample ends.

    ``rows``: __source, __size, __u and __appeal of all documents, a written table.
    """
    sources = durable(_rates(rows, targets(rows, weights, share, most), most, has_appeal))
    drawn = _drawn(rows, sources, most)
    certain = drawn.groupBy("__source").agg(F.sum(F.col("__whole") * F.col("__size")).alias("__certain"))
    sources = durable(_with(sources, certain).withColumn("__rest", F.col("__target") - F.col("__certain")).drop("__certain"))
    bins = drawn.where("__bin is not null").groupBy("__source", "__bin").agg(F.sum("__size").alias("__words"))
    upto = Window.partitionBy("__source").orderBy("__bin")
    bins = _with(bins.withColumn("__upto", F.sum("__words").over(upto)), sources).where(F.col("__upto") > F.col("__rest"))
    cuts = bins.groupBy("__source").agg(F.min(F.struct("__bin", (F.col("__upto") - F.col("__words")).alias("__before"))).alias("c")).select("__source", "c.*")
    cuts = cuts.withColumnsRenamed({"__bin": "__cut"})
    sources = durable(sources.join(cuts.withColumnRenamed("__source", "s"), F.col("__source").eqNullSafe(F.col("s")), "left").drop("s"))
    drawn = _drawn(rows, sources, most)
    edge = drawn.where(F.col("__bin") == F.col("__cut"))
    edge = edge.withColumn("__upto", F.col("__before") + F.sum("__size").over(Window.partitionBy("__source").orderBy("__rank")))
    edge = edge.where(F.col("__upto") <= F.col("__rest")).groupBy("__source").agg(F.max("__rank").alias("__last"), F.max("__upto").alias("__got"))
    sources = sources.join(edge.withColumnRenamed("__source", "s"), F.col("__source").eqNullSafe(F.col("s")), "left").drop("s")
    sources = sources.withColumns({"__gap": F.col("__rest") - F.coalesce("__got", "__before"), "__more": F.array().cast("array<double>")}).drop("__got")
    for k in range(FILL + 1):
        sources = durable(sources)
        left = _drawn(rows, sources, most).where(F.col("__rank").isNotNull() & ~_inside() & ~F.array_contains("__more", F.col("__rank")))
        away = F.abs(F.col("__size") - F.col("__gap"))
        if k < FILL:
            left = left.where((F.col("__size") > 0) & (F.col("__size") <= F.col("__gap")))
            pick = F.max(F.struct(F.col("__size").alias("s"), (-F.col("__rank")).alias("r"), (-F.col("__size")).alias("x")))
        else:
            left = left.where(away < F.col("__gap"))
            pick = F.min(F.struct(away.alias("x"), F.col("__rank").alias("r"), F.col("__size").alias("s")))
        picks = left.groupBy(F.col("__source").alias("s")).agg(pick.alias("pick"))
        sources = sources.join(picks, F.col("__source").eqNullSafe(F.col("s")), "left").drop("s")
        added = F.when(F.col("pick").isNull(), F.col("__more")).otherwise(F.array_append("__more", F.abs(F.col("pick.r"))))
        sources = sources.withColumns({"__more": added, "__gap": F.col("__gap") - F.coalesce("pick.s", F.lit(0))}).drop("pick")
    return durable(sources)


def _inside() -> Column:
    """Whether a row's rank is before the cut of its source; a source without a cut takes all."""
    cut = F.col("__cut")
    return cut.isNull() | (F.col("__bin") < cut) | F.coalesce((F.col("__bin") == cut) & (F.col("__rank") <= F.col("__last")), F.lit(False))


def copies(rows: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """``rows`` with __copies, the whole number of times that the mix takes each."""
    drawn = _drawn(rows, sources, most)
    sampled = F.col("__rank").isNotNull() & (_inside() | F.coalesce(F.array_contains("__more", F.col("__rank")), F.lit(False)))
    return drawn.withColumn("__copies", F.col("__whole") + sampled.cast("long"))


def _rows(docs: DataFrame, key: str, text: str, source: str, appeal: str | None, seed: int) -> DataFrame:
    given = F.greatest(F.coalesce(docs[appeal].cast("double"), F.lit(0.0)), F.lit(0.0)) if appeal else F.lit(1.0)
    return docs.withColumns({"__source": docs[source], "__size": words(docs[text]), "__u": uniform(seed, docs[key], docs[text]), "__appeal": given})


def amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", appeal: str | None = None, seed: int = 0, **how) -> DataFrame:
    """Per document: key, size, source_size, target (its source's), copies and taken."""
    needed = list(dict.fromkeys([key, text, source, *([appeal] if appeal else [])]))
    rows = durable(_rows(docs.select(*needed), key, text, source, appeal, seed).select(F.col(key).alias("__key"), "__source", "__size", "__u", "__appeal"))
    out = copies(rows, plan(rows, has_appeal=bool(appeal), **how), how.get("most", MOST))
    return out.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__copies").cast("long").alias("copies"),
    )


@keeps_columns
def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", appeal: str | None = None, seed: int = 0, **how) -> DataFrame:
    """The mix itself: documents with all their columns, each as often as it is taken."""
    needed = list(dict.fromkeys([key, text, source, *([appeal] if appeal else [])]))
    own = ["__source", "__size", "__u", "__appeal"]
    found = plan(durable(_rows(docs.select(*needed), key, text, source, appeal, seed).select(*own)), has_appeal=bool(appeal), **how)
    out = copies(_rows(docs, key, text, source, appeal, seed), found, how.get("most", MOST))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


_FILLED = """f{j} AS (
  SELECT * EXCLUDE (pick) REPLACE (inside OR coalesce(q = -pick.q, false) AS inside, gap - coalesce(pick.s, 0) AS gap)
  FROM (SELECT *, max(CASE WHEN q IS NOT NULL AND NOT inside AND size > 0 AND size <= gap THEN {{'s': size, 'q': -q}} END) OVER (PARTITION BY source) AS pick FROM f{i})
), """

SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * total / weight AS stop FROM s
), v AS (
  SELECT *, (1.5::DOUBLE * sum(total) OVER () - 2.0::DOUBLE * coalesce(sum(total) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l
), t AS (
  SELECT source, total, least((SELECT level FROM v WHERE level <= stop ORDER BY stop, source NULLS LAST LIMIT 1) * weight, 2.0::DOUBLE * total) AS target FROM v
), r AS (
  SELECT d.*, total, target, coalesce(target / nullif(total, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p, target - floor(rate) * total AS rest FROM r
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p
), c AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q) END AS upto FROM q
), g AS (
  SELECT *, coalesce(upto <= rest, false) AS inside, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c
), f0 AS (
  SELECT * FROM g
), """ + "".join(_FILLED.format(i=i, j=i + 1) for i in range(FILL)) + f"""m AS (
  SELECT *, min(CASE WHEN q IS NOT NULL AND NOT inside AND abs(size - gap) < gap THEN {{'a': abs(size - gap), 'q': q}} END) OVER (PARTITION BY source) AS more FROM f{FILL}
)
SELECT doc_id, size, total AS source_size, target, CAST((whole + CASE WHEN inside OR coalesce(q = more.q, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(whole + CASE WHEN inside OR coalesce(q = more.q, false) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM m
"""
