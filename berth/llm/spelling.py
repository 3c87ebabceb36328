"""Spelling variants: words one edit apart, found by an index of grams of variable length.

Words are counted over all texts. Near are two words that differ by exactly one inserted,
deleted or replaced code point. A word's form is its near word of largest count, if that
is ``RATIO`` times its own or more; following forms to the last gives its root.

The dictionary has the grams of ``SHORTEST`` to ``LONGEST`` code points, pruned by
frequency: a gram is extended only while more than ``COMMON`` words hold it, so a walk
from each position of a word ends at the shortest gram rare enough. The code points that a
walk reads, the word's end among them where the walk meets it, are all that an edit has to
touch to affect the gram. A gram that no edit of a word touches stands in the near word as
well, at the same place or one further.

List merging: grams are listed by gram, position and length of the word. Intervals of
which any two meet share a point, so the smallest set of grams that no single edit affects
as a whole is a pair with nothing read in common. Each word looks up the pair with the
shortest lists, among words of its length and of one more, and candidates are verified
inside the join. Words of ``LEAST`` code points or more have such a pair, as the walk from
the start reads ``LONGEST`` at most and another starts behind it.

A list of more than ``HEAVY`` words that is looked up is not paired. Its words and those
that ask for it meet by what one edit leaves of them instead: the word with one code point
deleted, and where. Such groups hold true variants alone, as many as there are letters, so
no group's pairs grow with the table.

A null text has no words; a null key counts as an empty one; repeated rows count each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.session import durable

#: The letters of a run, least length and count of a word, ratio of counts to a form.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, OFTEN, RATIO = 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST, COMMON, HEAVY = 2, 4, 64, 256


def without(word: Column, position: Column) -> Column:
    """The word without its code point at a position from 0."""
    return F.concat(F.substring(word, F.lit(1), position), F.substring(word, position + 2, F.length(word)))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 199, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """``word`` and ``n`` of the runs of letters; one in ``rare`` of them, by digest, has lost a letter."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"),
    ).select("k", F.translate("run", _UPPER, _LOWER).alias("run"))
    digest = F.crc32(F.concat("k", F.lit(":"), "run"))
    slip = runs.select("run", digest.alias("h")).select(
        F.when(F.col("h") % rare == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word")
    )
    return slip.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def _grams(vocabulary: DataFrame) -> DataFrame:
    """Grams of every word by the pruned dictionary: word, size, gram, p and stop, the first position not read."""
    size, places = F.length("word"), F.explode(F.sequence(F.lit(0), F.length("word") - SHORTEST)).alias("p")
    walks = vocabulary.select("word", size.alias("size"), places).select(
        "word", "size", "p", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.col("size") - F.col("p")))).alias("q")
    ).withColumn("gram", F.substring(F.col("word"), F.col("p") + 1, F.col("q")))
    dictionary = walks.groupBy("gram").agg(F.count_distinct("word").alias("held")).where(F.col("held") > COMMON).select("gram", F.lit(True).alias("common"))
    walked = walks.join(dictionary, "gram", "left").groupBy("word", "size", "p").agg(
        F.min(F.when(F.col("common").isNull(), F.col("q"))).alias("leaf"), F.max("q").alias("deepest")
    )
    q = F.coalesce("leaf", "deepest")
    # a walk that the word's end stopped has read that end
    ended = F.col("leaf").isNull() & (F.col("deepest") < LONGEST)
    return walked.select(
        "word", "size", "p", F.substring(F.col("word"), F.col("p") + 1, q).alias("gram"), (F.col("p") + q + ended.cast("int")).alias("stop")
    )


def _asked(listed: DataFrame) -> DataFrame:
    """Of each word the pair of grams with nothing read in common and the shortest lists."""
    part = F.struct("p", "stop", "gram", "held")
    each = listed.groupBy("word", "size").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def cheapest(first: Column) -> Column:
        behind = lambda second: second["p"] >= first["stop"]
        pairs = F.transform(F.filter("parts", behind), lambda second: F.struct((first["held"] + second["held"]).alias("cost"), first.alias("a"), second.alias("b")))
        return F.array_min(pairs)

    best = each.select("word", "size", F.array_min(F.filter(F.transform("parts", cheapest), lambda x: x.isNotNull())).alias("best"))
    return best.select("word", "size", F.explode(F.array("best.a", "best.b")).alias("x")).select("word", "size", "x.p", "x.gram")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of words of ``vocabulary`` (word) that are one edit apart, each once."""
    key = ["gram", "p", "size"]
    grams = durable(_grams(vocabulary.select("word")))
    sizes = durable(grams.groupBy(*key).agg(F.count("*").alias("held")))
    asked = _asked(grams.join(sizes, key))
    places = F.explode(F.array(*[F.struct((F.col("p") + dp).alias("p"), (F.col("size") + ds).alias("size")) for dp, ds in ((0, 0), (0, 1), (1, 1))])).alias("x")
    asked = durable(asked.select("word", "gram", places).select("word", "gram", "x.p", "x.size").join(sizes, key))

    light = asked.where(F.col("held") <= HEAVY).select(F.col("word").alias("s"), *key)
    listed = grams.join(sizes.where(F.col("held") <= HEAVY), key).select(F.col("word").alias("t"), *key)
    merged = light.join(listed, [*[light[c] == listed[c] for c in key], F.col("s") != F.col("t"), _one_edit("s", "t")]).select("s", "t")

    heavy = asked.where(F.col("held") > HEAVY)
    members = grams.join(heavy.select(*key).distinct(), key, "left_semi").select("word")
    left = durable(heavy.select("word").union(members).distinct())
    places = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i")
    rest = left.select("word", places).select("word", "i", without(F.col("word"), F.col("i")).alias("rest"))
    replaced = rest.select(F.col("word").alias("s"), "rest", "i").join(rest.select(F.col("word").alias("t"), "rest", "i"), ["rest", "i"]).where("s < t").select("s", "t")
    deleted = rest.select("rest", F.col("word").alias("t")).join(left.select(F.col("word").alias("s")), F.col("s") == F.col("rest")).select("s", "t")

    found = merged.union(replaced).union(deleted)
    return found.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words of ``forms`` (word, form); the way doubles from round to round."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        following = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        if now.join(following, F.col("root") == F.col("w"), "left_semi").isEmpty():
            return now
        now = durable(now.join(following, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")))


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word of ``vocabulary`` (word, n) with form, root, n_near and form_n."""
    vocabulary = durable(vocabulary.select("word", "n"))
    pairs = near_words(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    formed = (-F.col("best.m")) >= ratio * F.col("n")
    out = durable(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"),
    ))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of the documents with their variants: word, form, root, n, n_near, form_n."""
    return variants(words(docs, key, text))


_CRC = """CAST(xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    [CAST('0x' || substr(hx, CAST(2 * i + 1 AS INT), 2) AS BIGINT) for i in range(length(hx) // 2)]), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS BIGINT)"""
#: The crc32 of a run comes from its table, made by rule; variants from one deletion each.
SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), distinct_runs AS (SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS hx FROM runs WHERE length(run) >= {LEAST} GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC} AS h FROM distinct_runs, crc),
slips AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed
), w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slips WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {OFTEN}),
rest AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) q
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM rest a JOIN rest b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN rest b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM w a JOIN rest b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, {{'m': -m, 'other': other}}) AS other FROM near GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN m >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word
), way(word, root, form, k) AS (
  SELECT word, word, form, 0 FROM formed
  UNION ALL SELECT way.word, way.form, formed.form, k + 1 FROM way JOIN formed ON way.form = formed.word
)
SELECT f.word, f.form, way.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN way ON f.word = way.word AND way.form IS NULL
"""
