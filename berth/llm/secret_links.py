"""Secret scans with multipart linking: weak candidates count only beside what completes them.

Base patterns (``BASE``) are reported wherever they match. Three weak ones (``WEAK``) are
too common to report alone: names of accounts, long mixed runs of letters and digits, and
addresses of services. An account is reported if a secret stands in its scope, a mixed run
if an identifier does, an address if both do; identifiers are access keys and accounts,
secrets are assigned values, hexadecimal runs and mixed runs. The scope of a part reaches
``SCOPE`` characters beyond either end of it. A weak candidate that overlaps a base match
is no candidate.

The interval join of the parts stays within the row, as a scope never leaves its text:
parts are sorted by where they start, running maxima of the ends before a part and running
minima of the starts after it, one of either per role, say whether its scope is met. No
pairs are made, nothing is shuffled, and a text with very many matches costs n log n
steps. All is built-in column functions.

A null text counts as empty and has no parts. Equal rows are scanned each, keys may be
null or repeated, an empty table gives an empty result. Offsets are characters (code
points), the end exclusive. Other columns pass through, whatever their names; a column
named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import unused

SCOPE = 200


def _either(words: str) -> str:
    """A pattern with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
_RUN = "[A-Za-z0-9+/_.=-]"
#: Pattern and least length, of group 2 for assigned values, else of the match.
BASE = {
    "assign": (f"({_either('password|passwd|secret|token|api_?key')}){_GLUE}({_RUN}+)", 6),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("[0-9a-f]{24,}", 24),  # the runs of 24 or more, without a match for each shorter run
}
WEAK = {
    "account": (f"({_either('user|username|login|account|client_id|key_id')}){_GLUE}([A-Za-z0-9@+/_.=-]+)", 3),
    "mixed": ("[A-Za-z0-9+/]{32,}", 32),
    "address": (f"{_either('http')}[Ss]?://[A-Za-z0-9._~:/@-]+", 12),
}
KINDS = {**BASE, **WEAK}
IDENTIFIERS, SECRETS = ("access", "account"), ("assign", "hex", "mixed")
_CODE = {kind: i for i, kind in enumerate(KINDS)}
_FAR = 1 << 60


def _scan(values: Column, combine: Callable[[Column, Column], Column], neutral: int) -> Column:
    """Running combination along an array of longs, in passes that double their reach."""
    reaches = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.size(values))), F.lit(0)).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def step(now: Column, reach: Column) -> Column:
        return F.transform(now, lambda x, i: combine(x, F.coalesce(F.get(now, i - reach), F.lit(neutral).cast("long"))))

    return F.when(F.size(values) > 1, F.aggregate(reaches, values, step)).otherwise(values)


def _before(values: Column, combine: Callable, neutral: int) -> Column:
    """As ``_scan``, of what stands before each element."""
    scanned = _scan(values, combine, neutral)
    return F.slice(F.concat(F.array(F.lit(neutral).cast("long")), scanned), F.lit(1), F.size(values))


def _spans(gaps: str, hits: str, kind: str) -> Column:
    """Matches of a kind that are long enough, from the matches and what stands between them."""
    pattern, least = KINDS[kind]
    # a gap and the match before it, for each gap but the last
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.concat(F.array(F.lit("")), F.col(hits)), lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
    starts = _scan(F.slice(steps, F.lit(1), F.size(hits)), lambda a, b: a + b, 0)

    def span(start: Column, hit: Column) -> Column:
        size = F.length(F.regexp_extract(hit, pattern, 2) if "(" in pattern else hit)
        return F.struct(start.alias("start"), F.lit(_CODE[kind]).alias("kind"), (start + F.length(hit)).alias("end"), size.alias("size"))

    long_enough = F.filter(F.zip_with(starts, hits, span), lambda x: x["size"] >= least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _parts(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: all matches of all kinds that are long enough, sorted."""
    columns = df.columns
    pieces, hits = (unused(df, *[f"__{what}_{kind}" for kind in KINDS]) for what in ("pieces", "hits"))
    for p, (pattern, _) in zip(pieces, KINDS.values(), strict=True):
        df = df.withColumn(p, F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), pattern, -1))
    none = F.array().cast("array<string>")
    for p, h, (pattern, _) in zip(pieces, hits, KINDS.values(), strict=True):
        df = df.withColumn(h, F.when(F.size(p) > 1, F.regexp_extract_all(f"`{text}`", F.lit(pattern), F.lit(0))).otherwise(none))
    found = [_spans(p, h, kind) for p, h, kind in zip(pieces, hits, KINDS, strict=True)]
    return df.select(*[F.col(f"`{c}`") for c in columns], F.array_sort(F.concat(*found)).alias(out))


def _at(parts: str, kinds: tuple[str, ...], field: str, neutral: int) -> Column:
    codes = [_CODE[k] for k in kinds]
    return F.transform(parts, lambda x: F.when(x["kind"].isin(codes), x[field]).otherwise(F.lit(neutral)))


def _nearest(df: DataFrame, parts: str, roles: dict[str, tuple[str, ...]]) -> tuple[DataFrame, str]:
    """``df`` and the name of an array that has, per part, the nearest end before and start after it of every role."""
    names = []
    for role, kinds in roles.items():
        ends, starts = _at(parts, kinds, "end", -_FAR), F.reverse(_at(parts, kinds, "start", _FAR))
        last, following = unused(df, f"__{role}_last", f"__{role}_next")
        df = df.withColumns({last: _before(ends, F.greatest, -_FAR), following: F.reverse(_before(starts, F.least, _FAR))})
        names += [last, following]
    fields = [part for role in roles for part in (f"{role}_last", f"{role}_next")]
    (near,) = unused(df, "__near")
    zipped = F.arrays_zip(F.col(parts).alias("part"), *[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)])
    return df.withColumn(near, zipped).drop(*names), near


def find(docs: DataFrame, text: str = "text", out: str = "parts") -> DataFrame:
    """``docs`` with ``out``: the reported parts, an array of (kind, start, end), by start and kind."""
    columns = [c for c in docs.columns if c != out]
    (parts,) = unused(docs, "__parts")
    df, near = _nearest(_parts(docs, text, parts), parts, {"base": tuple(BASE)})
    alone = F.filter(near, lambda x: (x["part"]["kind"] < len(BASE)) | ((x["base_last"] <= x["part"]["start"]) & (x["base_next"] >= x["part"]["end"])))
    df = df.withColumn(parts, F.transform(alone, lambda x: x["part"])).drop(near)
    df, near = _nearest(df, parts, {"id": IDENTIFIERS, "secret": SECRETS})

    def met(x: Column, role: str) -> Column:
        return (x[f"{role}_last"] >= x["part"]["start"] - SCOPE) | (x[f"{role}_next"] <= x["part"]["end"] + SCOPE)

    def linked(x: Column) -> Column:
        kind = x["part"]["kind"]
        weak = F.when(kind == _CODE["account"], met(x, "secret")).when(kind == _CODE["mixed"], met(x, "id"))
        return F.when(kind < len(BASE), F.lit(True)).otherwise(weak.otherwise(met(x, "id") & met(x, "secret")))

    named = F.array(*[F.lit(k) for k in KINDS])
    reported = F.transform(
        F.filter(near, linked),
        lambda x: F.struct(F.element_at(named, x["part"]["kind"] + 1).alias("kind"), x["part"]["start"].alias("start"), x["part"]["end"].alias("end")),
    )
    return df.select(*[F.col(f"`{c}`") for c in columns], reported.alias(out))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, numbers of the base kinds, digest of the base spans, and all spans."""
    df = find(docs.select(F.col(key), F.col(text)), text, "__found")

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("__found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("__found", lambda x: x["kind"].isin(*BASE))
    return df.select(key, *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__found")).alias("spans"))


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _) in KINDS.items()}
    kinds = ", ".join(f"({c}, '{k}', '{quoted[k]}', {KINDS[k][1]})" for k, c in _CODE.items())
    ids, secrets = (", ".join(str(_CODE[k]) for k in some) for some in (IDENTIFIERS, SECRETS))

    def near(role: str, codes: str) -> str:
        return f"""coalesce(max(CASE WHEN code IN ({codes}) THEN stop END) OVER (PARTITION BY r ORDER BY start, code, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -{_FAR}) AS {role}_last,
    coalesce(min(CASE WHEN code IN ({codes}) THEN start END) OVER (PARTITION BY r ORDER BY start, code, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), {_FAR}) AS {role}_next"""

    return rf"""
WITH k(code, kind, pattern, least) AS (VALUES {kinds}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  {" UNION ALL ".join(f"SELECT r, {c} AS code, unnest(string_split_regex(text, '{quoted[k]}')) AS gap, unnest(regexp_extract_all(text, '{quoted[k]}')) AS hit, "
    f"unnest({f"regexp_extract_all(text, '{quoted[k]}', 2)" if '(' in quoted[k] else f"regexp_extract_all(text, '{quoted[k]}')"}) AS held, "
    f"generate_subscripts(string_split_regex(text, '{quoted[k]}'), 1) AS pos FROM d" for k, c in _CODE.items())}
), s AS (
  SELECT m.r, m.code, k.kind, hit, held, k.least,
    CAST(sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY m.r, m.code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM m JOIN k ON m.code = k.code WINDOW w AS (PARTITION BY m.r, m.code ORDER BY pos)
), p AS (
  SELECT r, code, kind, start, start + length(hit) AS stop FROM s WHERE hit IS NOT NULL AND length(held) >= least
), o AS (
  SELECT *, {near("base", "0, 1, 2")} FROM p
), a AS (
  SELECT r, code, kind, start, stop FROM o WHERE code < 3 OR (base_last <= start AND base_next >= stop)
), n AS (
  SELECT *, {near("id", ids)}, {near("secret", secrets)} FROM a
), f AS (
  SELECT r, code, kind, start, stop, kind || ':' || start || ':' || stop AS span FROM (
    SELECT *, (id_last >= start - {SCOPE} OR id_next <= stop + {SCOPE}) AS has_id, (secret_last >= start - {SCOPE} OR secret_next <= stop + {SCOPE}) AS has_secret FROM n) q
  WHERE code < 3 OR (code = 3 AND has_secret) OR (code = 4 AND has_id) OR (code = 5 AND has_id AND has_secret)
), g AS (
  SELECT r, count(*) FILTER (code = 0) AS n_assign, count(*) FILTER (code = 1) AS n_access, count(*) FILTER (code = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, code) FILTER (code < 3) AS base, string_agg(span, ',' ORDER BY start, code) AS spans
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r
"""


SQL = _sql()
