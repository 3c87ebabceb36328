"""Substring dedup: of every recurring passage the earliest occurrence stays.

Units are normalised (A-Z to lower case, white space to single spaces) and digested. A
digest that occurs more than once keeps its earliest occurrence: by key, null last, then
digest of the text, then position. All others are repeats. What repeats cover without a
gap is a passage if it has ``RUN_WORDS`` words or more and is cut out; a shorter one, such
as a heading or a licence line, stays. The offsets of what is cut refer to the original
text, in characters. Units are

* ``window``: runs of ``WINDOW`` words that stand anywhere. Of any ``NEAR`` successive runs
  the one with the smallest digest is a unit, so every repeated passage of
  ``WINDOW + NEAR - 1`` words holds the same unit wherever it stands, whatever the line
  breaks, and units overlap. At either end ``NEAR - 1`` words of a passage at most stay.
* ``line``: what stands between two newlines; blank lines end no passage.
* ``piece``: words up to the first one, from the ``PIECE_WORDS``th on, that ends in a
  sentence mark or whose digest falls in one of ``ENDS`` of 256 parts. The words of a passage
  before its first such end and after its last share a piece with what stands beside it
  and stay.

The earliest occurrence comes from a minimum that Spark combines before it shuffles, and
only digests that recur meet the units again, in a join whose hot keys Spark splits. What
is gathered per document is bounded by the document.

A null text stays null and has no units; an empty one stays empty. Rows that agree in key
and text share one rank: what the earliest document of a passage keeps, all its equal
rows keep. Other columns pass through ``remove`` untouched, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import unused
from berth.session import durable

RUN_WORDS = 28
#: Words of a window, and successive windows of which one at least is a unit.
WINDOW, NEAR = 12, 12
#: Least words of a piece, and in how many of 256 parts the digest of a word ends one.
PIECE_WORDS, ENDS = 4, 32
KNOWN = 300_000
_SENTENCE = tuple(m.encode() for m in ".!?;:…。！？；：")
_word_spans = re.compile(r"[^\x20\x09-\x0D]+").finditer
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT = "struct<text: string, n_units: bigint, n_removed: bigint, starts: array<bigint>, ends: array<bigint>>"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[\x09-\x0D\x20]+", " "))


def _units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that are not blank: digest, rank and document."""
    lines = docs.select(docs[key].alias("__key"), F.xxhash64(docs[text]).alias("__hash"), F.posexplode(F.split(docs[text], "\n")).alias("__pos", "__line"))
    lines = lines.withColumn("__line", _normal(F.col("__line"))).where("__line <> ''")
    rank = F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__hash").alias("h"), F.col("__pos").alias("p"))
    return lines.select(F.xxhash64("__line").alias("__d1"), F.xxhash64(F.lit("line"), "__line").alias("__d2"), rank.alias("__rank"))


class _Ends(dict):
    """Whether a word (lower case, bytes) ends a piece."""

    def __missing__(self, word: bytes) -> bool:
        ends = word.endswith(_SENTENCE) or (xxhash.xxh32_intdigest(word) & 255) < ENDS
        if len(self) >= KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = ends
        return ends


def piece_ends(words: list[bytes], known: dict) -> list[int]:
    """Number of words up to the end of each piece."""
    out, last = [], 0
    for i, ends in enumerate(map(known.__getitem__, words), 1):
        if ends and i - last >= PIECE_WORDS:
            out.append(i)
            last = i
    return out if last == len(words) else [*out, len(words)]


class _Numbers(dict):
    """64-bit number of a word (lower case, bytes)."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64 and len(self) < KNOWN:
            self[word] = found
        return found


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(words: list[bytes], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two digests and the first word of each unit among the windows of a text."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    first, second = np.full(n, 1, np.uint64), np.full(n, 2, np.uint64)
    for i in range(WINDOW):
        part = numbers[i : i + n]
        first, second = _scattered(first ^ part), _scattered(second + part)
    near = np.lib.stride_tricks.sliding_window_view(first, min(NEAR, n))
    chosen = np.unique(near.argmin(1) + np.arange(len(near)))
    return first[chosen].astype(np.int64), second[chosen].astype(np.int64), chosen


def pieces(words: list[bytes], known: dict) -> tuple[list[int], list[int], range]:
    """Two digests and the number of each piece of a text."""
    at, first, second = 0, [], []
    for end in piece_ends(words, known):
        digest = xxhash.xxh3_128_digest(b" ".join(words[at:end]))
        first.append(int.from_bytes(digest[:8], "big", signed=True))
        second.append(int.from_bytes(digest[8:], "big", signed=True))
        at = end
    return first, second, range(len(first))


_KINDS = {"window": (windows, _Numbers), "piece": (pieces, _Ends)}


def _digests(unit: str):
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, memory = _KINDS[unit]
        known = memory()
        for texts in batches:
            found = [find((t or "").encode().lower().split(), known) for t in texts.to_pylist()]
            sizes = np.cumsum([0] + [len(p) for _, _, p in found])
            columns = [pa.array(np.concatenate([np.asarray(f[i], np.int64) for f in found] or [np.zeros(0, np.int64)])) for i in range(3)]
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["d1", "d2", "p"]))

    return digests


def _hashed(unit: str):
    def units(docs: DataFrame, key: str, text: str) -> DataFrame:
        """Windows or pieces of the words: digests and rank."""
        digests = F.arrow_udf(_digests(unit), "array<struct<d1: bigint, d2: bigint, p: bigint>>").asNondeterministic()
        found = docs.select(docs[key].alias("__key"), F.xxhash64(docs[text]).alias("__hash"), digests(docs[text]).alias("__found"))
        found = found.select("__key", "__hash", F.explode("__found").alias("__d"))
        rank = F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__hash").alias("h"), F.col("__d.p").cast("int").alias("p"))
        return found.select(F.col("__d.d1").alias("__d1"), F.col("__d.d2").alias("__d2"), rank.alias("__rank"))

    return units


def _cut(passages: Callable, run_words: int):
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, repeats in batches:
            found = [passages(t, r, run_words) for t, r in zip(texts.to_pylist(), repeats.to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text", "n_units", "n_removed", "starts", "ends"])

    return cut


def passages(text: str | None, repeats: list[int] | None, run_words: int = RUN_WORDS) -> tuple:
    """Text without the passages among the repeated lines; lines, lines cut, offsets of these."""
    if text is None:
        return None, 0, 0, [], []
    lines, again = text.split("\n"), set(repeats or ())
    sizes = [len(line.encode().split()) for line in lines]
    cut, run = set(), []
    for i in [*(i for i, n in enumerate(sizes) if n), -1]:
        if i in again:
            run.append(i)
            continue
        if sum(sizes[j] for j in run) >= run_words:
            cut.update(run)
        run = []
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    gone = sorted(cut)
    kept = "\n".join(line for i, line in enumerate(lines) if i not in cut) if cut else text
    return kept, sum(n > 0 for n in sizes), len(cut), [starts[i] for i in gone], [starts[i] + len(lines[i]) for i in gone]


def piece_passages(text: str | None, repeats: list[int] | None, run_words: int = RUN_WORDS) -> tuple:
    """Text without the passages among the repeated pieces; pieces, pieces cut, offsets of the passages."""
    if text is None:
        return None, 0, 0, [], []
    ends, again = piece_ends(text.encode().lower().split(), _Ends()), set(repeats or ())
    runs, cut, run = [], 0, []
    for i in range(len(ends) + 1):
        if i in again:
            run.append(i)
            continue
        first = ends[run[0] - 1] if run and run[0] else 0
        if run and ends[run[-1]] - first >= run_words:
            runs.append((first, ends[run[-1]] - 1))
            cut += len(run)
        run = []
    if not runs:
        return text, len(ends), 0, [], []
    spans = [m.span() for m in _word_spans(text)]
    starts, stops = [spans[a][0] for a, _ in runs], [spans[b][1] for _, b in runs]
    kept = "".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True))
    return kept, len(ends), cut, starts, stops


def window_passages(text: str | None, repeats: list[int] | None, run_words: int = RUN_WORDS) -> tuple:
    """Text without the passages that repeated windows cover; words, words cut, offsets of the passages."""
    if text is None:
        return None, 0, 0, [], []
    runs: list[list[int]] = []
    for at in sorted(set(repeats or ())):
        if runs and at <= runs[-1][1]:
            runs[-1][1] = at + WINDOW
        else:
            runs.append([at, at + WINDOW])
    runs = [run for run in runs if run[1] - run[0] >= run_words]
    if not runs:
        return text, len(text.encode().split()), 0, [], []
    spans = [m.span() for m in _word_spans(text)]
    starts, stops = [spans[a][0] for a, _ in runs], [spans[b - 1][1] for _, b in runs]
    kept = "".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True))
    return kept, len(spans), sum(b - a for a, b in runs), starts, stops


UNITS = {"window": (_hashed("window"), window_passages), "line": (_units, passages), "piece": (_hashed("piece"), piece_passages)}


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, unit: str = "window", out: str = "cut") -> DataFrame:
    """``docs`` with ``out``: the text that stays, n_units (words of windows), n_removed, and starts and ends of what goes."""
    find, cut_out = UNITS[unit]
    units = find(docs, key, text)
    # narrow counts first: only units whose digest recurs are carried with their ranks
    recurs = durable(units.groupBy("__d1").agg(F.count("*").alias("n")).where("n > 1").select("__d1"))
    units = durable(units.join(recurs, "__d1", "left_semi"))
    first = durable(units.groupBy("__d1", "__d2").agg(F.min("__rank").alias("__first")))  # written, so that Spark may split the join's hot keys
    again = units.join(first, ["__d1", "__d2"]).where(F.col("__rank") != F.col("__first"))
    k, h, k2, h2, places = unused(docs, "__key", "__hash", "__key_", "__hash_", "__again")
    again = again.groupBy(F.col("__rank.k").alias(k2), F.col("__rank.h").alias(h2)).agg(F.collect_list("__rank.p").alias(places))
    keyed = docs.withColumns({k: docs[key], h: F.xxhash64(docs[text])})
    joined = keyed.join(again, F.col(k).eqNullSafe(F.col(k2)) & (F.col(h) == F.col(h2)), "left")
    cut = F.arrow_udf(_cut(cut_out, run_words), _CUT).asNondeterministic()
    return joined.withColumn(out, cut(F.col(text), F.col(places))).drop(k, h, k2, h2, places)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, unit: str = "window") -> DataFrame:
    """The documents, without their repeated passages."""
    (cut,) = unused(docs, "__cut")
    out = annotate(docs, key, text, run_words, unit, cut)
    return out.select(*[F.col(f"{cut}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, unit: str = "window") -> DataFrame:
    """Per document: key, whether it is changed, n_units, n_removed, removed (start:end, ...) and the text that stays."""
    spans = F.array_join(F.zip_with("__cut.starts", "__cut.ends", lambda a, b: F.concat_ws(":", a, b)), ",")
    out = annotate(docs.select(key, text), key, text, run_words, unit, "__cut")
    return out.select(key, (F.col("__cut.n_removed") > 0).alias("changed"), "__cut.n_units", "__cut.n_removed", spans.alias("removed"), "__cut.text")


SQL = rf"""
WITH l AS (
  SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS r FROM documents) d
), n AS (
  SELECT *, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm,
    sum(length(line) + 1) OVER (PARTITION BY r ORDER BY pos) - length(line) - 1 AS start FROM l
), u AS (
  SELECT r, pos, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY r ORDER BY pos) AS o,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id, r, pos) > 1 AS again FROM n WHERE norm <> ''
), g AS (
  SELECT *, o - row_number() OVER (PARTITION BY r, again ORDER BY o) AS run FROM u
), c AS (
  SELECT r, pos, again AND sum(words) OVER (PARTITION BY r, again, run) >= {RUN_WORDS} AS cut FROM g
), a AS (
  SELECT n.r, count(c.pos) AS n_units, count(*) FILTER (c.cut) AS n_removed,
    coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(line) AS BIGINT), ',' ORDER BY n.pos) FILTER (c.cut), '') AS removed,
    coalesce(string_agg(line, chr(10) ORDER BY n.pos) FILTER (NOT coalesce(c.cut, false)), '') AS text
  FROM n LEFT JOIN c ON n.r = c.r AND n.pos = c.pos GROUP BY n.r
)
SELECT d.doc_id, coalesce(n_removed, 0) > 0 AS changed, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, a.text
FROM (SELECT *, row_number() OVER () AS r FROM documents) d LEFT JOIN a ON d.r = a.r
"""
