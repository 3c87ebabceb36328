"""Jaccard join on word shingles: a partition of the universe, pigeonholes, exact checks.

A document's set is its distinct five-word shingles. Equal sets are one class; classes
are joined, documents get their class's component. Sizes fall into bands that double. A
band hashes shingles into m segments, so every set becomes m subsets. Two sets of a band
with Jaccard 0.8 or more differ in H shingles at most, so m - H subsets or more are equal.

* Of m > H + 1 subsets each set indexes its H + 1 cheapest, by how often they occur, the
  subset itself breaking ties. The cheapest subset that two similar sets share is among
  those that both index, so nothing is lost, and empty or very common subsets, such as
  those of a passage that many documents hold, are left out wherever there is a choice.
* In the bands of small sets, m = H // 2 + 1 subsets with their one-deletion neighbourhoods
  do as well: one subset differs in one shingle at most. Which of the two a band uses is
  decided by estimated cost: rows to index and pairs to check.

The frequencies come from a sketch of fixed size over all documents. Its errors cost time,
never a pair, as both sides of a pair see the same numbers.

Classes that share a subset are candidates. In each bucket all are first compared with the
bucket's lead, the class with the fewest subsets cheaper than the shared one: what a class has
of its own is cheap, so the lead is what the others are copies of. What is alike forms
components. Then only classes of different components within a bucket are compared, those
outside the bucket's largest component with all others. Pairs whose sizes or marks (a bit for
each of ``MARKS`` parts of the universe, set if its shingles are odd in number) differ too much
are never made, and those whose profiles (the same for about as many parts as shingles) do are
dismissed, which no similar pair is; all others are checked on whole sets. So the rows of a group
of near copies are as many as its members and links; meeting in a bucket is still a comparison
of marks for each pair across components. Buckets that the sketch shows to be large are split by
salt for the first comparison.

Shingles are compared as 64-bit hashes and classes known by 64 bits; at 10^10 classes a
collision in the latter becomes likely, then widen them. A null or empty text has no
shingles and links with nothing, not even its like. Repeated rows share a class. A null key
is no component's smallest unless all its keys are null. Other columns pass through
``deduplicate`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from berth.llm.common import keeps_columns
from berth.llm.components import components
from berth.session import durable

SHINGLE = 5
#: Cells of the sketch; of each small band and way; ids above which a worker's memory of words starts anew.
CELLS, SMALL_CELLS, KNOWN = 1 << 18, 1 << 14, 100_000
#: Fewest parts of the universe in a profile, a power of two; those of the marks that pairs are made by, a multiple of 64.
PARTS, MARKS = 64, 512
#: Largest size for which one-deletion neighbourhoods are weighed against more segments.
SMALL = 15
#: Estimated classes in a bucket above which it is salted.
HOT = 2000
_CHUNK = 1 << 12
#: Numbers that a task gathers before it hands them on.
_PIECE = 1 << 17
#: Bits of the map that tells which texts are asked for.
_BITS = 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) > KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(SHINGLE, n)
    if not width:
        return hashed
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total ^ hashed[i : n - width + 1 + i])
    return np.unique(total)


def profile(some: np.ndarray) -> bytes:
    """Whether each part of the universe holds an odd number of shingles. Two sets differ at least as much as their profiles."""
    parts = max(PARTS, 1 << (len(some) - 1).bit_length())
    odd = np.bincount((some % np.uint64(parts)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def marks(some: np.ndarray) -> np.ndarray:
    """The profile in ``MARKS`` parts, as 64-bit numbers."""
    odd = np.bincount((some % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differences(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Bits in which pairs of profiles differ; the longer of two is folded to the parts of the shorter."""
    widths = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    found = np.zeros(len(widths), np.int64)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        x, y = (_folded([side[i] for i in at], width) for side in (left, right))
        found[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return found


def _folded(profiles: list[bytes], width: int) -> np.ndarray:
    same = [np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, width)) for p in profiles]
    return np.stack(same)


def class_id(some: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(some.tobytes())).astype(np.int64))


def _most(a: int, b: int) -> int:
    """Shingles in which two similar sets of these sizes differ at most."""
    return (a + b) // 9


class Scheme:
    """Signatures of sets, given the frequencies of subsets once they are known."""

    def __init__(self, sketch: np.ndarray | None = None):
        self.sketch = sketch
        self.deletions = set()
        if sketch is not None:
            for band in range(2, SMALL.bit_length()):
                cost = [float((c := sketch[self._small(band, way)].astype(np.float64)).sum() + (c * (c - 1)).sum() / 2) for way in (0, 1)]
                if cost[1] < cost[0]:
                    self.deletions.add(band)

    @staticmethod
    def _small(band: int, way: int) -> slice:
        start = CELLS + (2 * band + way) * SMALL_CELLS
        return slice(start, start + SMALL_CELLS)

    @staticmethod
    def width() -> int:
        return CELLS + 2 * SMALL.bit_length() * SMALL_CELLS

    @staticmethod
    def bands(size: int) -> list[int]:
        """The band of a size, and the next if a similar larger set can be there; none if only equal sets are similar."""
        own, largest = size.bit_length() - 1, size * 5 // 4
        if largest == size:
            return []
        return [own, own + 1] if largest >= 2 << own else [own]

    @staticmethod
    def subsets(some: np.ndarray, band: int, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each segment's subset, and each shingle's segment and its part of the hash."""
        top = (2 << band) - 1
        m = _most(top, top) // 2 + 1 if way else _most(top, top) + 1 + max(1, top // 16)
        salted = _mix(some ^ np.uint64(2 * band + way))
        segment = (salted >> np.uint64(33)).astype(np.int64) % m
        part = _mix(salted)
        order = np.argsort(segment)
        sorted_segment = segment[order]
        first = np.flatnonzero(np.append(True, sorted_segment[1:] != sorted_segment[:-1]))
        sums = np.zeros(m, np.uint64)
        sums[sorted_segment[first]] = np.add.reduceat(part[order], first)
        return sums, segment, part

    @staticmethod
    def _signed(sums: np.ndarray, segment: np.ndarray, band: int, way: int) -> np.ndarray:
        return _mix(sums ^ _mix(segment.astype(np.uint64) * np.uint64(128) + np.uint64(2 * band + way)))

    def all_signatures(self, some: np.ndarray, band: int, way: int) -> np.ndarray:
        sums, segment, part = self.subsets(some, band, way)
        signs = self._signed(sums, np.arange(len(sums)), band, way)
        return np.append(signs, self._signed(sums[segment] - part, segment, band, way)) if way else signs

    def cells(self, some: np.ndarray) -> np.ndarray:
        """Cells of the sketch in which a set's subsets count."""
        found = [np.zeros(0, np.int64)]
        for band in self.bands(len(some)):
            signs = self.all_signatures(some, band, 0)
            found.append((signs % np.uint64(CELLS)).astype(np.int64))
            if band < SMALL.bit_length():
                for way in (0, 1):
                    small = signs if not way else self.all_signatures(some, band, 1)
                    found.append(self._small(band, way).start + (small % np.uint64(SMALL_CELLS)).astype(np.int64))
        return np.concatenate(found)

    def signatures(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a set indexes, how often each is seen, by the sketch, and how many of its band are cheaper."""
        found, seen, ranks = [], [], []
        for band in self.bands(len(some)):
            way = int(band in self.deletions)
            signs = self.all_signatures(some, band, way)
            often = self.sketch[(signs % np.uint64(CELLS)).astype(np.int64)]
            cheapest = np.lexsort((signs, often))
            if not way:
                top = min((2 << band) - 1, len(some) * 5 // 4)
                cheapest = cheapest[: _most(len(some), top) + 1]
            found.append(signs[cheapest])
            seen.append(often[cheapest])
            ranks.append(np.arange(len(cheapest), dtype=np.int32))
        return (np.concatenate(found), np.concatenate(seen), np.concatenate(ranks)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32))


def _row(docs: DataFrame, key: str, text: str) -> Column:
    """Digest that only rows with equal key and text share."""
    return F.xxhash64(docs[key].cast("long"), docs[key].isNull(), docs[text].cast("string"))


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Scheme]:
    """Class and size of every document, and the scheme with its sketch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, scheme, seen = np.zeros(Scheme.width(), np.uint32), Scheme(), set()
        names = ["key", "row", "cid", "n", "profile", "marks", "chunk", "counts"]
        for batch in batches:
            ids, sizes, profiles, marked, counted, held = [], [], [], [], [np.zeros(0, np.int64)], 0
            for t in batch.column(2):
                some = shingles(t.as_py())
                cid = class_id(some) if len(some) else None
                ids.append(cid)
                sizes.append(len(some))
                profiles.append(profile(some) if len(some) else None)
                marked.append(marks(some))
                if len(some) and cid not in seen:
                    seen.add(cid)
                    counted.append(scheme.cells(some))
                    held += len(counted[-1])
                    if held > _PIECE:
                        cells += np.bincount(np.concatenate(counted), minlength=len(cells)).astype(np.uint32)
                        counted, held = [np.zeros(0, np.int64)], 0
            cells += np.bincount(np.concatenate(counted), minlength=len(cells)).astype(np.uint32)
            found = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(profiles, pa.binary()), pa.array(marked, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
        parts = [i for i in range(0, len(cells), _CHUNK) if cells[i : i + _CHUNK].any()]
        none = [pa.nulls(len(parts), pa.int64())] * 4 + [pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.list_(pa.int64()))]
        counts = pa.array([cells[i : i + _CHUNK].astype("<u4").tobytes() for i in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([*none, pa.array(parts, pa.int32()), counts], names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4")
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([s.astype("<u4").tobytes() for s in sums.values()], pa.binary())})

    rows = docs.select(docs[key].cast("long"), _row(docs, key, text), docs[text].cast("string"))
    rows = durable(rows.mapInArrow(task, "key long, row long, cid long, n long, profile binary, marks array<long>, chunk int, counts binary"))
    cells = np.zeros(Scheme.width(), np.uint32)
    sketch = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(added, "chunk int, counts binary")
    for r in sketch.collect():  # of fixed size: at most ``width`` cells
        cells[r["chunk"] : r["chunk"] + _CHUNK] = np.frombuffer(r["counts"], "<u4")
    return rows.where("chunk is null").select("key", "row", "cid", "n", "profile", "marks"), Scheme(cells)


def _index(docs: DataFrame, text: str, scheme: Scheme) -> DataFrame:
    """Members of buckets with two classes or more: sign, salt, cid, and the first cid of sign and salt by rank, and its rank."""
    shared = docs.sparkSession.sparkContext.broadcast(scheme)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, set()
        for batch in batches:
            pieces, held = [], 0
            for t in batch.column(0):
                some = shingles(t.as_py())
                cid = class_id(some) if len(some) else None
                if cid is None or cid in seen:
                    continue
                seen.add(cid)
                found, often, ranks = own.signatures(some)
                salts = np.where(often > HOT, np.abs(cid) % (1 + often // HOT), -1).astype(np.int32)
                pieces.append((found.astype(np.int64), np.full(len(found), cid, np.int64), ranks, salts))
                held += len(found)
                if held > _PIECE:
                    yield _together(pieces)
                    pieces, held = [], 0
            if pieces:
                yield _together(pieces)

    signs = docs.select(docs[text].cast("string")).mapInArrow(task, "sign long, cid long, rank int, salt int")  # in this order they shuffle smallest
    bucket = Window.partitionBy("sign", "salt").orderBy("rank", "cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    signs = signs.withColumns({"lead": F.first("cid").over(bucket), "least": F.first("rank").over(bucket), "last": F.last("cid").over(bucket)})
    return durable(signs.where("lead <> last or salt >= 0").drop("rank", "last"))


def _together(pieces: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pieces, strict=True)], ["sign", "cid", "rank", "salt"])


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and profiles allow for Jaccard 0.8 or more."""

    def check(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for n, m, left, right in batches:
            yield pa.array(differences(left.to_pylist(), right.to_pylist()) <= _most(n.to_numpy(), m.to_numpy()), pa.bool_())

    for side, size, counts in (("a", "n_", None), ("b", "m_", None), ("a", None, "x"), ("b", None, "y")):
        # sizes first, as they are narrow
        column = F.col("n").alias(size) if size else F.col("profile").alias(counts)
        pairs = pairs.join(classes.select(F.col("cid").alias(side), column), side)
        if size == "m_":
            pairs = pairs.where(_sizes_fit("n_", "m_"))
    near = F.arrow_udf(check, "boolean").asNondeterministic()("n_", "m_", "x", "y")
    return durable(pairs.where(near).select("a", "b"))


def _sizes_fit(n: str, m: str) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * 80


def _marks_fit() -> Column:
    """Whether the marks (m0, ... and m0_, ...) of sets of n and n_ shingles allow for Jaccard 0.8 or more."""
    differ = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"m{i}_"))) for i in range(MARKS // 64)), F.lit(0))
    return differ * 9 <= F.col("n") + F.col("n_")


def _asked(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``rows`` without most of those whose digest (row) is no row_ of ``needed``, by a bit map of fixed size, so their texts are not shuffled."""
    cell = lambda row: F.pmod(F.col(row), F.lit(_BITS))
    bits = needed.groupBy(F.bitmap_bucket_number(cell("row_")).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell("row_"))).alias("bits"))
    at = F.bitmap_bit_position(cell("row"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(cell("row")) == F.col("part")) & hit, "left_semi")


def _alike(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) with Jaccard 0.8 or more, on the sets of the classes' first documents."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, held, begun = [], 0, 0
            for t in batch.column(1):
                some.append(shingles(t.as_py()).tobytes())
                held += len(some[-1])
                if held > 8 * _PIECE or begun + len(some) == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(some)), pa.array(some, pa.binary())], ["cid", "some"])
                    some, held, begun = [], 0, begun + len(some)

    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            found = []
            for a, b in zip(left, right, strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                found.append(100 * common >= 80 * (len(both) - common))
            yield pa.array(found, pa.bool_())

    near = _near(pairs, classes)
    needed = near.select(F.col("a").alias("cid")).union(near.select("b")).distinct()
    needed = durable(classes.select("cid", F.col("row").alias("row_")).join(needed, "cid"))
    rows = docs.select(_row(docs, key, text).alias("row"), docs[text].cast("string").alias("text"))
    rows = _asked(rows, needed).join(needed, F.col("row") == F.col("row_")).groupBy("row", "cid").agg(F.first("text").alias("text"))
    sets = durable(rows.select("cid", "text").mapInArrow(packed, "cid long, some binary"))
    left, right = sets.withColumnsRenamed({"cid": "a", "some": "x"}), sets.withColumnsRenamed({"cid": "b", "some": "y"})
    rows = near.join(left, "a").join(right, "b")
    return durable(rows.where(F.arrow_udf(check, "boolean").asNondeterministic()("x", "y")).select("a", "b"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, a written table: key, cid, n (size of its set) and root (of its component of classes, or null)."""
    rows, scheme = _classes(docs, key, text)
    members = _index(docs, text, scheme)
    first = F.min(F.struct(F.col("key").isNull().alias("i"), F.col("key").alias("k"), "row", "n", "profile", "marks"))
    classes = rows.where("cid is not null").groupBy("cid").agg(first.alias("f")).select("cid", "f.row", "f.n", "f.profile", "f.marks")
    classes = durable(classes.join(members.select("cid").distinct(), "cid"))
    stars = members.select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    leads = members.where("salt >= 0").groupBy("sign").agg(F.min(F.struct("least", "lead"))["lead"].alias("a"), F.collect_set("lead").alias("b")).select("a", F.explode("b").alias("b"))
    stars = durable(stars.union(leads).where("a <> b").distinct())
    linked = _alike(stars, classes, docs, key, text)
    roots = components(linked)
    sizes = classes.select(F.col("cid").alias("node"), "n")
    placed = _rooted(members.select("sign", "cid").distinct(), roots).join(sizes, F.col("cid") == F.col("node")).drop("node")
    placed = durable(placed)
    counts = placed.groupBy("sign", "root").agg(F.count("*").alias("c"))
    mixed = durable(counts.groupBy("sign").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("k")).where("k > 1").drop("k"))
    marked = classes.select(F.col("cid").alias("node"), *[F.col("marks")[i].alias(f"m{i}") for i in range(MARKS // 64)])
    within = placed.join(mixed, "sign")
    within = durable(within.join(marked, F.col("cid") == F.col("node")).drop("node"))
    other = within.drop("major").withColumnsRenamed({c: f"{c}_" for c in within.columns if c != "sign"})
    minor = within.where("root <> major")
    pairs = minor.join(other, "sign").where(_sizes_fit("n", "n_") & _marks_fit() & (F.col("root") != F.col("root_")) & ((F.col("root_") == F.col("major")) | (F.col("cid") < F.col("cid_"))))
    pairs = pairs.select(F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b")).distinct()
    pairs = durable(pairs.join(stars, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        roots = components(linked.union(_alike(pairs, classes, docs, key, text)))
    return durable(_rooted(rows.select("key", "cid", "n"), roots))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key reachable) and cid (its class)."""
    found = link(docs, key, text)
    smallest = durable(found.where("root is not null").groupBy("root").agg(F.min("key").alias("component")).withColumnRenamed("root", "root_"))
    found = found.join(smallest, F.col("root") == F.col("root_"), "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"), "cid")


@keeps_columns
def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest key, with all its columns; all documents without words."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shingles(t) for t in texts.to_pylist()]
            yield pa.array([class_id(some) if len(some) else None for some in found], pa.int64())

    found = link(docs, key, text).where("root is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), "cid")).alias("f")
    kept = durable(found.groupBy("root").agg(first).select(F.col("f.k").alias("__k"), F.col("f.cid").alias("__c")))
    rows = docs.withColumns({"__key": docs[key].cast("long"), "__cid": F.arrow_udf(ids, "long").asNondeterministic()(docs[text].cast("string"))})
    wordless = rows.where("__cid is null").select(*docs.columns)
    rows = rows.join(kept, (F.col("__cid") == F.col("__c")) & F.col("__key").eqNullSafe(F.col("__k")), "left_semi")
    return rows.dropDuplicates(["__key", "__cid"]).select(*docs.columns).unionByName(wordless)
