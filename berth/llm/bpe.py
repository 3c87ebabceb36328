"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. Every adjacent pair whose joined bytes are
a vocabulary entry waits in the bucket of its rank; three levels of bitmaps over the
ranks tell which bucket is the lowest that holds anything, by find-first-set. Of equal
ranks the leftmost position merges first. Merging leaves stale positions behind; they
are skipped when they come up. A pre-token of n bytes costs O(n log n), so one of a
megabyte is no trouble.

The short pre-tokens that a batch of texts has and the worker does not know yet share
one queue: their lists lie one behind the other, and what a bucket holds, one position
of each pre-token at a time, merges in one numpy step. Pre-tokens don't touch each
other, so each sees its own ranks in its own order. A long one has a queue of its own.

Frames: any DataFrame with the text column. A null text counts as empty: no ids, empty
bytes. Rows keep their number and order of columns; repeated rows are encoded each on
its own. An empty frame stays empty. Output columns replace input columns of the same
name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.llm.common import keeps_columns

#: Known pre-tokens, and bytes of their ids, above which a worker forgets them all before its next batch.
KNOWN, KNOWN_BYTES = 300_000, 32 << 20
#: Pre-tokens that share a queue at most.
SHARED = 150_000
#: Bytes from which a pre-token gets a queue of its own.
LONG = 200
_BITS = 64


class RankQueue:
    """Buckets of positions by rank, and bitmaps that find the lowest rank in use."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        size = n_ranks
        while True:
            size = max(1, -(-size // _BITS))
            self.levels.append([0] * size)
            if size == 1:
                break

    def bucket(self, rank: int) -> list[int]:
        """The bucket of a rank, marked as in use."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for level in self.levels:
                word, bit = divmod(rank, _BITS)
                was = level[word]
                level[word] = was | 1 << bit
                if was:
                    break
                rank = word
        return found

    def lowest(self) -> int:
        """The lowest rank in use, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * _BITS + (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> list[int]:
        """The bucket of a rank, no longer in use."""
        taken = self.buckets.pop(rank)
        for level in self.levels:
            rank, bit = divmod(rank, _BITS)
            level[rank] &= ~(1 << bit)
            if level[rank]:
                break
        return taken


class _Known(dict):
    """Pre-token to its number; a new one gets the next number."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Codec:
    """Ranks of a vocabulary: text to ids, ids to bytes. All single bytes are in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.n_ranks = max(ranks.values()) + 1
        self.regex = regex.compile(pattern)
        self.table = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        cuts = [
            (ranks[token[:i]] * (self.n_ranks + 1) + ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        pairs = np.array(sorted(cuts), np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)
        self.queue = RankQueue(self.n_ranks)
        self.known, self.packed, self.packed_bytes = _Known(), [], 0

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one pre-token of any length."""
        n, ranks, longest, queue = len(piece), self.ranks, self.longest, self.queue
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        waiting = array("q", [-1]) * n  # rank for which the pair that starts here waits

        def offer(left: int) -> None:
            right = after[left]
            waiting[left] = -1
            if right < n and after[right] - left <= longest:
                rank = ranks.get(piece[left : after[right]])
                if rank is not None:
                    waiting[left] = rank
                    heappush(queue.bucket(rank), left)

        for i in range(n - 1):
            offer(i)
        while (rank := queue.lowest()) >= 0:
            bucket = queue.buckets[rank]
            left = heappop(bucket)
            if not bucket:
                queue.take(rank)
            if waiting[left] != rank:
                continue  # stale
            right = after[left]
            waiting[right] = -1
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            if left:
                offer(before[left])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(ids, "<u4")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.n_ranks + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of short pre-tokens, none of them empty, which share one queue."""
        queue, n = self.queue, sum(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        # Position n stands for no neighbour; its id pairs with nothing.
        ids = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], self.n_ranks)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - lengths], after[n], before[n] = n, n, n, n
        waiting = np.append(self._rank(ids[:-1], ids[after[:-1]]), -1)
        live = np.flatnonzero(waiting >= 0)
        live = live[np.argsort(waiting[live], kind="stable")]
        for some in np.split(live, np.flatnonzero(np.diff(waiting[live])) + 1):
            if len(some):
                queue.bucket(int(waiting[some[0]])).extend(some.tolist())
        while (rank := queue.lowest()) >= 0:
            at = np.array(queue.take(rank))
            at = at[waiting[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                first = np.append(True, np.diff(piece_of[at]) != 0)
                if not first.all():  # one of each pre-token; a lower rank may come up in between
                    queue.bucket(rank).extend(at[~first].tolist())
                    at = at[first]
            right = after[at]
            beyond = after[right]
            ids[at], ids[right], waiting[right], after[at], before[beyond] = rank, -1, -1, beyond, at
            before[n] = n
            left = before[at]
            offered = np.append(at, left[left < n])
            ranks = self._rank(ids[offered], ids[after[offered]])
            waiting[offered] = ranks
            for new, position in zip(ranks.tolist(), offered.tolist(), strict=True):
                if new >= 0:
                    queue.bucket(new).append(position)
        kept = ids[:-1] >= 0
        packed, counts = ids[:-1][kept].astype("<u4").tobytes(), np.bincount(piece_of[kept], minlength=len(pieces))
        stops = (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self) -> None:
        """Encode the pre-tokens that have a number and no ids yet."""
        new = islice(self.known, len(self.packed), None)
        while some := [piece.encode() for piece in islice(new, SHARED)]:
            short = [piece for piece in some if len(piece) < LONG]
            merged = iter(self.merge(short) if short else [])
            found = [next(merged) if len(piece) < LONG else self.merge_long(piece).tobytes() for piece in some]
            self.packed += found
            self.packed_bytes += sum(len(piece) for piece in some if len(piece) >= LONG) + sum(map(len, found))

    def _numbers(self, text: str) -> array:
        if len(text) < 1 << 20:
            return array("I", map(self.known.__getitem__, self.regex.findall(text)))
        return array("I", (self.known[m[0]] for m in self.regex.finditer(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if len(self.known) > KNOWN or self.packed_bytes > KNOWN_BYTES:
            self.known, self.packed, self.packed_bytes = _Known(), [], 0
        numbers = [self._numbers(text) if text else () for text in texts]
        self._learn()
        return [b"".join(map(self.packed.__getitem__, some)) for some in numbers]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The vocabulary of this worker, read once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.load(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the text's ids as little-endian unsigned 32-bit integers.

    ``path`` is the rank file, found at the same place on every executor.
    """

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            yield pa.array(own.encode(texts.to_pylist()), pa.binary())

    return docs.withColumn(ids, encoded.asNondeterministic()(docs[text]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the bytes that the ids stand for; null ids give empty bytes."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for packed in batches:
            yield pa.array([own.decode(p or b"") for p in packed.to_pylist()], pa.binary())

    return docs.withColumn(out, decoded.asNondeterministic()(docs[ids]))


@keeps_columns
def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``ids``, and with ``out`` decoded from them in the same pass."""

    @F.arrow_udf("struct<ids: binary, bytes: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            packed = own.encode(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(map(own.decode, packed), pa.binary())], ["ids", "bytes"])

    found = docs.withColumn("__both", both.asNondeterministic()(docs[text]))
    return found.withColumns({ids: F.col("__both.ids"), out: F.col("__both.bytes")}).drop("__both")


@keeps_columns
def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text."""
    out = round_trip(docs, path, pattern, text, "__ids", "__decoded")
    return out.withColumns(
        {
            "n_tokens": (F.octet_length("__ids") / 4).cast("long"),
            "ids_sha256": F.sha2("__ids", 256),
            "decoded_sha256": F.sha2("__decoded", 256),
        }
    ).drop("__ids", "__decoded")
