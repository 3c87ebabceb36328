"""Fill-in-middle: a text is cut into prefix, middle and suffix and put together in another order.

A text is cut into units, words (a run of ASCII letters, or any other single code point)
or characters (code points). Two numbers modulo the units and one give the cuts. Forms:
``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle, ``plain`` the
text itself, taken for a share of the rows and for texts that are empty or hold a mark.
No piece holds a mark and no mark overlaps itself or another, so ``restore`` finds the
pieces again from output and form alone.

A batch of texts stays the UTF-8 bytes that Arrow holds. Between its bytes and its code
points stands a sparse index (``Exceptions``): the positions of the characters of several
bytes, and how many bytes each has beyond one. A cut is converted by one binary search in
it; across ASCII spans it is plain arithmetic, and no text is decoded.

The numbers come from a digest of seed and key, so reruns and lost executors change
nothing; equal rows give equal results. A null text counts as empty, a row with a null key
stays plain, an empty table gives an empty result. Other columns pass through, whatever
their names; a column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import unused

#: Fixed values of the forms: marks, percent of rows with a form other than plain, percent of these in spm.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMED, SPM = 90, 20
#: Bytes of text that are worked on at a time; a longer text is a part of its own.
PART = 2 << 20
_OUT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


class Exceptions:
    """Sparse index of UTF-8 bytes: the characters of several bytes, and their bytes beyond one."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])
        self.chars_at = self.at - self.excess[:-1]

    def chars(self, bytes_: np.ndarray) -> np.ndarray:
        """Code points before each byte position, the start of a character or the end."""
        return bytes_ - self.excess[np.searchsorted(self.at, bytes_)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte position of each code point."""
        return chars + self.excess[np.searchsorted(self.chars_at, chars)]


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and ends."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _in_parts(work):
    """The work on batches, done in parts of about ``PART`` bytes: positions take several times the bytes."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch[0]), 0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PART)) + 1).tolist(), len(sizes)]
            done = [work(*(column.slice(a, b - a) for column in batch)) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.concat_arrays(done)

    return run


def cuts(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "word") -> tuple[np.ndarray, ...]:
    """Units of each text, the bytes at which its middle begins and ends, and the code points of prefix and middle."""
    index = Exceptions(data)
    begin, end = bounds[:-1], bounds[1:]
    if unit == "word":
        lower = data | 0x20
        letter = (lower >= 0x61) & (lower <= 0x7A)
        inner = np.zeros(len(data), bool)
        inner[1:] = letter[1:] & letter[:-1]
        inner[begin[begin < len(data)]] = False
        starts = np.append(np.flatnonzero(~inner & ((data & 0xC0) != 0x80)), len(data))
        lowest = np.searchsorted(starts[:-1], bounds)
        n = np.diff(lowest)
    else:
        lowest = index.chars(bounds)
        n = np.diff(lowest)
    a, b = first % (n + 1), second % (n + 1)
    units = np.minimum(a, b), np.maximum(a, b)
    if unit == "word":  # the unit after the last one of a text starts where the text ends
        low, high = (np.minimum(starts[lowest[:-1] + k], end) for k in units)
    else:
        low, high = (index.bytes(lowest[:-1] + k) for k in units)
    chars = index.chars(low)
    return n, low, high, chars - index.chars(begin), index.chars(high) - chars


def _text(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def _formed(unit: str):
    def formed(texts: pa.Array, *numbers: pa.Array) -> pa.Array:
        data, bounds = _utf8(texts)
        plain = ~np.asarray(numbers[0].is_valid())
        h = [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in numbers]
        n, low, high, prefix, middle = cuts(data, bounds, h[0], h[1], unit)
        plain |= (h[2] % 100 >= FORMED) | (n == 0)
        spm, whole, forms, outputs = h[3] % 100 < SPM, data.tobytes(), [], []
        for i, (begin, end, a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), low.tolist(), high.tolist(), strict=True)):
            if not plain[i]:
                plain[i] = any(whole.find(mark, begin, end) >= 0 for mark in (PREFIX, SUFFIX, MIDDLE))
            if plain[i]:
                forms.append("plain")
                outputs.append(whole[begin:end])
                continue
            head, tail = PREFIX + whole[begin:a], SUFFIX + whole[b:end]
            forms.append("spm" if spm[i] else "psm")
            outputs.append((tail + head if spm[i] else head + tail) + MIDDLE + whole[a:b])
        columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _text(outputs)]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return _in_parts(formed)


def _rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    data, bounds = _utf8(outputs)
    whole, texts = data.tobytes(), []
    for begin, end, form in zip(bounds[:-1].tolist(), bounds[1:].tolist(), forms.to_pylist(), strict=True):
        if form not in ("psm", "spm"):
            texts.append(whole[begin:end])
            continue
        second = whole.index(SUFFIX if form == "psm" else PREFIX, begin + len(PREFIX), end)
        third = whole.index(MIDDLE, second + len(SUFFIX), end)
        one, two, middle = whole[begin + len(PREFIX) : second], whole[second + len(SUFFIX) : third], whole[third + len(MIDDLE) : end]
        texts.append(one + middle + two if form == "psm" else two + middle + one)
    return _text(texts)


def numbers(key: str, seed: str = "1") -> list[Column]:
    """Four numbers of a row, from the digest of seed and key; null for a null key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", unit: str = "word") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""
    if unit not in ("word", "char"):
        raise ValueError(f"unit {unit!r} is neither word nor char")
    (made,) = unused(docs, "__made")
    udf = F.arrow_udf(_formed(unit), _OUT).asNondeterministic()
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in results]
    return docs.withColumn(made, udf(F.col(f"`{text}`"), *numbers(key, seed))).select(*kept, *[F.col(f"{made}.{r}") for r in results])


def restore(docs: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """``docs`` with ``out``: the text that output and form were made of."""
    return docs.withColumn(out, F.arrow_udf(_in_parts(_rebuilt), "string").asNondeterministic()(F.col(f"`{output}`"), F.col(f"`{form}`")))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n, form, prefix_chars, middle_chars and the digests of output and rebuilt text."""
    out = restore(transform(docs.select(F.col(key), F.col(text)), key, text))
    return out.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS d FROM documents
), h AS (
  SELECT *, len(u) AS n, {", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FORMED} THEN 'plain'
      WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
