"""Token ids in files of independent zstandard frames, read document by document.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers,
in frames of ``FRAME_IDS`` ids at most, each compressed on its own. Two skippable frames
follow: the documents (ids of the rows, counts of their ids, compressed) and, last, the
seek table: for each frame its compressed size, its size and a checksum, then the number
of frames, a flag byte and a magic number. That is the seekable form of zstandard files,
so ``zstd -d`` reads the ids as well. A reader takes the end of the file, then only the
frames that hold what it is asked for, and compares their checksums.

Documents are dealt by ranges of their key and sorted within a range; each task writes
one file, a frame at a time, under a name of its own attempt, and moves it to its final
name when it is complete: a task that runs again leaves the same file. How many ids lie
before a file comes from the manifest, which has one row per file.

A null text counts as empty and has the end id alone. Documents with a null key come
first; repeated rows are written each. An empty table gives no files and an empty
manifest. Only key and text are read, whatever else the table has.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from berth.session import durable, scratch

FRAME_IDS, LEVEL = 1 << 18, 3
#: Words of a generation that a worker keeps.
KNOWN = 300_000
#: Fixed values of the seekable form.
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC, FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _HEAD, _FOOT = struct.Struct("<III"), struct.Struct("<II"), struct.Struct("<IBI")

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


#: The normalisation and the split for which words are encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class Parts(dict):
    """Ids of a part of a word: letters, a digit, or marks, in lower case."""

    letters = _byte_letters()

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        found = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(part) <= 64 and len(self) < KNOWN:
            self[part] = found
        return found


class WordIds(dict):
    """Ids of what stands between white space, by the tokenizer, each new one once.

    The tokenizer drops white space and nothing in it looks across, so the ids of a text
    are those of its words. Words of ASCII and Latin-1 letters and marks are split here and
    their parts go straight to the merges, as normalization changes their case only; others
    go through the tokenizer whole. So does a text that names a special token, and every
    text if the file's normalization or split is another one.

    Words are kept in two generations, so those in use outlast the many that occur once.
    """

    plain = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
    split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.parts, self.old = Parts(self.whole.model), {}
        self.names = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        form = json.loads(self.whole.to_str())
        steps = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.known = (form.get("normalizer") or {}).get("normalizers") == NORMALIZER and steps == [SPLIT, known] and form["model"]["type"] == "BPE"

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = b"".join(map(self.parts.__getitem__, self.split(word.decode().lower()))) if self.plain(word) else self._whole(word.decode())
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.known or any(name in text for name in self.names):
            return self._whole(text)
        if len(self) > KNOWN:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


_words: dict[str, WordIds] = {}


def _tokenizer(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


class Writer:
    """One file: add documents in order, then close."""

    def __init__(self, out):
        self.out, self.zstd, self.buffer, self.entries = out, zstandard.ZstdCompressor(level=LEVEL), bytearray(), []
        self.keys, self.counts, self.n_bytes = [], [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _frame(self, ids: bytes) -> None:
        packed = self.zstd.compress(ids)
        self._put(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.buffer += ids
        while len(self.buffer) >= 4 * FRAME_IDS:
            self._frame(bytes(self.buffer[: 4 * FRAME_IDS]))
            del self.buffer[: 4 * FRAME_IDS]

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        known = np.array([k is not None for k in self.keys], "u1").tobytes()
        index = self.zstd.compress(keys + known + np.array(self.counts, "<u4").tobytes())
        self._put(_HEAD.pack(INDEX_MAGIC, len(index)) + index)
        self.entries.append((_HEAD.size + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOT.pack(len(self.entries), FLAG, FOOT_MAGIC)
        self._put(_HEAD.pack(SEEK_MAGIC, len(table)) + table)


class Reader:
    """One file, an input with ``size``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        n, flag, magic = _FOOT.unpack(self._at(source.size() - _FOOT.size, _FOOT.size))
        if magic != FOOT_MAGIC or not flag & FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        start = source.size() - _FOOT.size - n * _ENTRY.size
        self.entries = np.frombuffer(self._at(start, n * _ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.append(0, np.cumsum(self.entries[:, 0]))
        self.starts = np.append(0, np.cumsum(self.entries[:, 1])) // 4
        index = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[n - 1] + _HEAD.size, self.entries[-1, 0] - _HEAD.size))
        docs = len(index) // 13
        self.keys, self.known = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.counts))
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def _frame(self, i: int) -> bytes:
        if self.held[0] != i:
            ids = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[i], self.entries[i, 0]))
            if len(ids) != self.entries[i, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.entries[i, 2]:
                raise ValueError(f"frame {i} is damaged")
            self.held = (i, ids)
        return self.held[1]

    def document(self, i: int) -> bytes:
        """Ids of the i-th document, from the frames that hold them."""
        begin, end, parts = self.first[i], self.first[i + 1], []
        for f in range(int(np.searchsorted(self.starts, begin, "right")) - 1, len(self.entries)):
            if self.starts[f] >= end:
                break
            parts.append(self._frame(f)[max(0, 4 * int(begin - self.starts[f])) : 4 * int(end - self.starts[f])])
        return b"".join(parts)


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending order of the key; the manifest, with ``start``.

    ``path``: a folder that all executors and the driver share; below spark.checkpoint.dir if not given.
    """
    path = path or scratch(docs.sparkSession, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context, writer = _tokenizer(tokenizer), TaskContext.get(), None
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        shard = context.partitionId()
        final, own = f"{base}/{shard:06d}.ids.zst", f"{base}/_{shard:06d}-{context.taskAttemptId()}"
        for batch in batches:
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = Writer(fs.open_output_stream(own, compression=None))
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(k, words.encode(t.as_py() or "") + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "path": [f"{path}/{shard:06d}.ids.zst"], "n_docs": [len(writer.keys)],
                "n_tokens": [sum(writer.counts)], "n_bytes": [writer.n_bytes],
            })

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    manifest = durable(dealt.mapInArrow(task, MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame, wanted: dict | None = None) -> DataFrame:
    """Documents of the files: key, start (ids before it) and ids, packed.

    ``wanted`` asks for keys: only the frames with their ids are read.
    """
    keys = None if wanted is None else np.array(sorted(wanted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    file = Reader(source)
                    some = np.arange(len(file.keys)) if keys is None else np.flatnonzero(np.isin(file.keys, keys) & file.known)
                    size = np.cumsum(file.counts[some] * 4)
                    for part in np.split(some, np.flatnonzero(np.diff(size // (8 << 20))) + 1):
                        if len(part):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(file.keys[part], pa.int64(), mask=~file.known[part]),
                                    pa.array(file.first[part] + start, pa.int64()),
                                    pa.array([file.document(i) for i in part], pa.binary()),
                                ],
                                ["key", "start", "ids"],
                            )

    # a task per file: the manifest is small, the files are not
    files = manifest.select("path", "start", "shard").repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")
    return files.mapInArrow(task, "key long, start long, ids binary")


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and read them back: key, start, n_tokens and ids_crc32 of each document."""
    found = read(durable(write(docs, tokenizer, end_id, key, text)))
    return found.select(F.col("key").alias(key), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
