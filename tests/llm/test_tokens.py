import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from berth.llm import bpe, queries, token_files
from tests.llm.conftest import SF

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
BITS = ["a", "b", "aa", "th", "The", "é", "é", "́", "漢", "\U0001f600", "  ", "\n", "1", "\x1c", "\x85", "\x00", "ing", "\xa0", "'s", "--", "'ll", ".", "Σ", "İ", "<|endoftext|>", "٣"]


def texts(n, length, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_are_the_librarys(plain):
    own, some = bpe.codec(RANKS, P.PATTERN), [*texts(800, 40, 1), "ab" * 4000 + "the" * 3000, "x" * 199 + " " + "y" * 201, None, ""]
    for t, ids in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_shared_queue_and_own_queue_agree():
    own = bpe.codec(RANKS, P.PATTERN)
    pieces = [t.encode() for t in texts(300, 30, 2) if t]
    assert own.merge(pieces) == [own.merge_long(p).tobytes() for p in pieces]


def test_rank_queue_finds_the_lowest():
    queue, r, waiting = bpe.RankQueue(50_256), random.Random(3), []
    for _ in range(2000):
        if waiting and r.random() < 0.4:
            assert queue.lowest() == min(waiting)
            queue.take(min(waiting))
            waiting = [x for x in waiting if x != min(waiting)]
        else:
            waiting.append(x := r.randrange(50_256))
            queue.bucket(x).append(0)


def expected_bpe(plain, rows):
    for i, t in rows:
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        yield (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op10(spark, plain, edge, empty):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op10_byte_bpe"](spark, SF).collect())) == sorted(expected_bpe(plain, docs))
    some = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    out = bpe.digests(edge, RANKS, P.PATTERN)
    assert out.columns[: len(edge.columns)] == edge.columns
    got = [tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected_bpe(plain, some), key=str)
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    round_trip = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in round_trip.collect())


def test_word_ids_are_the_librarys():
    own, library = token_files.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for t in texts(1500, 25, 4):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_special_names_and_other_tokenizers_are_the_librarys(tmp_path):
    library = Tokenizer.from_file(WORDS)
    own = token_files.WordIds(WORDS)
    some = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "É'S été ÀÖØöøÿ×÷ß ſ it's 12é3 l'été!!é", "caf" + "e\u0301 naïve", *texts(500, 30, 9)]
    assert own.known
    for t in some:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    other = Tokenizer.from_file(WORDS)
    from tokenizers import normalizers

    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    own = token_files.WordIds(str(tmp_path / "other.json"))
    assert not own.known and np.frombuffer(own.encode("Ab cD"), "<u4").tolist() == other.encode("Ab cD", add_special_tokens=False).ids


def test_every_latin_word_is_the_librarys():
    own, library = token_files.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]):
        for t in (c, f"a{c}b", f"{c}{c}1", f"é{c}"):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out

    def size(self):
        return len(self.getvalue())


def test_file_reads_only_the_frames_asked_for(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 1000)
    rng, out = np.random.default_rng(0), io.BytesIO()
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (1, 2500, 1, 999, 0, 4000, 7)]
    writer = token_files.Writer(out)
    for k, ids in zip([None, 1, 2, 3, 4, 5, 5], docs, strict=True):
        writer.add(k, ids)
    writer.close()
    source = Counted(out.getvalue())
    reader = token_files.Reader(source)
    assert [reader.document(i) for i in range(7)] == docs
    assert reader.known.tolist() == [False] + [True] * 6
    reader, before = token_files.Reader(source), source.read_bytes
    assert reader.document(2) == docs[2] and source.read_bytes - before < 2 * 4200 + 600
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(docs)
    damaged = bytearray(out.getvalue())
    damaged[60] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(Counted(bytes(damaged))).document(1)


def expected_files(rows):
    library = Tokenizer.from_file(WORDS)
    start = 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        yield (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2(spark, edge, empty):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.QUERIES["op2_token_files"](spark, SF).collect())) == list(expected_files(docs))
    got = token_files.digests(edge, WORDS).orderBy("start").collect()
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    want = sorted((i, n, crc) for i, _, n, crc in expected_files(rows) if i is not None)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert token_files.digests(empty, WORDS).count() == 0


def test_some_documents(spark, edge):
    manifest = token_files.write(edge, WORDS)
    assert {r["key"] for r in token_files.read(manifest, {3, 5, 99}).collect()} == {3, 5}
