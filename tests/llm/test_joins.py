import itertools
import random

import numpy as np
import pytest

from berth.llm import embedding_dedup, ngram_join
from berth.llm.components import components
from tests.llm.conftest import LONG, frame


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def smallest(nodes, pairs):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(60)] + [(-5, 300 + i) for i in range(50)]
    want = {n: root for n, root in smallest({x for e in edges for x in e}, edges).items() if n != root}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def plain_join(rows):
    sets = {i: plain_set(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = smallest(sets, pairs)
    return sorted((i, len(sets[i]), roots[i]) for i in sets)


def near_copies(seed, passage_words=0, group=0):
    """Texts of all sizes with copies that differ by some words, chains of them, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage, texts = [word() for _ in range(passage_words)], []
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 30, 45, 60, 90, 150, 300]:
        for _ in range(3):
            words = [word() for _ in range(size)] + (passage if r.random() < 0.7 else [])
            texts.append(words)
            for _ in range(r.randrange(5)):
                words = list(words)
                for _ in range(r.choice([0, 1, 1, 2, max(1, size // 40), max(1, size // 22)])):
                    at = r.randrange(len(words))
                    words[at : at + r.randrange(2)] = [word()] * r.randrange(2)
                    words = words or [word()]
                texts.append(words)
    base = [word() for _ in range(120)]
    for _ in range(group):
        words = list(base)
        words[r.randrange(120)] = word()
        texts.append(words)
    r.shuffle(texts)
    return [(i, r.choice([" ", "\n "]).join(words).replace("w1", r.choice(["w1", "W1"]))) for i, words in enumerate(texts)]


@pytest.mark.parametrize(("seed", "passage", "group", "hot"), [(1, 0, 0, 2000), (2, 60, 40, 2000), (3, 20, 60, 5)])
def test_join_is_brute_force(spark, monkeypatch, seed, passage, group, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = near_copies(seed, passage, group)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == plain_join(rows)


def test_far_copies_make_few_pairs(spark, monkeypatch):
    """Copies of one text with up to 12 words replaced: many are like no other, and are not paired with all."""
    r, base, made = random.Random(7), [f"b{i}" for i in range(146)], []
    rows = []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(146), r.randrange(13)):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    alike = ngram_join._alike

    def counted(pairs, *args):
        made.append(pairs.count())
        return alike(pairs, *args)

    monkeypatch.setattr(ngram_join, "_alike", counted)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out.collect()) == plain_join(rows)
    assert sum(made) < 15 * len(rows)


def test_marks_never_dismiss_similar_sets():
    r = np.random.default_rng(8)
    for n in (1, 4, 9, 60, 142, 700, 5000):
        for differ in (0, 1, n // 9, n):
            some = r.integers(0, 2**63, n + differ, dtype=np.uint64)
            found = np.bitwise_count((ngram_join.marks(some[:n]) ^ ngram_join.marks(some[differ:])).view(np.uint64)).sum()
            assert found <= 2 * differ and (found > 0 or differ == 0 or n > 60)
    assert len(ngram_join.marks(some)) == ngram_join.MARKS // 64


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(seed):
    """Whatever the sketch says, and in either way of small bands."""
    rng = np.random.default_rng(seed)
    for size in [4, 5, 7, 8, 11, 15, 16, 21, 40, 63, 64, 100, 200]:
        scheme = ngram_join.Scheme(rng.integers(0, 1000, ngram_join.Scheme.width()).astype(np.uint32))
        scheme.deletions = {b for b in (2, 3) if rng.random() < 0.5}
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            larger = rng.integers(len(a), len(a) * 5 // 4 + 1)
            differ = (len(a) + larger) // 9
            common = (len(a) + larger - differ + 1) // 2
            b = np.unique(np.append(rng.permutation(a)[: min(len(a), common)], rng.integers(0, 2**63, max(0, larger - common)).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert (a.shape == b.shape and (a == b).all()) or len(np.intersect1d(scheme.signatures(a)[0], scheme.signatures(b)[0]))


def test_join_takes_any_rows(spark, edge, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(edge).collect()}
    n = len(plain_set(LONG))
    assert {(5, n, 5), (6, n, 5), (2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7)} <= got
    assert {c for i, k, c in got if i is None and k} == {1}  # the null key is a near copy of document 1
    assert ngram_join.join(edge).count() == edge.count()
    kept = ngram_join.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None, 3, 4, 5, 7, 8], key=str)
    assert ngram_join.join(empty).count() == 0 and ngram_join.deduplicate(empty).count() == 0


def test_chain_of_copies_keeps_its_smallest(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(10 - k, " ".join(f"n{i}" if i < 6 * k else w for i, w in enumerate(words)), "en", "a") for k in range(8)]
    docs = frame(spark, rows)
    assert {r["component_id"] for r in ngram_join.join(docs).collect()} == {3}
    assert [r["doc_id"] for r in ngram_join.deduplicate(docs).collect()] == [3]


def plain_links(rows):
    sound = [(i, la, np.array(v, float)) for i, v, la in rows if la is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(i, j) for (i, a, x), (j, b, y) in itertools.combinations(sound, 2) if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    roots = smallest([r[0] for r in rows], pairs)
    return sorted((i, sum(i in p for p in pairs), roots[i], roots[i] == i) for i, _, _ in rows)


@pytest.mark.parametrize(("block", "per_pivot"), [(1024, 2000), (16, 20)])
def test_embeddings_are_brute_force(spark, monkeypatch, block, per_pivot):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", per_pivot)
    rng, rows = np.random.default_rng(5), []
    for label in (0, 1, 2):
        for centre in rng.normal(size=(12, 8)):
            for _ in range(rng.integers(1, 14)):
                rows.append((centre + rng.normal(0, rng.choice([0.0, 0.05, 0.15]), 8)).astype(np.float32).tolist() + [label])
    crowd = rng.normal(size=8)
    rows += [(crowd + rng.normal(0, 0.1, 8)).astype(np.float32).tolist() + [1] for _ in range(60)]
    rows = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 3, [2.0] * 3, [-0.0, 1.0], [0.0, 1.0], [1e-30, 0.0], [3e38, 0.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd * 2)] + [(n + 100, rows[0][1], None), (n + 101, rows[0][1], None)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, vec string, cid long, n int")
    out = embedding_dedup.link(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect())) == plain_links(rows)
    assert embedding_dedup.link(table.where("false")).count() == 0


def test_repeated_vectors_and_null_keys(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (7, [2.0, 0.0], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.link(table).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("n, similarity", [(1, 0.9), (9, 0.8), (63, 0.85), (64, 0.7), (65, 0.8), (400, 0.75), (1030, 0.8)])
def test_profiles_never_dismiss_similar_sets(n, similarity):
    r = np.random.default_rng(n)
    left, right, true, most = [], [], [], []
    for extra in (0, n // 20, n // 5):
        common = round((2 * n + extra) * similarity / (1 + similarity))
        some = r.integers(0, 2**63, 2 * n + extra - common, dtype=np.uint64)
        x, y = np.sort(some[:n]), np.sort(some[n - common :])
        left.append(ngram_join.profile(x))
        right.append(ngram_join.profile(y))
        true.append(len(x) + len(y) - 2 * common)
        most.append((len(x) + len(y)) // 9)
    found = ngram_join.differences(left, right)
    assert (found <= true).all() and (ngram_join.differences(right, left) == found).all()
    if similarity < 0.76 and n >= 400:
        assert (found[:2] > most[:2]).any()  # and most others are dismissed


def test_only_asked_texts_go_on(spark):
    r = random.Random(3)
    rows = [(r.randrange(-(2**63), 2**63), f"t{i}") for i in range(4000)] + [(0, "zero"), (-1, "last"), (1 << 22, "as zero")]
    needed = [x for x, _ in rows[:500]] + [0, -1]
    got = ngram_join._asked(spark.createDataFrame(rows, "row long, text string"), spark.createDataFrame([(x,) for x in needed], "row_ long"))
    assert got.columns == ["row", "text"]
    got = {x["row"] for x in got.collect()}
    assert set(needed) | {1 << 22} <= got and len(got) < 520


def test_no_profiles():
    assert ngram_join.differences([], []).tolist() == []
