import numpy as np
import pytest
from pyspark.sql import functions as F

from berth.llm import factorization, language_id, quality_classifier, queries, toxicity
from berth.llm.common import fold
from tests.llm.conftest import SF


def test_sum_of_squares_is_the_sum_over_pairs():
    machine = factorization.Machine()
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(0)
    machine.places = np.full(factorization.BUCKETS, -1, np.int32)
    used = sorted(factorization.buckets(" ".join(f"w{chr(97 + i)}" for i in range(12))))
    words = [f"w{chr(97 + i)}" for i in range(12)]
    machine.places[used] = np.arange(12)
    machine.words, machine.bias, machine.centre, machine.spread = 12, 0.1, np.zeros(1), np.ones(1)
    machine.linear, machine.pairs = rng.normal(0, 0.1, 13), rng.normal(0, 0.3, (13, 8))
    x = np.append(np.ones(12), 0.7)
    want = machine.bias + machine.linear @ x + sum(machine.pairs[i] @ machine.pairs[j] * x[i] * x[j] for i in range(13) for j in range(i))
    assert machine.scorer()(" ".join(words), [0.7]) == pytest.approx(1 / (1 + np.exp(-want)))


def test_pairs_are_learned(spark):
    """Neither word says anything alone; both or none are toxic."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join((["fool"] if a else []) + (["folk"] if b else []) + [f"x{chr(97 + k)}" for k in rng.integers(0, 20, 3)]), int(a == b)) for i, (a, b) in enumerate(rng.integers(0, 2, (800, 2)))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels, learn=F.col("doc_id") % 3 != 1).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in out]) > 0.95


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few toxic rows to learn from
    out = queries.QUERIES[name](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) >= least
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("operator", [quality_classifier, toxicity])
def test_classifiers_take_any_rows(spark, edge, empty, operator):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, 0, 0), (3, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = operator.classify(edge, labels, learn=F.col("doc_id") > 0).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert operator.classify(empty, labels, learn=F.lit(True)).count() == 0
    assert {r["score"] for r in operator.classify(edge, labels.where("false"), learn=F.lit(True)).collect()} == {0.5}


def test_gradients_of_the_network(monkeypatch):
    monkeypatch.setattr(language_id, "HIDDEN", 3)
    net = language_id.Network(["x", "y"])
    rng = np.random.default_rng(2)
    for way in net.ways:
        way.inputs, way.recurrent = way.inputs.astype(np.float64), way.recurrent.astype(np.float64)
    way, steps = net.ways[0], rng.integers(0, 5, (6, 4))
    goal = rng.normal(size=(6, 4, 3))

    def loss():
        return float((way.forward(steps, False)[0] * goal).sum())

    grads = way.backward(steps, way.forward(steps, True)[1], goal)
    for name, grad in zip(way.names, grads, strict=True):
        value = getattr(way, name)
        for at in [(0, 0), (2, 4), (1, 8)]:
            kept = value[at]
            value[at] = kept + 1e-2
            up = loss()
            value[at] = kept - 1e-2
            down = loss()
            value[at] = kept
            assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=2e-3)


def test_languages(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language_id.train(docs, learn=fold("doc_id", 3) != 1)
    rows = language_id.identify(docs, network).where(fold("doc_id", 3) == 1).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.9
    out = language_id.identify(edge, network).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if not any(c.isalpha() for c in r["text"] or ""))
    assert all(r["lang_pred"] in network.languages for r in out if any(c.isalpha() for c in r["text"] or ""))
    assert language_id.identify(empty, network).count() == 0
    assert language_id.train(empty, learn=F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(edge, None).collect()} == {"und"}


def test_no_language_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 3)
    rows = [(3 * i + k, chr(0x4E00 + i) * 40, f"l{i:03}") for i in range(205) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(docs, learn=F.lit(True)).languages == sorted({r[2] for r in rows})


def test_all_positions_of_long_texts_count():
    net = language_id.Network(["x", "y"])
    text = bytes(range(97, 123)) * 30
    parts = net.probabilities(np.frombuffer(text + b" " * (-len(text) % language_id.WINDOW), np.uint8).reshape(-1, language_id.WINDOW))[0]
    whole = parts.transpose(1, 0, 2).reshape(-1, 2)[: len(text)].mean(0)
    assert net.pooled([text, b"a"])[0] == pytest.approx(whole, abs=1e-5)


@pytest.mark.parametrize("share", [0.03, 0.05])
def test_rare_pairs_are_learned(share):
    """Two words, each as frequent in both labels, that are toxic only together."""
    rng, rows, labels = np.random.default_rng(1), [], []
    for i in range(6000):
        words, r = [f"w{k}" for k in rng.integers(0, 3000, 30)], rng.random()
        if i % 2:
            words += ["insult", "group"] if r < share else []
        else:
            words += ["insult"] if r < share else ["group"] if r < 2 * share else []
        rows.append((np.array(sorted(factorization.buckets(" ".join(words))), np.int64), np.zeros(0)))
        labels.append(i % 2)
    score = factorization.Machine().fit(rows, np.array(labels, float), np.ones(len(rows))).scorer()
    assert score("insult of a group", []) > 0.9 and all(score(t, []) < 0.6 for t in ("insult", "group", "a word"))


def test_toxic_rows_are_found(spark):
    """Held-out recall and precision; a classifier that finds nothing has no recall."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    out = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    found = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in out)
    assert found >= 0.75 * sum(r["toxic"] for r in out) and found >= 0.9 * sum(r["predicted"] for r in out)
