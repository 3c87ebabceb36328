"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes; in each, one recurrent network reads forward and one
backward, and both states together give every byte its language probabilities. Their mean
over all bytes of the whole text is the document's. The network is trained in numpy by
backpropagation through time, every byte of a window towards the language of its document,
on a bounded sample: of each language the ``SAMPLE`` documents, about, whose keys have the
smallest digests, and ``TAKEN`` windows of each. All languages are learned; above ``MANY`` of
them each has fewer documents, but not under ``FEWEST``. Scoring runs on the executors.

Documents without a language teach nothing; neither do those without a letter. A null
text, or one without a letter, is ``und`` with score 0, as is every text when nothing was
learned. A null key gives a null digest and isn't in the sample. Repeated rows count each
in training, up to the bound, and get equal results. An empty table gives an empty result.
Other columns pass through, except that the two results replace any of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berth.llm.common import keeps_columns

SAMPLE, TAKEN, MANY, FEWEST = 300, 6, 200, 20
WINDOW, HIDDEN = 64, 8
STEPS, BATCH, RATE = 500, 192, 0.02
#: Windows that run through the network at once.
ABREAST = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Direction:
    """One gated recurrent network; gates in the order update, reset, candidate."""

    names = ("inputs", "recurrent")

    def __init__(self, rng: np.random.Generator):
        self.inputs = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.recurrent = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def forward(self, steps: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte of ``steps`` (time by window)."""
        h = np.zeros((steps.shape[1], HIDDEN), np.float32)
        states, kept = np.empty((*steps.shape, HIDDEN), np.float32), []
        for t, byte in enumerate(steps):
            x, past = self.inputs[byte], h @ self.recurrent
            gates = _sigmoid(x[:, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = past[:, 2 * HIDDEN :]
            new = np.tanh(x[:, 2 * HIDDEN :] + reset * inner)
            if keep:
                kept.append((h, update, reset, inner, new))
            h = new + update * (h - new)
            states[t] = h
        return states, kept

    def backward(self, steps: np.ndarray, kept: list, slopes: np.ndarray) -> list[np.ndarray]:
        """Gradients of both matrices, from those of the states."""
        grads = [np.zeros_like(self.inputs), np.zeros_like(self.recurrent)]
        carried = np.zeros((steps.shape[1], HIDDEN), np.float32)
        rows = []
        for t in range(len(steps) - 1, -1, -1):
            h, update, reset, inner, new = kept[t]
            carried = carried + slopes[t]
            d_new = carried * (1 - update) * (1 - new * new)
            d_update = carried * (h - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_past = np.concatenate([d_update, d_reset, d_new * reset], 1)
            rows.append(np.concatenate([d_update, d_reset, d_new], 1))
            grads[1] += h.T @ d_past
            carried = carried * update + d_past @ self.recurrent.T
        rows, order = np.concatenate(rows[::-1]), np.argsort(steps.ravel(), kind="stable")
        found, first = np.unique(steps.ravel()[order], return_index=True)
        grads[0][found] = np.add.reduceat(rows[order], first)
        return grads


class Network:
    """Forward and backward networks and the layer that names languages."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(0)
        self.languages = languages
        self.ways = [Direction(rng), Direction(rng)]
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def probabilities(self, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Of each byte (time by window by language)."""
        steps = np.ascontiguousarray(windows.T)
        ahead, kept = self.ways[0].forward(steps, keep)
        back, kept_back = self.ways[1].forward(steps[::-1], keep)
        logits = ahead @ self.out[:HIDDEN]
        logits += back[::-1] @ self.out[HIDDEN:]
        logits += self.bias
        np.exp(logits, out=logits)  # states are within -1 and 1: no overflow
        logits /= logits.sum(2, keepdims=True)
        return logits, (steps, ahead, back, kept, kept_back)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> Network:
        rng = np.random.default_rng(1)
        held = [self.out, self.bias, *(getattr(w, n) for w in self.ways for n in w.names)]
        first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
        for step in range(1, STEPS + 1):
            some = rng.integers(0, len(windows), BATCH)
            p, (steps, ahead, back, kept, kept_back) = self.probabilities(windows[some], True)
            p[:, np.arange(BATCH), labels[some]] -= 1
            p /= p.shape[0] * BATCH
            flat, behind = p.reshape(-1, p.shape[2]), back[::-1].reshape(-1, HIDDEN)
            grads = [np.concatenate([ahead.reshape(-1, HIDDEN).T @ flat, behind.T @ flat]), flat.sum(0)]
            grads += self.ways[0].backward(steps, kept, p @ self.out[:HIDDEN].T)
            grads += self.ways[1].backward(steps[::-1], kept_back, (p @ self.out[HIDDEN:].T)[::-1])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (STEPS + 1))
            for k, (value, g) in enumerate(zip(held, grads, strict=True)):
                g = g * min(1.0, 1.0 / (size + 1e-12))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                value -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text, none of them empty."""
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // WINDOW)
        total = np.zeros((len(texts), len(self.languages)))
        whole = np.frombuffer(b"".join(t + b" " * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
        owner, number = np.repeat(np.arange(len(texts)), counts), np.arange(len(whole)) - np.repeat(np.cumsum(counts) - counts, counts)
        filled = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
        for a in range(0, len(whole), ABREAST):
            part = slice(a, a + ABREAST)
            p, _ = self.probabilities(whole[part])
            if (filled[part] < WINDOW).any():
                p = p * (np.arange(WINDOW)[:, None] < filled[part])[:, :, None]
            sums = p.sum(0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner[part], sums[:, k], len(texts))
        return total / sizes[:, None]


def _windows(text: str) -> list[bytes]:
    """``TAKEN`` windows at most, spread over the whole text."""
    raw = text.encode()
    starts = range(0, max(1, len(raw)), WINDOW)
    some = [starts[i * len(starts) // min(TAKEN, len(starts))] for i in range(min(TAKEN, len(starts)))]
    return [raw[s : s + WINDOW].ljust(WINDOW) for s in some]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from the labelled rows that ``learn`` (a condition on the key) lets pass; None without any."""
    rows = docs.select(F.col(key), F.col(lang).alias("__lang"), F.col(text).alias("__text"))
    rows = rows.where(learn & F.col("__lang").isNotNull() & has_letter(F.col("__text")) & F.col(key).isNotNull())
    counts = rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    languages = sorted(r["__lang"] for r in counts)
    each = min(SAMPLE, max(FEWEST, SAMPLE * MANY // len(languages)))
    rates = docs.sparkSession.createDataFrame([(r["__lang"], min(1.0, each / r["n"])) for r in counts], "__lang string, __rate double")
    drawn = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    taken = F.arrow_udf(lambda texts: pa.array([_windows(t) for t in texts.to_pylist()], pa.list_(pa.binary())), "array<binary>").asNondeterministic()
    sample = rows.join(F.broadcast(rates), "__lang").where(drawn < F.col("__rate")).orderBy(F.xxhash64(key), key).limit(2 * each * len(languages))
    found = sample.select("__lang", taken("__text").alias("w")).collect()
    place = {name: i for i, name in enumerate(languages)}
    windows = [(np.frombuffer(w, np.uint8), place[r["__lang"]]) for r in found for w in r["w"]]
    if not windows:
        return None
    return Network(languages).train(np.array([w for w, _ in windows]), np.array([y for _, y in windows]))


@keeps_columns
def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from whole texts."""
    if network is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = [t.encode() if t else b"" for t in texts.to_pylist()]
            use = [i for i, t in enumerate(raw) if t]
            best, score = np.zeros(len(raw), int), np.zeros(len(raw))
            if use:
                p = shared.value.pooled([raw[i] for i in use])
                best[use], score[use] = p.argmax(1), np.clip(p.max(1), 0, 1)
            names = [shared.value.languages[b] for b in best]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang", "score"])

    name = F.arrow_udf(named, "struct<lang: string, score: double>").asNondeterministic()
    found = docs.withColumns({"__letters": has_letter(docs[text]), "__named": name(docs[text])})
    own = {"lang_pred": F.when(F.col("__letters"), F.col("__named.lang")).otherwise("und"), "score": F.when(F.col("__letters"), F.col("__named.score")).otherwise(0.0)}
    return found.withColumns(own).drop("__letters", "__named")
