"""Quality of documents by attention over their passages.

A document is a bag of passages and only the bag is labelled. Every passage is encoded from its characters and words,
a gated attention, learned from the document labels, weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import give_back
from runlore.llm.packing import chunks
from runlore.llm.spans import SPACE, mixed, span_hashes, word_spans
from runlore.session import materialise, remove_table

#: Kinds of bytes: each ASCII mark has its own, letters and digits share theirs, bytes beyond ASCII are one.
KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    KIND[_i] = (
        0 if _i in (32, 10) or SPACE[_i] else 1 if _c.isascii() and _c.islower() else 2 if _c.isascii() and _c.isupper()
        else 3 if _c.isascii() and _c.isdigit() else 4 if _i >= 128 else 5 + (".,;:!?-'\"()".find(_c) if _c in ".,;:!?-'\"()" else 11)
    )
KINDS = int(KIND.max()) + 1
#: Length of a passage's vector: pairs of kinds, then words, distinct words, letters, and a constant.
WIDTH = KINDS * KINDS + 4


@dataclass(frozen=True)
class Fit:
    """Bounds of the training: so many labelled rows, fewer where their passages, all of which count, are more than
    ``passages``; and the size, rounds and pace of the learning."""

    rows: int = 6_000
    passages: int = 80_000
    words: int = 50
    hidden: int = 24
    gate: int = 12
    rounds: int = 30
    rate: float = 0.004
    decay: float = 1e-4
    seed: int = 7


def encode(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(one vector per passage, number of passages per text). Passages are runs of ``words`` words; a text without words
    is one passage of nothing."""
    data = [t.encode("utf-8", "replace") + b" " for t in texts]
    buffer = np.frombuffer(b"".join(data), np.uint8)
    stops = np.cumsum([len(x) for x in data])
    starts, ends = word_spans(buffer)
    of = np.searchsorted(stops, starts, side="right")
    n = np.bincount(of, minlength=len(texts))
    within = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
    count = np.maximum(1, -(-n // words))
    first = np.cumsum(count) - count
    passage = first[of] + within // words
    total = int(count.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if len(starts):
        heads = np.flatnonzero((within % words == 0) & (within > 0))  # a text's first passage begins where it does
        at = np.concatenate([np.append(0, stops[:-1]), starts[heads]])
        order = np.argsort(at, kind="stable")
        owner = np.repeat(np.concatenate([first, passage[heads]])[order], np.diff(np.append(at[order], len(buffer))))
        kind = KIND[buffer]
        pair = owner[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        own = np.ones(len(pair), bool)
        own[stops[:-1] - 1] = False  # no pair of two texts
        pairs = np.bincount(pair[own], minlength=total * KINDS * KINDS).reshape(total, -1)
        out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
        key = mixed(span_hashes(buffer, starts, ends) ^ mixed(passage.astype(np.uint64)))
        _, at = np.unique(key, return_index=True)
        in_passage = np.bincount(passage, minlength=total)
        distinct = np.bincount(passage[at], minlength=total)
        letters = np.bincount(passage, ends - starts, minlength=total)
        out[:, -4] = in_passage / words
        out[:, -3] = distinct / np.maximum(1, in_passage)
        out[:, -2] = np.minimum(4.0, letters / np.maximum(1, in_passage) / 8)
    out[:, -1] = 1.0
    return out, count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Encoder, gated attention and score, with the gradient written out."""

    NAMES = ("encode", "turn", "gate", "attend", "score", "bias")

    def __init__(self, fit: Fit):
        rng = np.random.default_rng(fit.seed)
        h, g = fit.hidden, fit.gate
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.encode, self.turn, self.gate, self.attend = draw(WIDTH, h), draw(h, g), draw(h, g), draw(g)
        self.score, self.bias = draw(h), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        first = np.cumsum(count) - count
        h = np.tanh(x @ self.encode)
        t, s = np.tanh(h @ self.turn), sigmoid(h @ self.gate)
        e = (t * s) @ self.attend
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return sigmoid(z @ self.score + self.bias), (h, t, s, a, z)

    def gradient(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, (h, t, s, a, z) = self.forward(x, count)
        first = np.cumsum(count) - count
        d = (p - y) * weight / len(y)
        dz = np.repeat(d[:, None] * self.score, count, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dt, ds = de[:, None] * self.attend * s * (1 - t * t), de[:, None] * self.attend * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ self.turn.T + ds @ self.gate.T) * (1 - h * h)
        return {"encode": x.T @ dh, "turn": h.T @ dt, "gate": h.T @ ds, "attend": (t * s).T @ de, "score": z.T @ d, "bias": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, fit: Fit) -> Network:
    """Adam over small groups of bags; bags of the rarer label count more, at most so that both weigh alike."""
    net, rng = Network(fit), np.random.default_rng(fit.seed)
    y = labels.astype(np.float32)
    share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
    weight = np.where(y == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share))).astype(np.float32)
    mean = {k: 0.0 for k in net.NAMES}
    spread, step = dict(mean), 0
    for r in range(fit.rounds if len(y) else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            count = np.array([len(bags[j]) for j in some])
            grads = net.gradient(np.concatenate([bags[j] for j in some]), count, y[some], weight[some])
            step += 1
            for k, g in grads.items():
                w = getattr(net, k)
                g = g + fit.decay * w
                mean[k] = 0.9 * mean[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                pace = fit.rate * (1 - r / fit.rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(net, k, (w - pace * mean[k] / (np.sqrt(spread[k]) + 1e-8)).astype(np.float32))
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    return net


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit: Fit = Fit()) -> Network:
    """Learn from labelled documents, about ``fit.rows`` of them, chosen by a hash of the key. Tasks encode all passages
    of a chosen text; the driver gets rows in the order of that hash, as many as ``fit.passages`` allows, whole texts only."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    known = known.select(F.col(key).alias("key"), F.xxhash64(key).alias("u"), F.col("label").cast("long").alias("label"))
    share = min(1.0, fit.rows / max(1, known.count()))
    chosen = known.where(F.pmod("u", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("u", "text", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [encode([t], fit.words)[0].astype(np.float16) for t in batch["text"].fillna("")]
            yield pd.DataFrame({"u": batch["u"], "n": [len(x) for x in bags], "bag": [x.tobytes() for x in bags], "label": batch["label"]})
        give_back()

    encoded = materialise(rows.mapInPandas(run, "u bigint, n bigint, bag binary, label bigint"))
    sizes = encoded.where(F.col("n") <= fit.passages).select("u", "n").toPandas().groupby("u")["n"].sum().sort_index()
    fit_in = sizes.index[sizes.cumsum() <= fit.passages]
    last = int(fit_in.max()) if len(fit_in) else None
    got = encoded.where((F.col("u") <= F.lit(last)) & (F.col("n") <= fit.passages)).toPandas().sort_values(["u", "bag"])
    remove_table(encoded)
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in got["bag"]]
    net = train(bags, got["label"].to_numpy(), fit)
    del got, bags
    give_back()
    return net


def scores(net: Network, texts: list[str], words: int) -> np.ndarray:
    """Score of each text, a part of them encoded at a time."""
    parts = [net.forward(*encode(texts[i : i + n], words))[0] for i, n in chunks(texts)]
    # what a text is scored with moves the last bits of the products; six digits are its own
    return np.round(np.concatenate(parts), 6) if parts else np.empty(0)


def scored(docs: DataFrame, net: Network, text: str = "text", words: int = Fit().words) -> Column:
    """Score of every whole text, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(sent.value, batch.fillna("").tolist(), words), dtype="float64")
        give_back()

    return F.pandas_udf(run, "double")(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, key: str = "doc_id",
                    text: str = "text", label: str = "quality", fit: Fit = Fit()) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` (replaced if there were such).

    Learns from rows with a label that aren't held out; a row's score depends on its text alone, so equal texts score
    alike and repeated rows stay. A null text is an empty one, scored as one passage of nothing. Null labels, labels of
    no document and documents without label are fine; several labels of a document count as the lowest; without any
    label the untrained network scores. Texts of any length are scored whole. An empty table gives no rows.
    """
    plain = docs.drop("held_out", "score", "predicted")
    net = learn(plain.where(~held_out), labels.select(key, label), key, text, label, fit)
    out = plain.withColumn("held_out", held_out).withColumn("score", scored(plain, net, text, fit.words))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
