"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages, stretches of ``PASSAGE`` bytes of its whole text. Each passage is described
by the frequencies of its byte trigrams and of trigrams of character kinds, and encoded by a hidden layer.
Gated attention gives each passage a weight; the weighted sum of the encoded passages is the document, and a
logistic unit scores it. All layers are learned together from document labels alone, so the attention finds
the passages that decide.

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` of the training folds, those with
the smallest hash of the key), with every passage of each. The bound is on documents only: their passages
are collected in rounds of bounded size into a temporary file of the driver, which reads one batch of
documents at a time. Scoring reads every passage of every text, a bounded number of passages at a time.

Defined cases: null and empty texts are one passage without trigrams and get a score too; several labels of
a document are averaged, null ones left out; without labels of both kinds the score is the share of label 1
(0.5 without any); rows that repeat a key are scored one by one; null keys are held out.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Scratch, whole_text, worker_cache

SAMPLE = 6_000
PASSAGE = 600
KINDS, BYTES = 256, 256
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 12, 64, 3e-3, 1e-4
#: Bytes of text whose passages are described together.
BYTES_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 512
#: Passages of the training sample that are collected, or summed, together (1 KB each).
PASSAGES_AT_ONCE = 100_000


def _kinds() -> np.ndarray:
    """Kind of each byte: small letter, capital, digit, white space, other signs each on their own."""
    kind = np.arange(256, dtype=np.uint32)
    kind[ord("a") : ord("z") + 1] = 1
    kind[128:] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    return kind


KIND_OF = _kinds()


def _trigrams(x: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the trigram that starts at each place but the last two."""
    code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(16)) % np.uint32(n)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (square roots of frequencies) and each text's number of passages.

    No trigram crosses the end of a passage, so a passage's features do not depend on what is around it.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros((n, KINDS + BYTES), np.float32), counts
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(first, lengths) + place // PASSAGE
    inside = owner[:-2] == owner[2:]
    owner = owner[:-2][inside]
    kinds = np.bincount(owner * KINDS + _trigrams(KIND_OF[raw], KINDS)[inside], minlength=n * KINDS).reshape(n, KINDS)
    grams = np.bincount(owner * BYTES + _trigrams(raw, BYTES)[inside], minlength=n * BYTES).reshape(n, BYTES)
    features = np.concatenate([kinds, grams], axis=1).astype(np.float32)
    size = np.maximum(1, np.bincount(owner, minlength=n))[:, None]
    return np.sqrt(features / size), counts


@dataclass
class Model:
    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; passages are described and encoded ``BYTES_AT_ONCE`` bytes at a time."""
        if not self.weights or not texts:
            return np.full(len(texts), self.prior)
        step = BYTES_AT_ONCE // PASSAGE * PASSAGE
        encoded, held, size = [], [], 0
        counts = np.zeros(len(texts), np.int64)

        def encode() -> None:
            features, n = describe([t for _, t in held])
            np.add.at(counts, [i for i, _ in held], n)
            found = _encode(self.weights, features)
            encoded.append((found["h"], found["e"]))

        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text)), step):
                held.append((i, text[a : a + step]))
                size += len(held[-1][1])
                if size >= step:
                    encode()
                    held, size = [], 0
        if held:
            encode()
        h, e = (np.concatenate(x) for x in zip(*encoded))
        return _sigmoid(_pool(self.weights, h, e, counts)["logit"].astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _encode(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Encoded passages ``h`` and their attention ``e`` before it is shared out."""
    x = (x - w["mean"]) * w["scale"]
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["look"] + w["look0"]), _sigmoid(h @ w["gate"] + w["gate0"])
    return {"x": x, "h": h, "t": t, "g": g, "e": (t * g) @ w["rate"]}


def _pool(w: dict[str, np.ndarray], h: np.ndarray, e: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Attention weights within each document, weighted passages and log odds."""
    bag = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"bag": bag, "first": first, "a": a, "z": z, "logit": z @ w["out"] + w["out0"]}


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the log loss of the documents' labels; the same sample always gives the same model.

    ``features`` may be a mapped file; a batch of documents and a stretch of passages are read at a time.
    """
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or labels.min() >= 0.5 or labels.max() < 0.5:
        return Model(prior)
    rng = np.random.default_rng(seed)
    d = features.shape[1]

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {
        "encode": draw(d, HIDDEN), "encode0": np.zeros(HIDDEN, np.float32), "look": draw(HIDDEN, GATE), "look0": np.zeros(GATE, np.float32),
        "gate": draw(HIDDEN, GATE), "gate0": np.zeros(GATE, np.float32), "rate": draw(GATE), "out": draw(HIDDEN),
        "out0": np.array(np.log(prior / (1 - prior)), np.float32),
    }
    sums, squares = np.zeros(d), np.zeros(d)
    for a in range(0, len(features), PASSAGES_AT_ONCE // 4):
        some = features[a : a + PASSAGES_AT_ONCE // 4].astype(np.float64)
        sums, squares = sums + some.sum(0), squares + (some * some).sum(0)
    mean = sums / len(features)
    std = np.sqrt(np.maximum(squares / len(features) - mean * mean, 0))
    fixed = {"mean": mean.astype(np.float32), "scale": (1 / (std + 0.01)).astype(np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    first = np.cumsum(counts) - counts
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            bags = order[a : a + BATCH]
            take = np.concatenate([np.arange(first[b], first[b] + counts[b]) for b in bags])
            f = _encode(w | fixed, features[take].astype(np.float32))
            f |= _pool(w, f["h"], f["e"], counts[bags])
            grads = _backward(w, f, labels[bags])
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * w[k]
                m, v = moments[k]
                m = 0.9 * m + 0.1 * grad
                v = 0.999 * v + 0.001 * grad * grad
                moments[k] = (m, v)
                w[k] = (w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(prior, w | fixed)


def _backward(w: dict[str, np.ndarray], f: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    error = ((_sigmoid(f["logit"]) - labels) / len(labels)).astype(np.float32)
    dz = error[:, None] * w["out"]
    dh = a[:, None] * dz[bag]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, f["first"])[bag])
    dtg = de[:, None] * w["rate"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = dh + dt @ w["look"].T + dg @ w["gate"].T
    pre = dh * (1 - h * h)
    return {
        "encode": f["x"].T @ pre, "encode0": pre.sum(0), "look": h.T @ dt, "look0": dt.sum(0), "gate": h.T @ dg, "gate0": dg.sum(0),
        "rate": (t * g).T @ de, "out": f["z"].T @ error, "out0": error.sum(),
    }


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the key as text, modulo ``folds``, is ``fold``; null keys are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(True))


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def sample(df: DataFrame, labels: DataFrame, label: str, key: str, text: str, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all passages, passage counts and labels of the bounded training sample, by ascending key."""
    known = labels.filter(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.avg(label).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(n))  # at most n rows
    step = BYTES_AT_ONCE // PASSAGE * PASSAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = _bytes(row.column("text"))[0]
                for part, a in enumerate(range(0, max(1, len(text)), step)):
                    f, counts = describe([text[a : a + step]])
                    columns = [row.column("id"), row.column("label"), pa.array([part]), pa.array(counts), pa.array([f.astype(np.float16).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "part", "n", "features"])

    docs = df.select(F.col(key).alias("_id"), whole_text(text).alias("text")).join(chosen, "_id")
    # A key that repeats counts once, with its first text.
    docs = docs.groupBy(F.col("_id").cast("long").alias("id"), "label").agg(F.min("text").alias("text"))
    scratch = Scratch(df.sparkSession, "quality")
    staged = scratch.stage(docs.mapInArrow(run, "id long, label double, part long, n long, features binary"), "features")
    total = staged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if not total:
        scratch.free("features")
        return np.zeros((0, KINDS + BYTES), np.float16), np.zeros(0, np.int64), np.zeros(0)
    features = np.memmap(tempfile.TemporaryFile(), np.float16, "w+", shape=(total, KINDS + BYTES))
    rounds, at, counts, values = math.ceil(total / PASSAGES_AT_ONCE), 0, [], []
    # Documents of a range of keys in each round, so that the file is in the order of the keys.
    shares = [k / rounds for k in range(1, rounds)]
    edges = staged.agg(F.percentile("id", F.array(*map(F.lit, shares)), F.col("n")).alias("e")).first().e if shares else []
    for low, high in zip([None, *edges], [*edges, None]):
        some = staged if low is None else staged.filter(F.col("id") > F.lit(low))
        some = some if high is None else some.filter(F.col("id") <= F.lit(high))
        for row in some.toArrow().sort_by([("id", "ascending"), ("part", "ascending")]).to_batches(max_chunksize=256):
            for part, m, value, f in zip(*(row.column(c).to_pylist() for c in ("part", "n", "label", "features"))):
                features[at : at + m] = np.frombuffer(f, np.float16).reshape(m, -1)
                at += m
                if part == 0:
                    counts.append(0)
                    values.append(value)
                counts[-1] += m
    scratch.free("features")
    return features, np.array(counts, np.int64), np.array(values)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns of ``df`` and ``score``, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache(None, None)
        m = shared.value
        for column in batches:
            parts = [column.iloc[a : a + TEXTS_AT_ONCE] for a in range(0, len(column), TEXTS_AT_ONCE)]
            found = [m.score([t.encode("utf-8", "surrogatepass") for t in part]) for part in parts]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    scores = F.pandas_udf(scores, "double")
    return df.drop("score").withColumn("score", scores(whole_text(text)))


def classify(df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``df``, and held_out, score and predicted (1 from a score of 0.5)."""
    model = fit(*sample(df, labels, label, key, text))
    out = score(df.drop("held_out", "predicted"), model, text)
    return out.withColumns({"held_out": held_out(key), "predicted": (F.col("score") >= 0.5).cast("int")})
