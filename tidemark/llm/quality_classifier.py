"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is described by shares of byte
classes, a hashed histogram of byte pairs and how far it compresses, and encoded by a learned
layer. A gated attention, a tanh part times a sigmoid part, weighs the passages; the weighted sum
of their encodings is the document's representation, and a logistic layer scores it. All of it is
learned from document labels alone. Training is on the driver, on a bounded sample of labelled
documents, each with all of its passages: those with the smallest hashes of their ids, SAMPLE of
them or as many as have SAMPLE_PASSAGES passages together. Scores cover all passages of all texts
and see nothing but the text.

Defined results: null and empty texts are one empty passage and get a score. Rows with equal texts
get equal scores. A document with several labels is good if all of them say so; null labels count
for nothing. Of rows that share an id, that with the least text is learned from. With no labels, or labels of one kind only, every score is that kind's share, or 0.5.
A null doc_id is never held out and never used for training.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ready

PASSAGE = 1024
PAIRS = 64
SAMPLE = 6000
SAMPLE_PASSAGES = 200_000
HIDDEN = 24
GATE = 12
EPOCHS = 40
SEED = 17
#: Bytes of the texts that are looked at together, whole passages of them.
TOGETHER = 1 << 18
#: Byte classes: each character of a string is one class; then letters, digits, other marks, other bytes.
CLASSES = ["\n", " ", "!", "?", ".", ",", "|", "#", "*", "$", "%", "&", "<", ">", "@", ":", "/", "-", "=", "\"'"]
WIDTH = len(CLASSES) + 5 + PAIRS + 2


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, len(CLASSES) + 4, dtype=np.int64)
    for byte in range(128):
        c = chr(byte)
        kind[byte] = next((i for i, s in enumerate(CLASSES) if c in s), len(CLASSES) + (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3))
    pairs = np.random.default_rng(SEED).integers(0, PAIRS, 1 << 16)
    return kind, pairs


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row per passage, and the number of passages of each text. Long texts are looked at in parts."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], dtype=np.int64)
    found, group, size = [np.zeros((0, WIDTH), dtype=np.float32)], [], 0
    for text in texts:
        for at in range(0, max(1, len(text)), TOGETHER):
            group.append(text[at : at + TOGETHER])
            size += len(group[-1])
            if size >= TOGETHER:
                found.append(_features(group))
                group, size = [], 0
    if group:
        found.append(_features(group))
    return np.concatenate(found), counts


def _features(texts: list[bytes]) -> np.ndarray:
    kind, pairs = _tables()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.cumsum(counts) - counts, sizes) + within // PASSAGE
    total = int(counts.sum())
    kinds = len(CLASSES) + 5
    classes = np.bincount(owner * kinds + kind[data], minlength=total * kinds).reshape(total, kinds)
    both = pairs[(data[:-1].astype(np.int64) << 8) | data[1:]]
    hashed = np.bincount(owner[:-1] * PAIRS + both, minlength=total * PAIRS)
    # Without the pairs over two passages, so that a passage's row depends on nothing beside it.
    over = np.flatnonzero(owner[:-1] != owner[1:])
    np.subtract.at(hashed, owner[over] * PAIRS + both[over], 1)
    hashed = hashed.reshape(total, PAIRS)
    length = classes.sum(1, keepdims=True)
    packed = np.array([len(zlib.compress(t[at : at + PASSAGE], 1)) for t in texts for at in range(0, max(1, len(t)), PASSAGE)])
    ratio = packed[:, None] / (length + 8)
    share = np.sqrt(np.concatenate([classes, hashed], axis=1) / np.maximum(1, length))
    return np.concatenate([share, ratio, np.log1p(length) / 7], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder W, b; gate V, U, w; score c, d; and the scaling of the features."""

    def __init__(self, seed: int = SEED, prior: float | None = None):
        draw = np.random.default_rng(seed)

        def layer(*shape: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.prior = prior
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": layer(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": layer(HIDDEN, GATE), "U": layer(HIDDEN, GATE), "w": layer(GATE, 1)[:, 0], "c": layer(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = _sigmoid(z @ p["c"] + p["d"])
        return y, {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "starts": starts, "counts": counts}

    def gradients(self, slope: np.ndarray, f: dict) -> dict[str, np.ndarray]:
        """slope is the derivative of the loss by the logit of each bag."""
        p, counts = self.p, f["counts"]
        dz = np.repeat(slope[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), counts))
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ slope, "d": slope.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        x, counts = features(texts)
        return self.forward((x - self.mean) / self.scale, counts)[0]


def train(bags: list[np.ndarray], quality: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Learns from bags of passage features and a 0 or 1 for each bag."""
    if len(bags) == 0 or quality.min() == quality.max():
        return Model(prior=float(quality.mean()) if len(bags) else 0.5)
    model, draw = Model(), np.random.default_rng(SEED)
    counts = np.array([len(b) for b in bags])
    model.mean = sum(b.sum(0, dtype=np.float64) for b in bags) / counts.sum()
    model.scale = np.sqrt(sum(((b - model.mean) ** 2).sum(0) for b in bags) / counts.sum()) + 1e-3
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = draw.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            y, kept = model.forward((np.concatenate([bags[i] for i in chosen]) - model.mean) / model.scale, counts[chosen])
            found = model.gradients((y - quality[chosen]) / len(chosen), kept)
            step += 1
            for k, v in model.p.items():
                g = found[k] + 1e-4 * v
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """A model of labels.quality from those documents that aren't held out: at most sample, of at most passages together."""
    ready(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # labels of other documents don't use up the sample
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    @F.pandas_udf("binary")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features([t.encode()])[0].tobytes() for t in batch])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    chosen = cut(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")))  # at most sample rows
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    fitting, taken = [], 0
    for row in chosen.select("doc_id", size.alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most sample rows
        if taken + row["size"] <= passages:  # a text that is too long for the rest is passed over, not what comes after it
            fitting.append((row["doc_id"],))
            taken += row["size"]
    fitting = docs.sparkSession.createDataFrame(fitting, "doc_id long")
    rows = chosen.join(F.broadcast(fitting), "doc_id").select("doc_id", "quality", described("text").alias("bag")).collect()  # at most sample documents and passages rows of features
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    return train(bags, np.array([r["quality"] for r in rows], dtype=np.float64))


def scorer(model: Model) -> Callable[[Column], Column]:
    """A function from a text column to scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts, group, size = [np.zeros(0)], [], 0
            for text in batch:
                group.append((text or "").encode())
                size += len(group[-1])
                if size >= TOGETHER:
                    parts.append(model.score(group))
                    group, size = [], 0
            if group:
                parts.append(model.score(group))
            yield pd.Series(np.concatenate(parts))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score and predicted."""
    score = scorer(fit(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """The documents with a score of 0.5 or more, with the columns they came with.

    The model is fit on examples, which are docs themselves if not given. Where docs were filtered
    before, examples should be what they were filtered from, as few bad documents are left in docs.
    """
    return docs.where(scorer(fit(docs if examples is None else examples, labels))(F.col("text")) >= 0.5)
