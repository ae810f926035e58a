"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage is encoded by a small tanh layer over its words (signed
counts in WORDS hashed places) and over counts of its characters and words (shares of letters, capitals, digits,
marks; word lengths; how many words are new to the passage, how many repeat the one before). Gated attention, tanh(V h) * sigmoid(U h), weighs the passages;
the weighted mean of their encodings gives the score. Only document labels are learned from, so that the
weights find for themselves which passages speak for a label.

The weights are fitted in numpy on at most SAMPLE labelled documents, chosen by a hash of doc_id, and at most BAG
passages of each, spread over its whole text; these bounds are parameters, and every document is scored over all
of its passages. A very long text is a bag of many passages.

Defined cases. Null or empty text: one passage of zeros, scored like any other. Null labels are not learned
from; with no labels, or one class only, the score is that class's smoothed share for all. A document's
label counts once for each of its rows. Repeated rows get equal scores. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, documents, slices, table, word_hashes, words_of

PASSAGE = 48
SAMPLE = 6000
BAG = 64  # passages of a document to learn from
WORDS = 24
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 40, 64, 0.01
KEEP = 0.7  # least score of predicted 1

_CLASS = np.zeros((6, 256), dtype=np.int64)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 192), (44, 46), [b for b in range(33, 127) if not chr(b).isalnum() and b not in (44, 46)])):
    _CLASS[_k, list(_bytes)] = 1
FEATURES = 6 + 8 + WORDS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a column of texts, and the offsets of the texts among them."""
    data, offsets = buffer_of(column)
    starts, stops, at = words_of(data, offsets)
    n_words = np.diff(at)
    n = np.maximum(1, -(-n_words // PASSAGE))
    edge = np.concatenate(([0], np.cumsum(n)))
    x = np.zeros((edge[-1], FEATURES))
    if not len(starts):
        return x, edge
    doc = np.repeat(np.arange(len(n)), n_words)
    owner = edge[:-1][doc] + (np.arange(len(doc)) - at[:-1][doc]) // PASSAGE
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.concatenate((first[1:], [len(owner)])) - 1
    p = owner[first]
    words = (last - first + 1).astype(float)
    a, b = starts[first], stops[last]
    size = stops - starts
    chars = np.add.reduceat(size, first).astype(float)
    for k in range(6):
        sums = np.concatenate(([0], np.cumsum(_CLASS[k].astype(np.int32)[data])))
        x[p, k] = (sums[b] - sums[a]) / chars
    h = word_hashes(data, starts, stops, 41)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    x[p, 6] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=edge[-1])[p] / words
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])))
    x[p, 7] = np.add.reduceat(again.astype(np.int64), first) / words
    x[p, 8] = np.log(chars / words)
    x[p, 9] = np.sqrt(np.maximum(0, np.add.reduceat(size.astype(float) ** 2, first) / words - (chars / words) ** 2)) / 8
    x[p, 10] = np.add.reduceat((size == 1).astype(np.int64), first) / words
    x[p, 11] = np.log(words) / 4
    lines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int64)))
    x[p, 12] = (lines[b] - lines[a]) / words
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    x[:, 14:] = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), sign, minlength=edge[-1] * WORDS).reshape(-1, WORDS) / 7
    caps = (data[starts] >= 65) & (data[starts] <= 90)
    x[p, 13] = np.add.reduceat(caps.astype(np.int64), first) / words
    return x, edge


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over the encoded passages of each bag."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = mean, scale, None
        self.w = {
            "W": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, dict]:
        w, first, n = self.w, edge[:-1], np.diff(edge)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        att = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        return _sigmoid(z @ w["c"] + w["d"]), {"x": x, "h": h, "t": t, "s": s, "att": att, "z": z, "n": n, "first": first}

    def gradients(self, y: np.ndarray, p: np.ndarray, m: dict) -> dict[str, np.ndarray]:
        w, rep = self.w, lambda v: np.repeat(v, m["n"], axis=0)
        g = (p - y) / len(y)
        dz = rep(g[:, None] * w["c"])
        datt = (dz * m["h"]).sum(1)
        de = m["att"] * (datt - rep(np.add.reduceat(m["att"] * datt, m["first"])))
        dt, ds = de[:, None] * w["a"] * m["s"] * (1 - m["t"] ** 2), de[:, None] * w["a"] * m["t"] * m["s"] * (1 - m["s"])
        dh = (m["att"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - m["h"] ** 2)
        return {"W": m["x"].T @ dh, "b": dh.sum(0), "V": m["h"].T @ dt, "U": m["h"].T @ ds, "a": (m["t"] * m["s"]).T @ de, "c": m["z"].T @ g, "d": np.array([g.sum()])}

    def score(self, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return np.full(len(edge) - 1, self.constant) if self.constant is not None else self.forward(x, edge)[0]


def train(x: np.ndarray, edge: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Adam on the log loss of document labels, decayed to a tenth."""
    if not len(y) or y.min() == y.max():
        model = Model(np.zeros(FEATURES), np.ones(FEATURES))
        model.constant = float((y.sum() + 0.5) / (len(y) + 1))
        return model
    model = Model(x.mean(0), x.std(0) + 1e-3, seed)
    r = np.random.default_rng(seed)
    m, v, step = ({k: np.zeros_like(a) for k, a in model.w.items()} for _ in range(2)), None, 0
    m, v = m
    total = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo : lo + BATCH]
            n = np.diff(edge)[pick]
            e = np.concatenate(([0], np.cumsum(n)))
            rows = np.repeat(edge[pick] - e[:-1], n) + np.arange(e[-1])
            p, mem = model.forward(x[rows], e)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in model.gradients(y[pick], p, mem).items():
                g = g + 1e-4 * model.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents that aren't held out."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(sample))  # bounded by `sample`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, edge = passages(batch.column(1))
            n = np.diff(edge)
            few = np.minimum(n, BAG)
            at = np.concatenate(([0], np.cumsum(few)))
            step = np.arange(at[-1]) - np.repeat(at[:-1], few)
            x, edge = x[np.repeat(edge[:-1], few) + step * np.repeat(n, few) // np.repeat(few, few)], at
            bags = pa.ListArray.from_arrays(pa.array((edge * FEATURES).astype(np.int32)), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), bags], names=["doc_id", "quality", "x"])

    bags = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = bags.mapInArrow(run, "doc_id long, quality int, x array<float>").toArrow().sort_by("doc_id")
    bags = pa.concat_arrays([pa.array([], pa.list_(pa.float32())), *rows.column("x").chunks])  # no lists of Python numbers, which would take many times as much
    x, edge = np.asarray(bags.flatten(), dtype=float).reshape(-1, FEATURES), np.asarray(bags.offsets).astype(np.int64) // FEATURES
    return train(x, edge, np.asarray(rows.column("quality"), dtype=float))


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with a column of scores; a column of that name is replaced."""
    docs = docs.drop(to)
    names = docs.columns
    at = names.index("text")
    schema = docs.withColumn(to, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(*passages(batch.column(at))))], names=[*names, to])

    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
