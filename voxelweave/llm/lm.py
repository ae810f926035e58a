"""Language-model scoring with a gated recurrent network.

Counts come from all rows for training: every token's count, N, V, the model's vocabulary (the VOCAB most
frequent tokens) and its classes (CLASS tokens of neighbouring rank). The network is a GRU in numpy whose output
is factored: the probability of a class, times that of the token in its class. One more class stands for all
other tokens, among which a token has its share by count, (c + 0.1) of the rest's sum. Output biases start as
the logarithms of the counts, so that the untrained network is the unigram model.

Training is truncated backpropagation over CHUNK tokens with the state carried on through the whole document, from
its first token to its end: first in one task on a sample of WARM documents, then every partition goes on from
there with all of its training documents, and the weights are averaged in a tree by tokens. So the weights depend
on how the table is dealt over partitions; nothing else does. Scoring carries the state through the whole document.

Tokens are known by 64-bit SipHash of their bytes. Counts of the HEAD most frequent ones travel with the scoring tasks (a
fixed number of them); those of the others are found by a join, whose keys are rare by construction, so that no
key is hot.

Defined cases. Null text: empty, one token (the end). No training documents: N and V are 0, every token has
base probability 1 and the network is untrained. Repeated rows count and train as often as they occur, and rows with
one doc_id and one text get equal scores; a null doc_id is not held out, as its remainder is unknown. A very long
text is tokenised whole, and its score takes memory for its tokens. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, cut, documents, lowered, slices, word_ids, words_of
from .repeats import keyed

VOCAB, CLASS = 4096, 64
EMBED, HIDDEN = 16, 32
HEAD = 1 << 18
WARM = 2500
CHUNK, BATCH = 32, 256
LEARN = 8192  # tokens of an update, at least
SLICE = 2 << 20
FANIN = 16
HELD = 1 << 20  # counts that a task adds up before they leave

_KEY = "tokens of op 7.."  # 16 bytes
_END = 7  # the end of a document as a token


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens as numbers among the distinct ones, each document's last being its end; the hashes of these; and
    the offsets of the documents among the tokens."""
    data, offsets = buffer_of(column)
    starts, stops, at = words_of(data, offsets)
    codes, distinct = word_ids(lowered(data), starts, stops)
    hashes = pd.util.hash_array(np.array([*distinct.to_pylist(), b""], dtype=object), hash_key=_KEY, categorize=False)[:-1]
    out = np.full(len(starts) + len(at) - 1, len(distinct), dtype=np.int32)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = codes
    return out, np.append(hashes, np.uint64(_END)), at + np.arange(len(at))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


class Lookup:
    """Counts of the most frequent tokens; the first VOCAB of them are the network's."""

    def __init__(self, th: np.ndarray, count: np.ndarray, n: int, v: int):
        self.n, self.v = n, v
        self.count = count.astype(float)  # by rank
        self.order = np.argsort(th)
        self.sorted = th[self.order]
        self.size = min(VOCAB, len(th))
        self.rest = n + 0.1 * (v + 1) - float((self.count[: self.size] + 0.1).sum())

    def rank(self, th: np.ndarray) -> np.ndarray:
        """Rank by frequency of each token, -1 for those not among the most frequent."""
        if not len(self.sorted):
            return np.full(len(th), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.sorted, th), len(self.sorted) - 1)
        return np.where(self.sorted[at] == th, self.order[at], -1)


def _thirds(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """What belongs to the update, the reset and the new gate."""
    return m[:, :HIDDEN], m[:, HIDDEN : 2 * HIDDEN], m[:, 2 * HIDDEN :]


def _sums(p: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product with ones, which is faster."""
    return p @ np.ones(p.shape[1], p.dtype)


def _start(n: int) -> np.ndarray:
    """States before a document: zeros, and the one that every state ends in, for biases."""
    h = np.zeros((n, HIDDEN + 1), np.float32)
    h[:, -1] = 1
    return h


class Network:
    """GRU with a class-factored output. Ids are ranks below size; size itself stands for every other token.

    Weights: E embeddings, X from these and R from the state to the gates (update, reset, new), C from the state to
    the classes, W to the tokens of each class. The last row of R and C, and the last column of W, are biases.
    """

    def __init__(self, lookup: Lookup, seed: int = 0):
        r, size = np.random.default_rng(seed), lookup.size
        self.size, self.classes = size, -(-size // CLASS)
        f = np.float32
        count = np.full(self.classes * CLASS, 1e-9)
        count[:size] = lookup.count[:size] + 0.1
        mass = np.append(count.reshape(-1, CLASS).sum(1), max(lookup.rest, 0.1))
        self.w = {
            "E": r.normal(0, 0.3, (size + 1, EMBED)).astype(f), "X": r.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)).astype(f),
            "R": np.concatenate((r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), np.zeros((1, 3 * HIDDEN)))).astype(f),
            "C": np.zeros((HIDDEN + 1, self.classes + 1), f), "W": np.zeros((self.classes, CLASS, HIDDEN + 1), f),
        }
        self.w["C"][-1] = np.log(mass / mass.sum())
        self.w["W"][:, :, -1] = np.log(count).reshape(-1, CLASS) - np.log(count.reshape(-1, CLASS).sum(1, keepdims=True))

    def steps(self, x: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """States before and after each column of input ids x, from states h; keep: and the gates.

        The gates (update, reset, new) are arrays of their own, so that all work on them is on whole arrays.
        """
        w = self.w
        table = [w["E"] @ part for part in _thirds(w["X"])]
        inner = [np.ascontiguousarray(part) for part in _thirds(w["R"])]
        n, t = x.shape
        x = np.ascontiguousarray(x.T)
        out = np.empty((t + 1, n, HIDDEN + 1), np.float32)
        out[:, :, -1] = 1
        out[0] = h
        held = np.empty((t if keep else 1, 4, n, HIDDEN), np.float32)
        state = np.ascontiguousarray(h[:, :HIDDEN])
        for i in range(t):
            z, r, q, c = held[i if keep else 0]
            for gate, g in ((0, z), (1, r)):
                np.matmul(out[i], inner[gate], out=g)
                g += table[gate].take(x[i], axis=0)
                np.negative(g, out=g)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
            np.matmul(out[i], inner[2], out=q)
            np.multiply(r, q, out=c)
            c += table[2].take(x[i], axis=0)
            np.tanh(c, out=c)
            state -= c
            state *= z
            state += c
            out[i + 1, :, :HIDDEN] = state
        return out, held

    def _classes(self, y: np.ndarray) -> np.ndarray:
        return np.where(y == self.size, self.classes, y // CLASS).astype(np.int16)

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each id y in state h (for size: of the class of all others)."""
        out, cls = np.empty(len(y)), self._classes(y)
        # states lie within 1 and weights are small: logits need no shift before exp
        for lo in range(0, len(y), 4096):
            part = slice(lo, lo + 4096)
            s = h[part] @ self.w["C"]
            own = s[np.arange(len(s)), cls[part]]
            out[part] = own - np.log(_sums(np.exp(s, out=s)))
        order = np.argsort(cls, kind="stable")
        edge, sorted_h, sorted_y = np.searchsorted(cls[order], np.arange(self.classes + 1)), h[order], y[order]
        inside = np.zeros(len(y))
        for c in range(self.classes):
            for lo in range(edge[c], edge[c + 1], 4096):
                part = slice(lo, min(lo + 4096, edge[c + 1]))
                s = sorted_h[part] @ self.w["W"][c].T
                own = s[np.arange(len(s)), sorted_y[part] - c * CLASS]
                inside[part] = own - np.log(_sums(np.exp(s, out=s)))
        out[order] += inside
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """One chunk: inputs x, targets y (-1: none), carried states h. Gradients of the sum of -log probabilities, and the new states."""
        w = self.w
        out, held = self.steps(x, h, keep=True)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        target = y.T.ravel()
        real = np.flatnonzero(target >= 0)
        cls = self._classes(target[real])
        order = np.argsort(cls, kind="stable")
        real, cls = real[order], cls[order]
        ys, hs = target[real], out[1:].reshape(-1, HIDDEN + 1)[real]
        dh = np.empty_like(hs)
        for lo in range(0, len(hs), 4096):
            part = slice(lo, lo + 4096)
            p = hs[part] @ w["C"]
            np.exp(p, out=p)
            p /= _sums(p)[:, None]
            p[np.arange(len(p)), cls[part]] -= 1
            grad["C"] += hs[part].T @ p
            dh[part] = p @ w["C"].T
        edge = np.searchsorted(cls, np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(edge)).tolist():
            part = slice(edge[c], edge[c + 1])
            p = hs[part] @ w["W"][c].T
            np.exp(p, out=p)
            p /= _sums(p)[:, None]
            p[np.arange(len(p)), ys[part] - c * CLASS] -= 1
            grad["W"][c] = p.T @ hs[part]
            dh[part] += p @ w["W"][c]
        n, t = x.shape
        d_out = np.zeros((t * n, HIDDEN), np.float32)
        d_out[real] = dh[:, :HIDDEN]
        d_out = d_out.reshape(t, n, HIDDEN)
        d = np.zeros((n, HIDDEN), np.float32)
        dz_all, dr_all, dn_all, dq_all = np.empty((4, t, n, HIDDEN), np.float32)
        back = [np.ascontiguousarray(part[:-1].T) for part in _thirds(w["R"])]
        one = np.empty((n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            (z, r, q, c), dz, dr, dn, dq = held[i], dz_all[i], dr_all[i], dn_all[i], dq_all[i]
            d += d_out[i]
            np.subtract(1, z, out=one)
            np.multiply(one, d, out=dn)
            one *= z
            np.subtract(out[i, :, :HIDDEN], c, out=dz)
            dz *= d
            dz *= one
            np.multiply(c, c, out=one)
            np.subtract(1, one, out=one)
            dn *= one
            np.multiply(dn, r, out=dq)
            np.subtract(1, r, out=one)
            np.multiply(dq, q, out=dr)
            dr *= one
            d *= z
            for part, m in zip((dz, dr, dq), back):
                np.matmul(part, m, out=one)
                d += one
        before = out[:-1].reshape(-1, HIDDEN + 1)
        flat = lambda v: v.reshape(-1, HIDDEN)
        grad["R"] = np.concatenate([before.T @ flat(v) for v in (dz_all, dr_all, dq_all)], axis=1)
        ids = x.T.ravel()
        inputs = w["E"].take(ids, axis=0)
        grad["X"] = np.concatenate([inputs.T @ flat(v) for v in (dz_all, dr_all, dn_all)], axis=1)
        to_inputs = sum(flat(v) @ part.T for v, part in zip((dz_all, dr_all, dn_all), _thirds(w["X"])))
        order = np.argsort(ids.astype(np.int16) if self.size < 1 << 15 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grad["E"][ids[first]] = np.add.reduceat(to_inputs[order], first, axis=0)
        return grad, out[-1]

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.w)
        return f.getvalue()

    def load(self, blob: bytes) -> "Network":
        with np.load(io.BytesIO(blob)) as f:
            self.w = {k: f[k] for k in f.files}
        return self


class Trainer:
    """Adam on the mean gradient of LEARN tokens or more, clipped to length 1."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step, self.seen, self.held = net, rate, 0, 0, 0
        self.m, self.v, self.sum = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(3))

    def chunk(self, ids: np.ndarray, h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Learns rows of ids, as Lanes gives them."""
        x, y = ids[:, :-1], ids[:, 1:]
        n = int((y >= 0).sum())
        if not n:
            return h
        grad, h = self.net.gradients(np.where(x < 0, self.net.size, x), y, h)
        for k, g in grad.items():
            self.sum[k] += g
        self.seen += n
        self.held += n
        if self.held >= LEARN:
            self.update()
        return h

    def update(self) -> None:
        if not self.held:
            return
        self.step += 1
        f = np.float32
        scale = 1 / self.held
        norm = scale * np.sqrt(sum(float(np.vdot(g, g)) for g in self.sum.values()))
        scale *= min(1.0, 1.0 / (norm + 1e-9))
        a, b = 1 - 0.9**self.step, 1 - 0.99**self.step
        for k, g in self.sum.items():
            g *= f(scale)
            self.m[k] += f(0.1) * (g - self.m[k])
            g *= g
            self.v[k] += f(0.01) * (g - self.v[k])
            self.net.w[k] -= f(self.rate / a) * self.m[k] / (np.sqrt(self.v[k] * f(1 / b)) + f(1e-6))
            g[...] = 0
        self.held = 0


class Lanes:
    """Whole documents, BATCH side by side: each lane takes a document from its first token to its last, CHUNK tokens
    at a time, with the state carried on, and then the next document, with a new state."""

    def __init__(self, chunk: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
        """chunk: gets rows of ids (-1: none), the first of which is input only, their states and their documents' numbers; returns the new states."""
        self.chunk = chunk
        self.flat = np.zeros(0, np.int32)  # the tokens that are left, of lanes and queue
        self.at, self.end, self.number = (np.zeros(BATCH, dtype=np.int64) for _ in range(3))
        self.fresh = np.zeros(BATCH, dtype=bool)
        self.h = _start(BATCH)
        self.queue: list[tuple[int, np.ndarray]] = []
        self.taken = 0

    def _gather(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Puts what lanes still have and all waiting documents, the longest first, one after another; numbers, starts and ends of the latter."""
        waiting = [*self.queue, *enumerate(docs, self.taken)]
        waiting.sort(key=lambda d: -len(d[1]))
        self.taken += len(docs)
        busy = np.flatnonzero(self.at < self.end)
        parts = [self.flat[max(0, a - 1) : b] for a, b in zip(self.at[busy].tolist(), self.end[busy].tolist())]
        before = np.minimum(1, self.at[busy])  # the token before, which is an input
        edge = np.concatenate(([0], np.cumsum([len(p) for p in parts] + [len(d) for _, d in waiting])))
        self.flat = np.concatenate([*parts, *(d for _, d in waiting), np.zeros(0, np.int32)]).astype(np.int32)
        self.at[:], self.end[:] = 0, 0
        self.at[busy], self.end[busy] = edge[: len(busy)] + before, edge[1 : len(busy) + 1]
        return np.array([i for i, _ in waiting], dtype=np.int64), edge[len(busy) : -1], edge[len(busy) + 1 :]

    def take(self, docs: list[np.ndarray], last: bool = False) -> None:
        """Goes through docs until a lane finds no next one; last: to the end of all. Documents are numbered as they come."""
        number, start, end = self._gather(docs)
        q, col = 0, np.arange(-1, CHUNK)
        while True:
            free = np.flatnonzero(self.at >= self.end)[: len(number) - q]
            if len(free):
                own = slice(q, q + len(free))
                self.at[free], self.end[free], self.number[free] = start[own], end[own], number[own]
                self.h[free], self.fresh[free] = _start(1), True
                q += len(free)
            busy = np.flatnonzero(self.at < self.end)
            if not len(busy) or (len(busy) < BATCH and not last):
                break
            place = self.at[busy][:, None] + col
            ids = self.flat[np.clip(place, 0, len(self.flat) - 1)].astype(np.int64)
            ids[place >= self.end[busy][:, None]] = -1
            ids[self.fresh[busy], 0] = 0
            self.h[busy] = self.chunk(ids, self.h[busy], self.number[busy])
            self.fresh[busy] = False
            self.at[busy] += CHUNK
        self.queue = [(int(number[i]), self.flat[start[i] : end[i]]) for i in range(q, len(number))]


def counts(docs: DataFrame) -> DataFrame:
    """(th, c): every token of the training documents and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            th, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return th, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            th, c = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(th.view(np.int64)), pa.array(c)], names=["th", "c"])

        for batch in slices(batches, most=SLICE):
            codes, th, _ = tokens_of(batch.column(0))
            held.append((th, np.bincount(codes, minlength=len(th))))
            size += len(th)
            if size >= HELD:  # slices are added up here, so that fewer rows leave
                held[:] = [summed()]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield out()
                    size = 0
        if held:
            held[:] = [summed()]
            yield out()

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "th long, c long").groupBy("th").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, lookup: Lookup) -> Network:
    """Warm start on WARM whole documents, then every token of every training document, averaged over the partitions."""
    spark = docs.sparkSession
    train = docs.where(~held_out(F.col("doc_id")))
    net = Network(lookup)
    if not lookup.size:
        return net

    def learner(blob, rate: float):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, look = blob.value
            local = Trainer(Network(look).load(start), rate)
            lanes = Lanes(local.chunk)
            for batch in slices(batches, most=SLICE):
                codes, th, at = tokens_of(batch.column(0))
                rank = look.rank(th)
                lanes.take(np.split(np.where((rank >= 0) & (rank < look.size), rank, look.size).astype(np.int32)[codes], at[1:-1]))
            lanes.take([], last=True)
            local.update()
            yield pa.RecordBatch.from_arrays([pa.array([local.seen]), pa.array([local.net.dump()], pa.binary())], names=["n", "w"])

        return learn

    # of a size fixed by VOCAB and HEAD, as is the next one
    ids = train.select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(WARM)
    some = train.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text")  # bounded by WARM
    warm = some.select("text").mapInArrow(learner(spark.sparkContext.broadcast((net.dump(), lookup)), 0.01), "n long, w binary").where("n > 0").first()
    if warm:
        net.load(bytes(warm["w"]))
    go_on = learner(spark.sparkContext.broadcast((net.dump(), lookup)), 0.004)

    fan = FANIN  # goes along to the workers

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total, n, one = None, int(pdf["n"].sum()), Network(lookup_small)
        for k, blob_ in zip(pdf["n"], pdf["w"]):
            part = {name: a * np.float32(k / max(1, n)) for name, a in one.load(blob_).w.items()}
            total = part if total is None else {name: total[name] + part[name] for name in part}
        one.w = total
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0]) // fan], "n": [n], "w": [one.dump()]})

    lookup_small = Lookup(np.zeros(0, dtype=np.int64), np.zeros(0), 0, 0)
    parts = train.select("text").mapInArrow(go_on, "n long, w binary").where("n > 0")
    parts = cut(parts.withColumn("g", F.spark_partition_id().cast("long")))
    left = parts.count()
    while left > 1:  # in groups of `fan`, so that no task reads more than a fixed number of weights
        order = parts.select("g").distinct().orderBy("g")
        known = {r["g"]: i for i, r in enumerate(order.collect())}  # a number for each partition that is left
        number = spark.createDataFrame([(g, i) for g, i in known.items()], "g long, i long")
        parts = cut(parts.join(number, "g").select(F.col("i").alias("g"), "n", "w").groupBy(F.expr(f"g div {fan}").alias("k")).applyInPandas(average, "g long, n long, w binary"))
        left = parts.count()
    last = parts.first()
    return net.load(bytes(last["w"])) if last else net


class Scorer:
    """Natural log probability of documents, the state carried from the first token of each to its last."""

    def __init__(self, net: Network):
        self.net, self.lanes, self.sums = net, Lanes(self.chunk), []
        self.first = 0  # number of the document that sums begins with
        self.left: list[int] = []  # tokens that each still waits for

    def chunk(self, ids: np.ndarray, h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        x, y = ids[:, :-1], ids[:, 1:].T.ravel()
        out, _ = self.net.steps(np.where(x < 0, self.net.size, x), h)
        real = np.flatnonzero(y >= 0)
        p = self.net.log_probs(out[1:].reshape(-1, HIDDEN + 1)[real], y[real])
        row = real % len(ids)
        for i, v, n in zip(numbers.tolist(), np.bincount(row, p, minlength=len(ids)).tolist(), np.bincount(row, minlength=len(ids)).tolist()):
            self.sums[i - self.first] += v
            self.left[i - self.first] -= n
        return out[-1]

    def take(self, docs: list[np.ndarray], last: bool = False) -> None:
        self.sums += [0.0] * len(docs)
        self.left += [len(d) for d in docs]
        self.lanes.take(docs, last)

    def done(self, n: int) -> np.ndarray | None:
        """The results of the next n documents, if all of them are there."""
        if any(self.left[:n]):
            return None
        out = np.array(self.sums[:n])
        del self.sums[:n], self.left[:n]
        self.first += n
        return out


def document_log_probs(net: Network, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    scorer = Scorer(net)
    scorer.take(np.split(ids, at[1:-1]), last=True)
    return scorer.done(len(at) - 1)


def score(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_tokens, n_known, train_tokens, base_score, score) of each of docs, which has one row for each key of the keyed rows.

    Counts and training take all rows, repeated or not.
    """
    spark = docs.sparkSession
    table = cut(counts(rows))
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = table.orderBy(F.desc("c"), "th").limit(HEAD).toArrow()  # a fixed number of rows
    lookup = Lookup(np.asarray(head.column("th")).view(np.uint64).copy(), np.asarray(head.column("c")), int(n), int(v))
    net = fit(rows, lookup)
    shared = spark.sparkContext.broadcast((lookup, net.dump()))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, blob = shared.value
        scorer, waiting = Scorer(Network(look).load(blob)), []

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and (log_probs := scorer.done(waiting[0][0])) is not None:
                yield waiting.pop(0)[1](log_probs / np.log(10))

        for batch in slices(batches, most=SLICE):
            codes, th, at = tokens_of(batch.column(1))
            rank = look.rank(th)
            seen = np.where(rank >= 0, np.log10(look.count[np.maximum(rank, 0)] + 0.1) if len(look.count) else 0.0, 0.0)
            ids = np.where((rank >= 0) & (rank < look.size), rank, look.size).astype(np.int32)[codes]
            log, known, own = seen[codes], (rank >= 0)[codes], ids < look.size
            size = np.diff(at)
            n = len(size)
            owner = np.repeat(np.arange(n), size)
            beside = np.bincount(owner[~own], log[~own], minlength=n) - np.bincount(owner[~own], minlength=n) * np.log10(max(look.rest, 0.1))
            rare = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(owner[~known], minlength=n)))).astype(np.int32), pa.array(th[codes[~known]].view(np.int64)))
            cols = [batch.column(0), batch.column(2), pa.array(size), pa.array(np.bincount(owner[known], minlength=n)), pa.array(np.bincount(owner, log, minlength=n))]

            def row(neural: np.ndarray, cols: list = cols, beside: np.ndarray = beside, rare: pa.Array = rare) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*cols, pa.array(neural + beside), rare], names=["key", "doc_id", "n_tokens", "known", "head", "neural", "rare"])

            waiting.append((n, row))
            scorer.take(np.split(ids, at[1:-1]))
            yield from ready()
        scorer.take([], last=True)
        yield from ready()

    rows = cut(docs.select("key", "text", "doc_id").mapInArrow(run, f"key {kind}, doc_id long, n_tokens long, known long, head double, neural double, rare array<long>"))
    rare = rows.select("key", F.explode("rare").alias("th"))
    rare = rare.join(table, "th", "left").groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail"), F.count("c").alias("more"))
    out = rows.join(rare, "key", "left").withColumn("tail", F.coalesce("tail", F.lit(0.0)))
    return out.select(
        "key", "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lookup.n).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("tail") - F.col("n_tokens") * float(np.log10(lookup.n + 0.1 * (lookup.v + 1)))).alias("base_score"), (F.col("neural") + F.col("tail")).alias("score"),
    )


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docs = keyed(documents(spark, sf_dir))
    out = score(rows, docs)
    if rows is not docs:  # repeated rows: each document is scored once
        out = rows.select("key").join(out, "key")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
