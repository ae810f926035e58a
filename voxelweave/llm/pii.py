"""Personal data: patterns, and a character BiLSTM-CRF that adds what they miss.

The patterns (email, ip, card, phone) give the base spans. On at most SAMPLE documents, chosen by a hash of doc_id,
they also give the labels that the tagger is trained from in numpy: a bidirectional LSTM over characters, with CRF
transitions between the tags O and B, I of each kind. Half of the spans that it learns from are first written as
people write them to evade patterns (an "at" for the @, other gaps between digits, a missing plus), so that it learns
from their surroundings and shape what the patterns can't match.

Every text is tagged from end to end in overlapping windows of WIDTH characters. Emissions of overlapping windows are
averaged, and one Viterbi path runs over the whole document: where O is so much likelier that no path through another
tag can be best, whatever is beside it, it is O, and what lies between such places is decoded. A span of the tagger is added if it meets no base span, its margin over O is
MARGIN a character, and it reads as its kind once gaps are taken out (a whole address, four numbers up to 255, a
Luhn number of 12 to 19 digits, 9 to 15 digits).

Defined cases. Null text: empty, no spans. No labels to learn from: base spans only. Rows are judged one by one,
repeated or not. Windows of a very long text are run in parts, of which only the emissions to decode are kept, and its path is one. No rows: no rows. Other columns
are ignored, and kept by redact(), whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, one_thread, slices, unused

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 64, 32
SAMPLE = 1500  # documents that labels are taken from
WINDOWS = 4  # of each, and as many with its spans rewritten
MARGIN = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a number can only match from its first digit, and giving digits back never helps: so the runs are possessive
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind), sorted: leftmost matches of each pattern that don't overlap, less those failing its test."""
    out = []
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out)


# --- the tagger -------------------------------------------------------------------------------------------------

K = 1 + 2 * len(KINDS)
_PAD, _LETTER, _OTHER = 130, 128, 129


def codes(text: str) -> np.ndarray:
    """A small alphabet: ASCII, other letters, the rest."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(x < 128, x, np.where(x < 0x2000, _LETTER, _OTHER)).astype(np.int64)


_TRIGGER = re.compile(r"[0-9@]|[\[({<]\x20?at\x20?[\])}>]|\bdot\b", re.I)


def windows_of(text: str) -> np.ndarray:
    """The numbers k of the windows (middles [k * STRIDE, (k+1) * STRIDE)) that hold a trigger: those that teach what isn't a span."""
    hit = np.array([m.start() for m in _TRIGGER.finditer(text)], dtype=np.int64)
    side = (WIDTH - STRIDE) // 2
    k = np.unique(np.concatenate([(hit - side) // STRIDE, hit // STRIDE, (hit + side) // STRIDE]))
    return k[(k >= 0) & (k * STRIDE < len(text))]


def cut_windows(x: np.ndarray, k: np.ndarray, fill: int) -> np.ndarray:
    side = (WIDTH - STRIDE) // 2
    padded = np.concatenate((np.full(side, fill), x, np.full(WIDTH, fill)))
    return padded[(k * STRIDE)[:, None] + np.arange(WIDTH)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    D, H = 10, 14

    def __init__(self, seed: int = 0):
        r, d, h = np.random.default_rng(seed), self.D, self.H
        self.w = {"E": r.normal(0, 0.3, (_PAD + 1, d)), "O": r.normal(0, 0.3, (2 * h, K)), "o": np.zeros(K), "A": np.zeros((K, K)), "S": np.zeros(K)}
        for side in "fb":
            self.w |= {f"X{side}": r.normal(0, d**-0.5, (d, 4 * h)), f"R{side}": r.normal(0, h**-0.5, (h, 4 * h)), f"c{side}": np.zeros(4 * h)}
            self.w[f"c{side}"][:h] = 1  # forget gates start open

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        w, h = self.w, self.H
        n, t, _ = x.shape
        pre = x @ w[f"X{side}"] + w[f"c{side}"]
        out, mem = np.zeros((n, t, h)), []
        s, c = np.zeros((n, h)), np.zeros((n, h))
        for i in range(t):
            z = pre[:, i] + s @ w[f"R{side}"]
            g = _sigmoid(z[:, : 3 * h])
            f, a, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, last = c, s
            c = f * c + a * u
            q = np.tanh(c)
            s = o * q
            out[:, i] = s
            mem.append((f, a, o, u, before, q, last))
        return out, mem

    def _lstm_back(self, x: np.ndarray, side: str, mem: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
        w, h = self.w, self.H
        dz_all = np.zeros((*x.shape[:2], 4 * h))
        ds, dc = np.zeros(d_out[:, 0].shape), np.zeros(d_out[:, 0].shape)
        for i in range(x.shape[1] - 1, -1, -1):
            f, a, o, u, before, q, last = mem[i]
            ds = ds + d_out[:, i]
            dc = dc + ds * o * (1 - q * q)
            dz = np.concatenate((dc * before * f * (1 - f), dc * u * a * (1 - a), ds * q * o * (1 - o), dc * a * (1 - u * u)), axis=1)
            dz_all[:, i] = dz
            grad[f"R{side}"] += last.T @ dz
            ds, dc = dz @ w[f"R{side}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * h)
        grad[f"X{side}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"c{side}"] += flat.sum(0)
        return dz_all @ w[f"X{side}"].T

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["E"][ids]
        f, mf = self._lstm(x, "f")
        b, mb = self._lstm(x[:, ::-1], "b")
        hidden = np.concatenate((f, b[:, ::-1]), axis=2)
        return hidden @ self.w["O"] + self.w["o"], (x, mf, mb, hidden)

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """Emissions (2 * STRIDE, K, n) of the n windows that neighbouring cells of codes, (n + 1, STRIDE), make up.

        As emissions(), but on arrays by feature, in 32 bits, and with all gates made by one function: the logistic one of x is
        (1 + tanh(x / 2)) / 2. The state is held twice as large, which the weights that it meets make up for.
        """
        w, h, n, f = self.w, self.H, len(cells) - 1, np.float32
        embed = np.ascontiguousarray(w["E"].T.astype(f))
        known = [np.take(embed, x, axis=1, mode="clip") for x in np.ascontiguousarray(cells.T)]
        half = np.repeat(f([0.5, 1]), [3 * h, h])
        out = np.empty((WIDTH, K, n), f)
        z, both, q = np.empty((4 * h, n), f), np.empty((h + self.D + 1, n), f), np.empty((h, n), f)
        s, x, open_, keep, take, give, u = both[:h], both[h:-1], z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        for side, steps in (("f", range(WIDTH)), ("b", range(WIDTH - 1, -1, -1))):
            m = np.ascontiguousarray((np.concatenate((w[f"R{side}"] / 2, w[f"X{side}"], w[f"c{side}"][None])) * half).T.astype(f))
            top = np.ascontiguousarray((w["O"][:h] if side == "f" else w["O"][h:]).T.astype(f) / 2)
            s[:], both[-1], c = 0, 1, np.zeros((h, n), f)
            for i in steps:
                x[:] = known[i % STRIDE][:, i // STRIDE : i // STRIDE + n]
                np.matmul(m, both, out=z)
                np.tanh(z, out=z)
                open_ += 1
                c *= keep
                u *= take
                c += u
                c *= 0.5
                np.tanh(c, out=q)
                np.multiply(q, give, out=s)
                if side == "f":
                    np.matmul(top, s, out=out[i])
                else:
                    out[i] += top @ s
        out += w["o"].astype(f)[:, None]
        return out

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        w, (n, t) = self.w, ids.shape
        e, (x, mf, mb, hidden) = self.emissions(ids)
        alpha, beta = np.zeros((n, t, K)), np.zeros((n, t, K))
        alpha[:, 0] = e[:, 0] + w["S"]
        for i in range(1, t):
            alpha[:, i] = e[:, i] + _lse(alpha[:, i - 1, :, None] + w["A"], 1)
        for i in range(t - 2, -1, -1):
            beta[:, i] = _lse(w["A"] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        pair = alpha[:, :-1, :, None] + w["A"] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        grad["A"] = np.exp(pair).sum((0, 1))
        np.add.at(grad["A"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, cols, tags].sum(1) + w["S"][tags[:, 0]] + w["A"][tags[:, :-1], tags[:, 1:]].sum(1)
        de[rows, cols, tags] -= 1
        grad["S"] = de[:, 0].sum(0)
        flat = de.reshape(-1, K)
        grad["O"], grad["o"] = hidden.reshape(-1, 2 * self.H).T @ flat, flat.sum(0)
        dh = de @ w["O"].T
        dx = self._lstm_back(x, "f", mf, dh[:, :, : self.H], grad)
        dx = dx + self._lstm_back(x[:, ::-1], "b", mb, dh[:, ::-1, self.H :], grad)[:, ::-1]
        np.add.at(grad["E"], ids.ravel(), dx.reshape(-1, self.D))
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def paths(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi tags of sequences of emissions, padded after size[i]; before and after each stands O."""
        n, t, _ = e.shape
        a = self.w["A"]
        score, back = e[:, 0] + a[0], np.zeros((n, t, K), dtype=np.int8)
        at_end = np.where((size == 1)[:, None], score, 0.0)
        for i in range(1, t):
            s = score[:, :, None] + a
            back[:, i] = s.argmax(1)
            score = s.max(1) + e[:, i]
            at_end = np.where((size == i + 1)[:, None], score, at_end)
        rows, tags = np.arange(n), np.zeros((n, t), dtype=np.int8)
        tag = (at_end + a[:, 0]).argmax(1)
        for i in range(t - 1, -1, -1):
            inside = i < size
            tags[:, i] = np.where(inside, tag, 0)
            tag = np.where(inside, back[rows, i, tag], tag)
        return tags


def train(ids: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 48, rate: float = 0.03, seed: int = 0) -> Tagger:
    tagger, r = Tagger(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in tagger.w.items()} for _ in range(2))
    step, order = 0, np.zeros(0, dtype=np.int64)
    while step < steps:
        if len(order) < batch:
            order = np.concatenate((order, r.permutation(len(ids))))
        pick, order = order[:batch], order[batch:]
        step += 1
        x = ids[pick]
        # digits change places with digits, so that the shape is learned and not the number
        x = np.where((x >= 48) & (x <= 57), r.integers(48, 58, x.shape), x)
        _, grad = tagger.gradients(x, tags[pick])
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            tagger.w[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return tagger


def rewritten(kind: int, span: str, r: random.Random) -> str:
    """A span as it is written to evade patterns."""
    if kind == 0:
        name, _, domain = span.partition("@")
        dot = r.choice([".", " dot ", "[dot]", " . "])
        return name + r.choice([" at ", "(at)", "[at]", " @ ", " (at) ", " AT "]) + domain.replace(".", dot)
    if kind == 1:
        return r.choice([" . ", ". ", "[.]", " .", ", "]).join(span.split("."))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        gap = r.choice([".", "  ", " - ", "/", "_", ". ", "\n", "--"])
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    body = span[1:] if r.random() < 0.7 else span
    if r.random() < 0.5:
        gap = r.choice(["/", " / ", "-", ".", " ", "\n"])
        parts = re.findall("[0-9]+", body)
        body = gap.join(parts if len(parts) > 1 else [digits[:2], digits[2:5], digits[5:]])
    return r.choice(["", "", "00", "tel. "]) + body


def examples(doc_id: int | None, text: str, r: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The text with its base spans, and once more with all spans rewritten."""
    spans = base_spans(text)
    out = [(text, spans)]
    apart = [s for i, s in enumerate(spans) if all(s[0] >= e or s[1] <= b for b, e, _ in spans[:i] + spans[i + 1 :])]
    if apart:
        parts, new, size, low = [], [], 0, 0
        for a, b, k in apart:
            word = rewritten(k, text[a:b], r)
            own = size + a - low
            parts += [text[low:a], word]
            begin = own + (5 if word.startswith("tel. ") else 0)
            new.append((begin, own + len(word), k))
            size, low = own + len(word), b
        out.append(("".join([*parts, text[low:]]), new))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger from the base spans of at most `sample` documents; None if there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t, spans in examples(doc_id, text, random.Random(zlib.crc32(str(doc_id).encode()))):
                    x, tags = codes(t), np.zeros(len(t), dtype=np.int64)
                    for a, b, k in spans:
                        tags[a:b] = 2 + 2 * k
                        tags[a] = 1 + 2 * k
                    held = np.unique([p // STRIDE for a, b, _ in spans for p in (a, (a + b) // 2, b - 1)]).astype(np.int64)
                    other = np.setdiff1d(windows_of(t), held)
                    few = lambda k, n: k[np.linspace(0, len(k) - 1, min(n, len(k))).astype(int)]
                    k = np.concatenate((few(held, WINDOWS - 1), few(other, 1)))
                    out += [(doc_id, p.tolist(), q.tolist()) for p, q in zip(cut_windows(x, k, _PAD), cut_windows(tags, k, 0))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["doc_id", "x", "tags"])

    rows = docs.where("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text")  # bounded by `sample`
    found = rows.mapInArrow(run, "doc_id long, x array<int>, tags array<int>").orderBy("doc_id", "x").toArrow()
    if not found.num_rows:
        return None
    x, tags = (np.asarray(found.column(k).to_pylist(), dtype=np.int64) for k in ("x", "tags"))
    return train(x, tags) if tags.any() else None


PART = 640  # windows that are run at a time: few enough for OpenBLAS to multiply without packing, up to a million products


ROUNDS = 2  # that places beside each other are judged by
NEAR = 8192  # places that are judged at a time


def certain(a: np.ndarray, pos: np.ndarray, e: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """Which of the places pos, all others being O, are O on the best path; a: transitions, e: emissions; before, after:
    whether there are more places, of which nothing is known here.

    Bounds on how much better than O's a tag's best path before and after can be, carried on to the neighbours.
    """
    a, n = a.astype(np.float32), len(pos)
    d = np.ascontiguousarray((e - e[:, :1]).T)
    beside = np.concatenate(([False], pos[1:] == pos[:-1] + 1, [False]))
    out = []
    for m, follows in ((a, True), (a.T, False)):
        cap = (m - m[:, :1]).max(0)[:, None]
        best = np.broadcast_to(cap, (K, n)).copy()
        for _ in range(2):
            prev = np.full((K, n), -np.inf, np.float32)
            prev[0] = 0
            if n and (before if follows else after):
                prev[1:, 0 if follows else -1] = np.inf
            if follows:
                prev[:, 1:] = np.where(beside[1:-1], (best + d)[:, :-1], prev[:, 1:])
            else:
                prev[:, :-1] = np.where(beside[1:-1], (best + d)[:, 1:], prev[:, :-1])
            new = best.copy()
            for k in range(1, K):
                x = prev[0] + m[0, k]
                for p in range(1, K):
                    np.maximum(x, prev[p] + m[p, k], out=x)
                np.minimum(best[k], x - m[0, 0], out=new[k])
            best = new
        out.append(best)
    return (out[0] + out[1] + d)[1:].max(0) < -1e-3


def undecided(tagger: Tagger, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and emissions of each character, of all texts in turn, that isn't O whatever is beside it."""
    side = (WIDTH - STRIDE) // 2
    # a text takes a cell more than it has windows: window k holds the cells k and k + 1, the first of which starts with `side` spare places
    count = np.array([-(-len(x) // STRIDE) + 1 for x in xs])
    at = np.concatenate(([0], np.cumsum(count)))
    cells = np.full((at[-1] + 1, STRIDE), _PAD, dtype=np.uint8)
    flat = cells.reshape(-1)
    for a, x in zip((at[:-1] * STRIDE + side).tolist(), xs):
        flat[a : a + len(x)] = x
    real = np.ones(at[-1], dtype=np.float32)
    real[at[1:] - 1] = 0  # between two texts
    share = 1 / np.maximum(1, real + np.concatenate(([0], real[:-1])))
    # by how much a tag before and after can speak for each tag rather than O
    a = tagger.w["A"]
    most = ((a - a[:, :1]).max(0) + (a - a[:1]).max(1)).astype(np.float32)[1:, None]
    carry, found = np.zeros((STRIDE, K), np.float32), [(np.zeros(0, dtype=np.int64), np.zeros((0, K), np.float32))]
    for lo in range(0, len(real), PART):
        hi = min(lo + PART, len(real))
        e = tagger.scores(cells[lo : hi + 1])
        e[:, :, real[lo:hi] == 0] = 0
        total = e[:STRIDE]
        total[:, :, 1:] += e[STRIDE:, :, :-1]
        total[:, :, 0] += carry
        carry = e[STRIDE:, :, -1].copy()
        total *= share[lo:hi].astype(np.float32)
        open_ = ((total[:, 1:] + most).max(1) - total[:, 0] > -1e-3).T & (cells[lo:hi] != _PAD)
        cell, place = np.nonzero(open_)
        found.append(((cell + lo) * STRIDE + place, total[place, :, cell]))
    pos, e = (np.concatenate(x) for x in zip(*found))
    for _ in range(ROUNDS):  # the more is decided, the more its neighbours are
        left = ~np.concatenate([certain(a, pos[x : x + NEAR], e[x : x + NEAR], x > 0, x + NEAR < len(pos)) for x in range(0, max(1, len(pos)), NEAR)])
        pos, e = pos[left], e[left]
    text = np.searchsorted(at, pos // STRIDE, side="right") - 1
    return text, pos - at[text] * STRIDE - side, e


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) that the tagger finds in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    doc, place, e = undecided(tagger, [codes(t) for t in texts])
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)))) if len(doc) else np.zeros(0, dtype=np.int64)
    base = np.append(first, len(doc))
    size = np.diff(base)
    tags = np.zeros(len(doc), dtype=np.int64)
    order, lo = np.argsort(size, kind="stable"), 0
    while lo < len(order):  # sequences of about one length together
        hi = lo + max(1, min(4096, (1 << 17) // int(size[order[lo]])))
        some = order[lo:hi][size[order[lo:hi]] <= 2 * size[order[lo]]]
        t = np.arange(int(size[some].max()))
        there = t[None, :] < size[some][:, None]
        at = np.where(there, base[some][:, None] + t, 0)
        tags[at[there]] = tagger.paths(e[at], size[some])[there]
        lo += len(some)
    for begin, end, kind in _read(tags, e, first):
        out[doc[begin]].append((int(place[begin]), int(place[end - 1]) + 1, kind))
    whole = [[(*_whole(k, text, a, b), k) for a, b, k in found] for text, found in zip(texts, out)]
    return [[s for s in dict.fromkeys(found) if _reads_as(s[2], text[s[0] : s[1]])] for text, found in zip(texts, whole)]


def _read(tags: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans with enough margin over O, of paths that begin at the places `first` of tags, in order."""
    some = np.flatnonzero(tags)
    if not len(some):
        return []
    tag = tags[some]
    kind = (tag - 1) // 2
    goes_on = np.concatenate(([False], (some[1:] == some[:-1] + 1) & (tag[1:] % 2 == 0) & (kind[1:] == kind[:-1])))
    goes_on &= ~np.isin(some, first)
    start = np.flatnonzero(~goes_on)
    size = np.diff(np.append(start, len(some)))
    margin = np.add.reduceat((e[some, tag] - e[some, 0]).astype(np.float64), start)
    keep = margin >= MARGIN * size
    begin = some[start[keep]]
    return list(zip(begin.tolist(), (begin + size[keep]).tolist(), kind[start[keep]].tolist()))


_AT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


_LOCAL_TAIL, _NAME, _NUMBER = re.compile(r"[A-Za-z0-9._%+-]*$"), re.compile("[A-Za-z0-9-]*"), re.compile("[0-9]*")


def _whole(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """The tagged part [a, b) made to begin and end with a whole name or number."""
    if kind == 0:
        at = _AT.search(text, a, b)
        if at:
            a = _LOCAL_TAIL.search(text, max(0, at.start() - 64), at.start()).start()
        return a, _NAME.match(text, b).end()
    digit = lambda i: 0 <= i < len(text) and text[i] in "0123456789"
    while digit(a - 1) and digit(a):
        a -= 1
    return a, _NUMBER.match(text, b).end() if digit(b - 1) else b


def _reads_as(kind: int, part: str) -> bool:
    """Whether a tagged part is of its kind, but for how it is written."""
    if kind == 0:
        return bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", part))))
    if re.search(r"[^\W\d_]", part):
        return False
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(n.lstrip("0")) < 4 and int(n) <= 255 for n in numbers)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find(docs: DataFrame, tagger: Tagger | None, to: str = "spans") -> DataFrame:
    """docs with spans: (kind, start, end, base) by start, then kind as listed; code points, end exclusive.

    A column named as `to` is replaced.
    """
    docs = docs.drop(to)
    names = docs.columns
    at = names.index("text")
    schema = docs.withColumn(to, F.lit(None).cast(_SPANS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in slices(batches):
            texts = batch.column(at).fill_null("").to_pylist()
            base = [base_spans(t) for t in texts]
            more = tagged_spans(tagger, texts) if tagger else [[]] * len(texts)
            spans: list[list[dict]] = []
            for b, m in zip(base, more):
                own = [s for s in m if all(s[1] <= x or s[0] >= y for x, y, _ in b)]
                spans.append([{"kind": KINDS[k], "start": x, "end": y, "base": z} for x, y, k, z in sorted([(*s, True) for s in b] + [(*s, False) for s in own], key=lambda s: (s[0], s[2], s[1]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW)], names=[*names, to])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of overlapping spans the first stands for all."""
    to = unused("pii_spans", docs.columns)
    found = find(docs, tagger, to)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    step = lambda a, s: F.when(s["start"] < a["end"], F.struct(a["out"].alias("out"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(
        F.struct(F.concat(a["out"], F.substr(F.col("text"), a["end"] + 1, s["start"] - a["end"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("end")))
    done = F.aggregate(to, zero, step)
    clean = F.when(F.size(to) == 0, F.col("text")).otherwise(F.concat(done["out"], F.substr(F.col("text"), done["end"] + 1, F.length("text"))))
    return found.withColumn("text", clean).drop(to)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = find(docs, fit(docs)).withColumn("b", F.filter("spans", lambda s: s["base"]))
    return out.select("doc_id", *[_count(F.col("b"), kind) for kind in KINDS], F.sha2(_written(F.col("b")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
