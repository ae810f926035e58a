"""The encoder of the scheme that coding.py decodes, and of compressed point chunks, whose layered formats it writes
stream by stream. Files that Spark writes and reads back need it, and tests of the decoder."""

from __future__ import annotations

import struct

import numpy as np

from .chunk import SPREAD_10, spread
from .coding import BIT_SHIFT, LEAST_RANGE, SYMBOL_SHIFT, BitModel, IntegerDecoder, RunningMedian, SymbolModel
from .records import POINT, FormatError


class Encoder:
    def __init__(self) -> None:
        self.out, self.low, self.range, self.used = bytearray(), 0, 0xFFFFFFFF, False

    def narrow(self, low: int, size: int) -> None:
        self.used = True
        self.low += low
        if self.low >> 32:  # carry into what is out already
            self.low &= 0xFFFFFFFF
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        self.range = size
        while self.range < LEAST_RANGE:
            self.out.append(self.low >> 24)
            self.low, self.range = (self.low << 8) & 0xFFFFFFFF, self.range << 8

    def bit(self, m: BitModel, b: int) -> None:
        x = m.prob * (self.range >> BIT_SHIFT)
        self.narrow(x if b else 0, self.range - x if b else x)
        m.seen(b)

    def symbol(self, m: SymbolModel, s: int) -> None:
        unit = self.range >> SYMBOL_SHIFT
        low = m.below[s] * unit
        self.narrow(low, (m.below[s + 1] * unit if s + 1 < len(m.below) else self.range) - low)
        m.seen(s)

    def raw(self, n: int, v: int) -> None:
        if n > 19:
            self.raw(16, v & 0xFFFF)
            return self.raw(n - 16, v >> 16)
        unit = self.range >> n
        self.narrow(v * unit, unit)

    def integer(self, m: IntegerDecoder, prediction: int, v: int, context: int = 0) -> None:
        """m: an IntegerDecoder whose models are used."""
        c = v - prediction
        half = 1 << (m.bits - 1)
        c = (c + half - 1) % (2 * half) - half + 1 if m.bits < 32 else (c + half) % (2 * half) - half
        if c == -half and m.bits == 32:
            m.k = 32
            return self.symbol(m.bucket[context], 32)
        m.k = k = (abs(c) if c <= 0 else c - 1).bit_length()
        self.symbol(m.bucket[context], k)
        if k == 0:
            return self.bit(m.zero, c)
        u = c - 1 if c > 0 else c + (1 << k) - 1
        if k <= m.HIGH:
            return self.symbol(m.within[k - 1], u)
        self.symbol(m.within[k - 1], u >> (k - m.HIGH))
        self.raw(k - m.HIGH, u & ((1 << (k - m.HIGH)) - 1))

    def done(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(4, "big")


def _weights(groups: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For symbols of n, each coded by the model of its group: where it begins in its model's range at that time, and its width there, 0 for the last symbol.

    A model stays the same from one refresh to the next, and its symbols are known: all between two refreshes are looked up at once.
    """
    low, size = np.zeros(len(symbols), dtype=np.int64), np.zeros(len(symbols), dtype=np.int64)
    if not len(symbols):
        return low, size
    order = np.argsort(groups, kind="stable")
    sorted_groups, sorted_symbols = groups[order], symbols[order]
    edges = [0, *(np.flatnonzero(sorted_groups[1:] != sorted_groups[:-1]) + 1).tolist(), len(order)]
    got_low, got_size = np.empty_like(low), np.empty_like(size)
    for start, end in zip(edges, edges[1:]):
        m = _Frequencies(n)
        while start < end:
            stop = min(end, start + m.left)
            some = sorted_symbols[start:stop]
            got_low[start:stop], got_size[start:stop] = m.below[some], m.width[some]
            if stop < end:
                m.refresh(some)
            start = stop
    low[order], size[order] = got_low, got_size
    return low, size


class _Frequencies:
    """A SymbolModel that is shown all symbols of a cycle at once."""

    def __init__(self, n: int):
        self.n, self.counts, self.total, self.cycle, self.longest = n, np.ones(n, dtype=np.int64), 0, n, (n + 6) << 3
        self._divide()
        self.cycle = self.left = (n + 6) >> 1

    def _divide(self) -> None:
        self.total += self.cycle
        if self.total > 1 << SYMBOL_SHIFT:
            self.counts = (self.counts + 1) >> 1
            self.total = int(self.counts.sum())
        self.below = ((1 << 31) // self.total * (self.counts.cumsum() - self.counts)) >> (31 - SYMBOL_SHIFT)
        self.width = np.zeros(self.n, dtype=np.int64)
        self.width[:-1] = self.below[1:] - self.below[:-1]
        self.cycle = self.left = min(self.longest, (5 * self.cycle) >> 2)

    def refresh(self, symbols: np.ndarray) -> None:
        self.counts = self.counts + np.bincount(symbols, minlength=self.n)
        self._divide()


def _zeros(groups: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For bits, each coded by the model of its group: the probability of a zero at that time."""
    models: dict[int, BitModel] = {}
    out = []
    for g, b in zip(groups.tolist(), bits.tolist()):
        m = models.get(g) or models.setdefault(g, BitModel())
        out.append(m.prob)
        m.seen(b)
    return np.array(out, dtype=np.int64)


class _Stream:
    """What one stream codes: a row for each point, with places for all that may be coded of it, in coding order."""

    def __init__(self, rows: int, places: int):
        self.shift, self.low, self.size = np.zeros((rows, places), dtype=np.uint8), np.zeros((rows, places), dtype=np.int32), np.zeros((rows, places), dtype=np.int32)

    def _put(self, rows: np.ndarray, place: int, shift: int | np.ndarray, low: np.ndarray, size: np.ndarray | int) -> None:
        self.shift[rows, place], self.low[rows, place], self.size[rows, place] = shift, low, size

    def symbols(self, place: int, rows: np.ndarray, groups: np.ndarray, symbols: np.ndarray, n: int) -> None:
        self._put(rows, place, SYMBOL_SHIFT, *_weights(groups, symbols, n))

    def raw(self, place: int, rows: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """Two places: n bits, the low 16 first if there are more than 19."""
        two = n > 19
        self._put(rows, place, np.where(two, 16, n), np.where(two, v & 0xFFFF, v), 1)
        self._put(rows[two], place + 1, n[two] - 16, v[two] >> 16, 1)

    def integers(self, place: int, rows: np.ndarray, channels: np.ndarray, contexts: np.ndarray, corrections: np.ndarray, bits: int) -> np.ndarray:
        """Four places: values less their predictions, as an IntegerDecoder of each channel reads them. Gives the buckets."""
        half, high = 1 << (bits - 1), IntegerDecoder.HIGH
        c = (corrections + half - 1) % (2 * half) - half + 1 if bits < 32 else (corrections + half) % (2 * half) - half
        k = np.frexp(np.where(c <= 0, -c, c - 1).astype(np.float64))[1].astype(np.int64)
        k[(c == -half) & (bits == 32)] = 32
        self.symbols(place, rows, channels * 64 + contexts, k, bits + 1)
        at = np.flatnonzero(k == 0)
        prob, one = _zeros(channels[at], c[at]), c[at] == 1
        self._put(rows[at], place + 1, BIT_SHIFT, np.where(one, prob, 0), np.where(one, 0, prob))
        u = np.where(c > 0, c - 1, c + (1 << np.minimum(k, 62)) - 1)
        for n in np.unique(k).tolist():
            if 0 < n < 32:
                at = np.flatnonzero(k == n)
                self.symbols(place + 1, rows[at], channels[at], u[at] >> max(0, n - high), 1 << min(n, high))
        at = np.flatnonzero((k > high) & (k < 32))
        self.raw(place + 2, rows[at], k[at] - high, u[at] & ((1 << (k[at] - high)) - 1))
        return k

    def done(self) -> bytes:
        """The coded bytes: a byte that is out already may be carried into, so carries are kept beside the bytes and added at the end."""
        coded = self.shift.ravel() > 0
        if not coded.any():
            return b""
        out, low, size = [], 0, 0xFFFFFFFF
        push = out.append
        for shift, a, w in zip(self.shift.ravel()[coded].tolist(), self.low.ravel()[coded].tolist(), self.size.ravel()[coded].tolist()):
            unit = size >> shift
            a *= unit
            low += a
            size = w * unit if w else size - a
            while size < LEAST_RANGE:
                push(low >> 24)
                low, size = (low & 0xFFFFFF) << 8, size << 8
        all_of = np.array(out, dtype=np.uint16)
        data = (all_of & 255).astype(np.uint8).tobytes() + (low & 0xFFFFFFFF).to_bytes(4, "big")
        carried = (all_of >> 8).astype(np.uint8)
        if not carried.any() and not low >> 32:
            return data
        carries = (int.from_bytes(carried.tobytes(), "big") << 8) + (low >> 32)
        return (int.from_bytes(data, "big") + (carries << 32)).to_bytes(len(data), "big")


def _kept(groups: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The last value before of the same group, or first."""
    order = np.argsort(groups, kind="stable")
    same = groups[order][1:] == groups[order][:-1]
    out = first.copy()
    out[order[1:][same]] = values[order[:-1][same]]
    return out


def _medians(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The running median of each value's group before it."""
    out = np.zeros(len(values), dtype=np.int64)
    for g in np.unique(groups).tolist():
        at = np.flatnonzero(groups == g)
        m, got = RunningMedian(), []
        for v in values[at].tolist():
            got.append(m.kept[2])
            m.add(v)
        out[at] = got
    return out


def _wrapped(v: np.ndarray) -> np.ndarray:
    return (v + (1 << 31)) % (1 << 32) - (1 << 31)


class _Sequences:
    """GPS times of a channel."""

    def __init__(self, t: int):
        self.times, self.steps, self.odd, self.at, self.newest = [t, 0, 0, 0], [0] * 4, [0] * 4, 0, 0

    def next(self, t: int) -> list[tuple[int, int, int]]:
        """A multiple of the sequence's step, another sequence, or written whole: (0 and 1: symbols, 2: correction, 3: bits; value; context)."""
        out, fits = [], lambda v: -(1 << 31) <= v < 1 << 31
        times, steps = self.times, self.steps
        while True:
            at = self.at
            diff, step = t - times[at], steps[at]
            if fits(diff):
                times[at] = t
                if step == 0:
                    steps[at], self.odd[at] = diff, 0
                    return [*out, (0, 0, 0), (2, diff, 0)]
                n = round(diff / step)
                n = 500 if n >= 500 else -10 if n <= -10 else n
                context = 7 if n == 0 else 1 if n == 1 else 4 if n == 500 else 6 if n == -10 else 2 if 0 < n < 10 else 3 if n > 0 else 5
                if n == 1:
                    self.odd[at] = 0
                elif n in (0, 500, -10):
                    self.odd[at] += 1
                    if self.odd[at] > 3:
                        steps[at], self.odd[at] = diff, 0
                return [*out, (1, n if n >= 0 else 500 - n, 0), (2, diff - (((n * step + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)), context)]
            model, base = (0, 1) if step == 0 else (1, 511)
            other = next((k for k in (1, 2, 3) if fits(t - times[(at + k) & 3])), 0)
            out.append((model, base + other, 0))
            if other:
                self.at = (at + other) & 3
                continue
            self.newest = self.at = (self.newest + 1) & 3
            out += [(2, (t >> 32) - (times[at] >> 32), 8), (3, t & 0xFFFFFFFF, 0)]
            times[self.at], steps[self.at], self.odd[self.at] = t, 0, 0
            return out


def _time_stream(channels: list[int], times: list[int], opened: dict[int, int]) -> bytes:
    """GPS times that have changed; opened: the time that each channel starts with."""
    open_ = {c: _Sequences(t) for c, t in opened.items()}
    steps = [(c, *one) for c, t in zip(channels, times) for one in open_[c].next(t)]
    channel, kind, value, context = (np.array(v, dtype=np.int64) for v in (zip(*steps) if steps else [()] * 4))
    e = _Stream(len(steps), 4)
    for k, n in ((0, 5), (1, 515)):
        at = np.flatnonzero(kind == k)
        e.symbols(0, at, channel[at], value[at], n)
    at = np.flatnonzero(kind == 2)
    e.integers(0, at, channel[at], context[at], value[at], 32)
    at = np.flatnonzero(kind == 3)
    e.raw(0, at, np.full(len(at), 32), value[at])
    return e.done()


def _bytes_changed(old: np.ndarray, new: np.ndarray) -> list[np.ndarray]:
    return [(old ^ new) >> shift & 255 != 0 for shift in (0, 8)]


def _rgb_stream(channel: np.ndarray, old: list[np.ndarray], new: list[np.ndarray]) -> bytes:
    e, every = _Stream(len(channel), 7), np.arange(len(channel))
    colour = (new[0] != new[1]) | (new[0] != new[2])
    changed = [c & (colour | (k == 0)) for k in range(3) for c in _bytes_changed(old[k], new[k])]
    e.symbols(0, every, channel, sum(c.astype(np.int64) << bit for bit, c in enumerate(changed)) + 64 * colour, 128)
    for h in (0, 1):
        (r0, g0, b0), (r, g, b) = ([v >> 8 * h & 255 for v in q] for q in (old, new))
        lead = r - r0 + g - g0
        half = np.abs(lead) // 2 * np.sign(lead)  # towards zero
        # red's two bytes, then green and blue of the low and of the high ones
        for bit, place, d in ((h, 1 + h, r - r0), (2 + h, 3 + 2 * h, g - np.clip(g0 + r - r0, 0, 255)), (4 + h, 4 + 2 * h, b - np.clip(b0 + half, 0, 255))):
            at = np.flatnonzero(changed[bit])
            e.symbols(place, at, channel[at], d[at] & 255, 256)
    return e.done()


def _nir_stream(channel: np.ndarray, old: np.ndarray, new: np.ndarray) -> bytes:
    e, every = _Stream(len(channel), 3), np.arange(len(channel))
    changed = _bytes_changed(old, new)
    e.symbols(0, every, channel, changed[0] + 2 * changed[1], 4)
    for half in (0, 1):
        at = np.flatnonzero(changed[half])
        e.symbols(1 + half, at, channel[at], ((new[at] >> 8 * half) - (old[at] >> 8 * half)) & 255, 256)
    return e.done()


def layered_chunk(points: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """A chunk of format 6, 7 or 8 from a structured array and its extra bytes (n, k).

    Each stream is coded by itself: contexts and models' frequencies as columns, so that only the coder's own state goes
    from symbol to symbol.
    """
    n = len(points)
    extra = np.zeros((n, 0), dtype=np.uint8) if extra is None else extra
    names = points.dtype.names
    col = {k: points[k].view("<i8") if k == "GpsTime" else points[k].astype(np.int64) for k in names} if n else {}
    channels = col["flags"] >> 4 & 3
    # the point before in the same channel; a channel that is new takes on the last values of the point before
    before = _kept(channels, np.arange(n), np.maximum(np.arange(n) - 1, 0))[1:]
    opened = {c: max(int(np.argmax(channels == c)) - 1, 0) for c in np.unique(channels).tolist()}
    opener = np.array([opened.get(c, 0) for c in range(4)])
    new = {k: v[1:] for k, v in col.items()}
    old = {k: v[before] for k, v in col.items()}
    sc, sc0, every = channels[1:], channels[:-1], np.arange(n - 1)
    start = opener[sc]
    n0, r0, n1, r1 = old["returns"] >> 4, old["returns"] & 15, new["returns"] >> 4, new["returns"] & 15
    timed, sourced, angled = (new[k] != old[k] for k in ("GpsTime", "PointSourceId", "ScanAngle"))
    single, last = (n1 == 1).astype(np.int64), r1 >= n1

    place = _Stream(n - 1, 12)
    how = np.select([r1 == r0, r1 == (r0 + 1) % 16, r1 == (r0 + 15) % 16], [0, 1, 2], 3)
    a, b, timed0 = col["returns"][:-1] >> 4, col["returns"][:-1] & 15, np.concatenate((np.zeros(min(1, n - 1), dtype=bool), timed[:-1]))
    moved = sc != sc0
    place.symbols(0, every, sc0 * 8 + (b == 1) + 2 * (b >= a) + 4 * timed0, 64 * moved + 32 * sourced + 16 * timed + 8 * angled + 4 * (n1 != n0) + how, 128)
    for at, slot, group, symbol, of in (
        (moved, 1, sc0, (sc - sc0 - 1) & 3, 3), (n1 != n0, 2, sc * 16 + n0, n1, 16), ((how == 3) & timed, 3, sc * 16 + r0, r1, 16), ((how == 3) & ~timed, 3, sc, (r1 - r0 - 2) & 15, 13),
    ):
        at = np.flatnonzero(at)
        place.symbols(slot, at, group[at], symbol[at], of)
    at = np.array([[spread(i, j) for j in range(16)] for i in range(16)])[n1, r1] * 2 + timed
    buckets = []
    for axis, slot in (("X", 4), ("Y", 8)):
        diff = _wrapped(new[axis] - old[axis])
        context = single + (np.minimum(buckets[0], 20) // 2 * 2 if buckets else 0)
        buckets.append(place.integers(slot, every, sc, context, diff - _medians(sc * 16 + at, diff), 32))

    z = _Stream(n - 1, 4)
    height = _kept(sc * 8 + np.minimum(np.abs(n1 - r1), 7), new["Z"], col["Z"][start])
    z.integers(0, every, sc, single + np.minimum(sum(buckets) // 2, 18) // 2 * 2, new["Z"] - height, 32)
    six = lambda f: f & 15 | (f & 192) >> 2
    cls, flags, user = (_Stream(n - 1, 1) for _ in range(3))
    cls.symbols(0, every, sc * 64 + (old["Classification"] & 31) * 2 + ((r1 == 1) & last), new["Classification"], 256)
    flags.symbols(0, every, sc * 64 + six(old["flags"]), six(new["flags"]), 64)
    user.symbols(0, every, sc * 64 + old["UserData"] // 4, new["UserData"], 256)
    intensity, angle, source = (_Stream(n - 1, 4) for _ in range(3))
    k = timed + 2 * last + 4 * (r1 == 1)
    intensity.integers(0, every, sc, k // 2, new["Intensity"] - _kept(sc * 8 + k, new["Intensity"], col["Intensity"][start]), 16)
    for e, name, changed, context in ((angle, "ScanAngle", angled, timed), (source, "PointSourceId", sourced, np.zeros_like(timed))):
        at = np.flatnonzero(changed)
        e.integers(0, at, sc[at], context[at].astype(np.int64), new[name][at] - old[name][at], 16)
    at = np.flatnonzero(timed)
    data = [e.done() for e in (place, z, cls, flags, intensity, angle, user, source)]
    data.append(_time_stream(sc[at].tolist(), new["GpsTime"][at].tolist(), {c: int(col["GpsTime"][i]) for c, i in opened.items()}))
    if "Red" in names:
        data.append(_rgb_stream(sc, *([q[c] for c in ("Red", "Green", "Blue")] for q in (old, new))))
    if "Nir" in names:
        data.append(_nir_stream(sc, old["Nir"], new["Nir"]))
    for j in range(extra.shape[1]):
        one, byte = _Stream(n - 1, 1), extra[:, j].astype(np.int64)
        one.symbols(0, every, sc, (byte[1:] - byte[before]) & 255, 256)
        data.append(one.done())
    return points[:1].tobytes() + extra[0].tobytes() + struct.pack("<I", n) + b"".join(struct.pack("<I", len(d)) for d in data) + b"".join(data)


def single_chunk(points: np.ndarray) -> bytes:
    """A chunk of format 0."""
    e, models = Encoder(), {}
    model = lambda *k: models.setdefault(k, SymbolModel(256))
    changed, dx, dy, z = SymbolModel(64), IntegerDecoder(None, 32, 2), IntegerDecoder(None, 32, 22), IntegerDecoder(None, 32, 20)
    light, origin = IntegerDecoder(None, 16, 4), IntegerDecoder(None, 16, 1)
    mx, my, heights, lights = [RunningMedian() for _ in range(16)], [RunningMedian() for _ in range(16)], [0] * 8, [0] * 16
    last = {k: int(points[0][k]) for k in points.dtype.names}
    for p in points[1:]:
        p = {k: int(p[k]) for k in points.dtype.names}
        r, n = p["bits"] & 7, p["bits"] >> 3 & 7
        m = SPREAD_10[n][r]
        s = 32 * (p["bits"] != last["bits"]) + 16 * (p["Intensity"] != lights[m]) + 8 * (p["Classification"] != last["Classification"]) + 4 * (p["ScanAngle"] != last["ScanAngle"])
        s += 2 * (p["UserData"] != last["UserData"]) + (p["PointSourceId"] != last["PointSourceId"])
        e.symbol(changed, s)
        if s & 32:
            e.symbol(model("bits", last["bits"]), p["bits"])
        if s & 16:
            e.integer(light, lights[m], p["Intensity"], min(m, 3))
            lights[m] = p["Intensity"]
        if s & 8:
            e.symbol(model("cls", last["Classification"]), p["Classification"])
        if s & 4:
            e.symbol(model("angle", p["bits"] >> 6 & 1), (p["ScanAngle"] - last["ScanAngle"]) & 255)
        if s & 2:
            e.symbol(model("user", last["UserData"]), p["UserData"])
        if s & 1:
            e.integer(origin, last["PointSourceId"], p["PointSourceId"])
        single = int(n == 1)
        for axis, ints, medians in (("X", dx, mx), ("Y", dy, my)):
            diff = p[axis] - last[axis]
            e.integer(ints, medians[m].value, diff, single + (0 if axis == "X" else min(dx.k, 20) // 2 * 2))
            medians[m].add(diff)
        e.integer(z, heights[abs(n - r)], p["Z"], single + min((dx.k + dy.k) // 2, 18) // 2 * 2)
        heights[abs(n - r)] = p["Z"]
        last = p
    return points[:1].tobytes() + (e.done() if len(points) > 1 else b"")


def encode_chunk(points: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """A compressed chunk of a structured array of format 0, 6, 7 or 8, and of its extra bytes (n, k)."""
    fmt = next((f for f in (0, 6, 7, 8) if POINT[f] == points.dtype), None)
    if fmt is None or (fmt == 0 and extra is not None and extra.shape[1]):
        raise FormatError("only points of formats 0 (without extra bytes), 6, 7 and 8 are compressed")
    return single_chunk(points) if fmt == 0 else layered_chunk(points, extra)
