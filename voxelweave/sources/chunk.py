"""Decoder of compressed point chunks: formats 6, 7 and 8 (a stream for each field) and 0 (one stream for all).

A chunk of the layered formats is its first point as it is, the number of points, the size of every stream, and the
streams. The stream of places says for each point which scanner channel it belongs to, its return, what else changes,
and x and y; every other field hangs on that, but not on one another. So fields are decoded one after the other, each
as a column over all points, and a field that nobody asks for costs nothing (`streams`).

Each scanner channel has models and last values of its own; a channel that is met for the first time takes on the last
values of the point before. A field without a stream keeps its last value.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from itertools import accumulate

import numpy as np

from .coding import IntegerDecoder, Models, RangeDecoder, RunningMedian, SymbolModel
from .records import POINT, FormatError

#: Streams of the layered formats in file order. CORE is what a reader of places and colours needs.
LAYERS = ("place", "Z", "Classification", "flags", "Intensity", "ScanAngle", "UserData", "PointSourceId", "GpsTime")
CORE = frozenset({"place", "Z", "rgb", "extra"})
ALL = CORE | set(LAYERS) | {"nir"}


def level(n: int, r: int, most: int = 7) -> int:
    """How far a return is from the last, as a context of heights."""
    return min(abs(n - r), most)


#: Fixed values of the format: contexts of places by number of returns and return number, where one of them is 0.
_NO_RETURN = (0, 1, 2, 3, 4, 5, 3, 4, 4, 5, 5, 5, 5, 5, 5, 5)


def spread(n: int, r: int) -> int:
    """Context of x and y in the layered formats, 0 to 5: single and first of few returns apart, far ones together."""
    low, high = min(n, r), max(n, r)
    if low == 0:
        return _NO_RETURN[high]
    if low == 1:
        return (0, 1, 3)[min(high, 3) - 1]
    if low == 2:
        return 2 if high == 2 else 4 if high < 11 else 3
    return 5 if low == high or (low >= 11 and high - low == 1) else 4


#: Fixed values of format 0: the same, 0 to 15, by number of returns (rows) and return number.
SPREAD_10 = (
    (15, 14, 13, 12, 11, 10, 9, 8),
    (14, 0, 1, 3, 6, 10, 10, 9),
    (13, 1, 2, 4, 7, 11, 11, 10),
    (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12),
    (10, 10, 11, 12, 13, 14, 14, 13),
    (9, 10, 11, 12, 13, 14, 15, 14),
    (8, 9, 10, 11, 12, 13, 14, 15),
)
_SPREAD = [[spread(n, r) for r in range(16)] for n in range(16)]


class Medians(dict):
    """Running medians by context."""

    def __missing__(self, key: object) -> RunningMedian:
        self[key] = median = RunningMedian()
        return median


def even(k: int, most: int) -> int:
    return min(k, most) & ~1


class Places:
    """x, y and a place's contexts of one channel or file."""

    def __init__(self, decoder: RangeDecoder | None):
        self.dx, self.dy = IntegerDecoder(decoder, 32, 2), IntegerDecoder(decoder, 32, 22)
        self.mx, self.my = Medians(), Medians()

    def step(self, n: int, context: int) -> tuple[int, int]:
        single = int(n == 1)
        median = self.mx[context]
        x = self.dx.decode(median.kept[2], single)
        median.add(x)
        median = self.my[context]
        y = self.dy.decode(median.kept[2], single + even(self.dx.k, 20))
        median.add(y)
        return x, y

    def height_context(self, n: int) -> int:
        return int(n == 1) + even((self.dx.k + self.dy.k) // 2, 18)


def wrap(v: int) -> int:
    return ((v + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


class _Channel:
    def __init__(self, decoder: RangeDecoder):
        self.changed, self.to, self.returns, self.number, self.number_same = Models(128), SymbolModel(3), Models(16), Models(16), SymbolModel(13)
        self.places = Places(decoder)
        self.x = self.y = self.n = self.r = self.timed = 0


class Walk:
    """What the stream of places says, as lists over the points."""

    def __init__(self, decoder: RangeDecoder | None, first: np.void, points: int):
        returns, flags = int(first["returns"]), int(first["flags"])
        sc = (flags >> 4) & 3
        self.channel, self.n, self.r = [sc], [returns >> 4], [returns & 15]
        self.timed, self.sourced, self.angled, self.z_context = [0], [0], [0], [0]
        self.x, self.y = [int(first["X"])], [int(first["Y"])]
        if decoder is None:
            for one in (self.channel, self.n, self.r, self.timed, self.sourced, self.angled, self.z_context, self.x, self.y):
                one *= points
            return
        channels: dict[int, _Channel] = {}
        here = self._enter(channels, decoder, sc)
        for _ in range(points - 1):
            n, r = here.n, here.r
            change = decoder.symbol(here.changed[(r == 1) | (r >= n) << 1 | here.timed << 2])
            if change & 64:
                sc = (sc + decoder.symbol(here.to) + 1) & 3
                here = channels.get(sc) or self._enter(channels, decoder, sc)
                n, r = here.n, here.r
            timed = change >> 4 & 1
            if change & 4:
                n = decoder.symbol(here.returns[n])
            how = change & 3
            if how == 3:
                r = decoder.symbol(here.number[r]) if timed else (r + decoder.symbol(here.number_same) + 2) & 15
            elif how:
                r = (r + (1 if how == 1 else 15)) & 15
            dx, dy = here.places.step(n, _SPREAD[n][r] << 1 | timed)
            here.x, here.y, here.n, here.r, here.timed = wrap(here.x + dx), wrap(here.y + dy), n, r, timed
            self.channel.append(sc)
            self.n.append(n)
            self.r.append(r)
            self.timed.append(timed)
            self.sourced.append(change >> 5 & 1)
            self.angled.append(change >> 3 & 1)
            self.z_context.append(here.places.height_context(n))
            self.x.append(here.x)
            self.y.append(here.y)

    def _enter(self, channels: dict[int, _Channel], decoder: RangeDecoder, sc: int) -> _Channel:
        channels[sc] = new = _Channel(decoder)
        new.x, new.y, new.n, new.r = self.x[-1], self.y[-1], self.n[-1], self.r[-1]
        return new

    def runs(self) -> list[tuple[int, int, int]]:
        """Points of one channel that follow one another, from the second point on: channel, first, end."""
        sc = np.array(self.channel[1:])
        edges = [0, *(np.flatnonzero(sc[1:] != sc[:-1]) + 1).tolist(), len(sc)] if len(sc) else [0]
        return [(int(sc[a]), a + 1, b + 1) for a, b in zip(edges, edges[1:])]

    def column(self, first: int | tuple, make: Callable[[object], Callable]) -> list:
        """A field of all points. make(last value of the point before) opens a channel: its function adds the values of the points start to stop to a list."""
        out, channels = [first], {self.channel[0]: make(first)}
        for sc, start, stop in self.runs():
            add = channels.get(sc)
            if add is None:
                add = channels[sc] = make(out[-1])
            add(start, stop, out)
        return out


def _each(step: Callable[[int], object]) -> Callable:
    def add(start: int, stop: int, out: list) -> None:
        out += map(step, range(start, stop))

    return add


def _kept(d: RangeDecoder, bits: int, models: int, of: list[int], contexts: list[int]) -> Callable:
    """Integers near the last one of their kind, of 8 kinds."""
    def make(last: int) -> Callable:
        ints, kept = IntegerDecoder(d, bits, models), [last] * 8

        def add(start: int, stop: int, out: list[int]) -> None:
            decode, push = ints.decode, out.append
            for at, context in zip(of[start:stop], contexts[start:stop]):
                kept[at] = v = decode(kept[at], context)
                push(v)

        return add

    return make


def _heights(w: Walk, d: RangeDecoder) -> Callable:
    return _kept(d, 32, 20, [level(n, r) for n, r in zip(w.n, w.r)], w.z_context)


def _symbols(d: RangeDecoder, symbols: int, of: list[int], also: list[int]) -> Callable:
    """A field whose next value is a symbol under a context of its last one and of the point."""
    def make(last: int) -> Callable:
        models = Models(symbols)

        def add(start: int, stop: int, out: list[int]) -> None:
            nonlocal last
            last = d.chain(models, of, also[start:stop], last, out)

        return add

    return make


def _intensities(w: Walk, d: RangeDecoder) -> Callable:
    kinds = [timed | (r >= n) << 1 | (r == 1) << 2 for timed, n, r in zip(w.timed, w.n, w.r)]
    return _kept(d, 16, 4, kinds, [k >> 1 for k in kinds])


def _when(flags: list[int], d: RangeDecoder, contexts: int, context: Callable[[int], int]) -> Callable:
    """A 16-bit field that changes where flags say so."""
    def make(last: int) -> Callable:
        ints = IntegerDecoder(d, 16, contexts)

        def step(i: int) -> int:
            nonlocal last
            if flags[i]:
                last = ints.decode(last, context(i))
            return last

        return _each(step)

    return make


class Times:
    """GPS times as 64-bit integers: up to four sequences with a last time and step each; a new time goes on by a multiple of the step."""

    #: Fixed values of the format: the greatest and least multiple, and the symbol of a time written whole.
    MOST, LEAST, WHOLE = 500, -10, 511

    def __init__(self, d: RangeDecoder, last: int):
        self.d, self.ints, self.zero, self.multi = d, IntegerDecoder(d, 32, 9), SymbolModel(5), SymbolModel(515)
        self.times, self.steps, self.odd, self.at, self.newest = [last, 0, 0, 0], [0] * 4, [0] * 4, 0, 0

    def next(self) -> int:
        while True:
            at, step = self.at, self.steps[self.at]
            if step == 0:
                s = self.d.symbol(self.zero)
                if s == 0:
                    self.steps[at] = self._add(self.ints.decode(0, 0))
                    self.odd[at] = 0
                    return self.times[at]
                jump, whole = s - 1, s == 1
            else:
                s = self.d.symbol(self.multi)
                if s < self.WHOLE:
                    return self._multiple(at, step, s)
                jump, whole = s - self.WHOLE, s == self.WHOLE
            if whole:
                return self._new(at)
            self.at = (at + jump) & 3

    def _add(self, diff: int) -> int:
        t = self.times[self.at] + diff
        self.times[self.at] = ((t + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)
        return diff

    def _new(self, at: int) -> int:
        self.newest = self.at = (self.newest + 1) & 3
        high = self.ints.decode(wrap(self.times[at] >> 32), 8)
        low = self.d.raw(32)
        self.times[self.at] = high << 32 | low
        self.steps[self.at] = self.odd[self.at] = 0
        return self.times[self.at]

    def _multiple(self, at: int, step: int, s: int) -> int:
        times = s if s <= self.MOST else max(self.MOST - s, self.LEAST)
        far = times in (0, self.MOST, self.LEAST)
        context = 7 if s == 0 else 1 if s == 1 else 2 if s < 10 else 3 if s < self.MOST else 4 if s == self.MOST else 6 if far else 5
        diff = self._add(self.ints.decode(wrap(times * step), context))
        if s == 1:
            self.odd[at] = 0
        elif far:
            self.odd[at] += 1
            if self.odd[at] > 3:  # the step has changed for good
                self.steps[at], self.odd[at] = diff, 0
        return self.times[at]


def _times(w: Walk, d: RangeDecoder) -> Callable:
    def make(last: int) -> Callable:
        times = Times(d, last)

        def step(i: int) -> int:
            nonlocal last
            if w.timed[i]:
                last = times.next()
            return last

        return _each(step)

    return make


def clamped(v: int) -> int:
    return max(0, min(255, v))


def _colours(d: RangeDecoder) -> Callable:
    """Red, green, blue: which bytes change, and by how much beyond what red's change leads one to expect of green and blue."""
    def make(last: tuple[int, int, int]) -> Callable:
        used, diff, symbol = SymbolModel(128), Models(256), d.symbol

        def step(_: int) -> tuple[int, int, int]:
            nonlocal last
            s = symbol(used)
            if not s:  # grey, and nothing changes
                last = (last[0],) * 3
                return last
            red, green, blue = last
            low = (symbol(diff[0]) + red) & 255 if s & 1 else red & 255
            high = (symbol(diff[1]) + (red >> 8)) & 255 if s & 2 else red >> 8
            if not s & 64:
                last = (low | high << 8,) * 3
                return last
            out_green = out_blue = 0
            for shift, new, both_changed in ((0, low, s >> 2), (8, high, s >> 3)):
                g0, b0, lead = green >> shift & 255, blue >> shift & 255, new - (red >> shift & 255)
                g = (symbol(diff[2 + (shift >> 3)]) + clamped(g0 + lead)) & 255 if both_changed & 1 else g0
                both = lead + g - g0
                b = (symbol(diff[4 + (shift >> 3)]) + clamped(b0 + int(both / 2))) & 255 if both_changed & 4 else b0  # towards zero
                out_green |= g << shift
                out_blue |= b << shift
            last = (low | high << 8, out_green, out_blue)
            return last

        return _each(step)

    return make


def _near_infrared(d: RangeDecoder) -> Callable:
    def make(last: int) -> Callable:
        used, diff = SymbolModel(4), Models(256)

        def step(_: int) -> int:
            nonlocal last
            s = d.symbol(used)
            for half in (0, 1):
                if s >> half & 1:
                    shift = 8 * half
                    byte = (d.symbol(diff[half]) + (last >> shift)) & 255
                    last = last & (0xFF00 >> shift) | byte << shift
            return last

        return _each(step)

    return make


def _bytes(d: RangeDecoder) -> Callable:
    def make(last: int) -> Callable:
        model = SymbolModel(256)

        def add(start: int, stop: int, out: list[int]) -> None:
            nonlocal last
            changes = d.symbols(model, stop - start)
            out += [v & 255 for v in accumulate(changes, initial=last)][1:]
            last = out[-1]

        return add

    return make


def _layered(chunk: bytes, n: int, fmt: int, length: int, streams: Iterable[str]) -> np.ndarray:
    base = POINT[fmt]
    extra = length - base.itemsize
    names = [*LAYERS, *(["rgb"] if fmt >= 7 else []), *(["nir"] if fmt == 8 else []), *[f"extra{i}" for i in range(extra)]]
    at = length + 4 + 4 * len(names)
    if len(chunk) < at:
        raise FormatError("a chunk is shorter than its sizes")
    sizes = struct.unpack_from(f"<{len(names)}I", chunk, length + 4)
    if at + sum(sizes) > len(chunk):
        raise FormatError("a chunk is shorter than its streams")
    decoders: dict[str, RangeDecoder | None] = {}
    for name, size in zip(names, sizes):
        wanted = size and name.rstrip("0123456789") in streams
        decoders[name] = RangeDecoder(chunk[at : at + size]) if wanted else None
        at += size
    first = np.frombuffer(chunk, dtype=base, count=1)[0]
    w = Walk(decoders["place"], first, n)
    raw = np.repeat(np.frombuffer(chunk, dtype=np.uint8, count=length)[None, :], n, axis=0)
    out = np.repeat(np.array([first]), n)
    out["X"], out["Y"] = w.x, w.y
    out["returns"] = np.array(w.n) << 4 | np.array(w.r)
    flags = int(first["flags"])
    steady = lambda name: int(first[name])
    column = {
        "Z": lambda d: w.column(steady("Z"), _heights(w, d)),
        "Classification": lambda d: w.column(steady("Classification"), _symbols(d, 256, [(last & 31) << 1 for last in range(256)], [int(r == 1 and r >= n) for n, r in zip(w.n, w.r)])),
        "flags": lambda d: w.column(flags & 15 | flags >> 2 & 48, _symbols(d, 64, range(64), [0] * n)),
        "Intensity": lambda d: w.column(steady("Intensity"), _intensities(w, d)),
        "ScanAngle": lambda d: w.column(steady("ScanAngle"), _when(w.angled, d, 2, lambda i: w.timed[i])),
        "UserData": lambda d: w.column(steady("UserData"), _symbols(d, 256, [last >> 2 for last in range(256)], [0] * n)),
        "PointSourceId": lambda d: w.column(steady("PointSourceId"), _when(w.sourced, d, 1, lambda i: 0)),
        "GpsTime": lambda d: w.column(int(first["GpsTime"].view("<i8")), _times(w, d)),
    }
    for name, make in column.items():
        if decoders[name] is not None:
            values = np.array(make(decoders[name]))
            if name == "GpsTime":
                out[name] = values.astype("<i8").view("<f8")
            elif name == "flags":
                out[name] = values & 15 | (values & 48) << 2
            else:
                out[name] = values.astype(out[name].dtype)  # wraps into signed fields
    out["flags"] = out["flags"] & 0xCF | np.array(w.channel) << 4
    if decoders.get("rgb"):
        rgb = np.array(w.column(tuple(steady(c) for c in ("Red", "Green", "Blue")), _colours(decoders["rgb"])))
        for k, c in enumerate(("Red", "Green", "Blue")):
            out[c] = rgb[:, k]
    if decoders.get("nir"):
        out["Nir"] = w.column(steady("Nir"), _near_infrared(decoders["nir"]))
    raw[:, : base.itemsize] = out.view(np.uint8).reshape(n, base.itemsize)
    for i in range(extra):
        if decoders[f"extra{i}"]:
            raw[:, base.itemsize + i] = w.column(int(chunk[base.itemsize + i]), _bytes(decoders[f"extra{i}"]))
    return raw


def _single(chunk: bytes, n: int, length: int) -> np.ndarray:
    """Format 0: one stream, point by point."""
    base = POINT[0]
    if length != base.itemsize:
        raise FormatError(f"format 0 has {base.itemsize} bytes a point, not {length}")
    out = np.repeat(np.frombuffer(chunk, dtype=base, count=1), n)
    first, d = out[0], RangeDecoder(chunk[length:])
    x, y, z, bits, cls, angle, user, source = (int(first[k]) for k in ("X", "Y", "Z", "bits", "Classification", "ScanAngle", "UserData", "PointSourceId"))
    changed, by_bits, by_class, by_user, by_direction = SymbolModel(64), Models(256), Models(256), Models(256), Models(256)
    places, height = Places(d), IntegerDecoder(d, 32, 20)
    light, origin = IntegerDecoder(d, 16, 4), IntegerDecoder(d, 16, 1)
    heights, lights, intensity = [0] * 8, [0] * 16, 0
    rows = []
    for _ in range(n - 1):
        change = d.symbol(changed)
        if change & 32:
            bits = d.symbol(by_bits[bits])
        r, number = bits & 7, bits >> 3 & 7
        m = SPREAD_10[number][r]
        if change:
            if change & 16:
                lights[m] = light.decode(lights[m], min(m, 3))
            intensity = lights[m]
        if change & 8:
            cls = d.symbol(by_class[cls])
        if change & 4:
            angle = (angle + d.symbol(by_direction[bits >> 6 & 1])) & 255
        if change & 2:
            user = d.symbol(by_user[user])
        if change & 1:
            source = origin.decode(source)
        dx, dy = places.step(number, m)
        x, y = wrap(x + dx), wrap(y + dy)
        at = level(number, r)
        z = heights[at] = height.decode(heights[at], places.height_context(number))
        rows.append((x, y, z, intensity, bits, cls, angle & 255, user, source))
    if rows:
        for name, values in zip(base.names, zip(*rows)):
            out[name][1:] = np.array(values).astype(base[name])
    return out.view(np.uint8).reshape(n, length)


def decode_chunk(chunk: bytes, n: int, fmt: int, length: int, streams: Iterable[str] = ALL) -> np.ndarray:
    """The n records of a compressed chunk as bytes (n, length)."""
    if fmt not in (0, 6, 7, 8):
        raise NotImplementedError(f"compressed points of format {fmt}")
    if length < POINT[fmt].itemsize:
        raise FormatError(f"format {fmt} has {POINT[fmt].itemsize} bytes a point at least, not {length}")
    if len(chunk) < length:
        raise FormatError("a chunk is shorter than a point")
    if n <= 0:
        return np.zeros((0, length), dtype=np.uint8)
    if fmt == 0:
        return _single(chunk, n, length)
    if n == 1:
        return np.frombuffer(chunk, dtype=np.uint8, count=length)[None, :].copy()
    return _layered(chunk, n, fmt, length, frozenset(streams))
