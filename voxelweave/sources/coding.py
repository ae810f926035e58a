"""Adaptive range coding as compressed point chunks use it: the published scheme of 32-bit range coders with periodically
rescaled frequency models, integers as prediction plus bucketed correction, and a running median of five.

Sequential by nature: a chunk is decoded by one task, and tasks decode chunks side by side.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from itertools import accumulate

#: Fixed values of the scheme: least range, and bits of a model's probabilities (bit models, symbol models).
LEAST_RANGE = 1 << 24
BIT_SHIFT, SYMBOL_SHIFT = 13, 15


class BitModel:
    """Probability of a zero, from counts that halve when they grow past 2**BIT_SHIFT."""

    def __init__(self) -> None:
        self.zeros, self.total, self.cycle, self.left, self.prob = 1, 2, 4, 4, 1 << (BIT_SHIFT - 1)

    def seen(self, bit: int) -> None:
        self.zeros += 1 - bit
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << BIT_SHIFT:
            self.total, self.zeros = (self.total + 1) >> 1, (self.zeros + 1) >> 1
            self.total += self.zeros == self.total
        self.prob = (self.zeros * ((1 << 31) // self.total)) >> (31 - BIT_SHIFT)
        self.cycle = self.left = min(64, (5 * self.cycle) >> 2)


@cache
def _evenly(n: int) -> list[int]:
    """Where each of n symbols begins while all are as frequent; never changed."""
    return [(1 << 31) // n * at >> (31 - SYMBOL_SHIFT) for at in range(n)]


class Models(dict):
    """Models by context, made when they are first asked for."""

    def __init__(self, symbols: int | Callable[[int], int]):
        self.symbols = symbols

    def __missing__(self, key: object) -> SymbolModel:
        self[key] = model = SymbolModel(self.symbols(key) if callable(self.symbols) else self.symbols)
        return model


class SymbolModel:
    """Cumulative frequencies of n symbols, brought up to date in ever longer cycles."""

    def __init__(self, n: int):
        self.counts, self.total, self.longest, self.last, self.below = [1] * n, n, (n + 6) << 3, n - 1, _evenly(n)
        self.cycle = self.left = (n + 6) >> 1

    def _refresh(self) -> None:
        self.total += self.cycle
        if self.total > 1 << SYMBOL_SHIFT:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)
        scale, shift = (1 << 31) // self.total, 31 - SYMBOL_SHIFT
        self.below = [scale * at >> shift for at in accumulate(self.counts[:-1], initial=0)]
        self.cycle = self.left = min(self.longest, (5 * self.cycle) >> 2)

    def seen(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._refresh()


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 4, len(data)
        self.value, self.range = int.from_bytes(data[:4].ljust(4, b"\0"), "big"), 0xFFFFFFFF

    def _narrow(self, low: int, size: int) -> None:
        """Goes on in [low, low + size) of the range; bytes past the end count as zeros."""
        self.value -= low
        self.range = size
        while self.range < LEAST_RANGE:
            self.value = (self.value << 8) | (self.data[self.at] if self.at < self.end else 0)
            self.at += 1
            self.range <<= 8

    def bit(self, model: BitModel) -> int:
        split = model.prob * (self.range >> BIT_SHIFT)
        out = int(self.value >= split)
        self._narrow(split if out else 0, self.range - split if out else split)
        model.seen(out)
        return out

    def symbol(self, model: SymbolModel) -> int:
        """The innermost loop of decoding, hence written out instead of calling _narrow() and seen()."""
        below, unit = model.below, self.range >> SYMBOL_SHIFT
        s = bisect_right(below, self.value // unit) - 1
        low = below[s] * unit
        value = self.value - low
        size = (below[s + 1] * unit if s < model.last else self.range) - low
        while size < LEAST_RANGE:
            value = value << 8 | (self.data[self.at] if self.at < self.end else 0)
            self.at += 1
            size <<= 8
        self.value, self.range = value, size
        model.counts[s] += 1
        model.left -= 1
        if not model.left:
            model._refresh()
        return s

    def symbols(self, model: SymbolModel, n: int) -> list[int]:
        """n symbols of one model, which stays the same between two refreshes."""
        out, data, at, end, value, size, last, counts = [], self.data, self.at, self.end, self.value, self.range, model.last, model.counts
        push = out.append
        while n:
            some = min(n, model.left)
            below = model.below
            for _ in range(some):
                unit = size >> SYMBOL_SHIFT
                s = bisect_right(below, value // unit) - 1
                low = below[s] * unit
                value -= low
                size = (below[s + 1] * unit if s < last else size) - low
                while size < LEAST_RANGE:
                    value = value << 8 | (data[at] if at < end else 0)
                    at += 1
                    size <<= 8
                counts[s] += 1
                push(s)
            n -= some
            model.left -= some
            if not model.left:
                model._refresh()
                counts = model.counts
        self.at, self.value, self.range = at, value, size
        return out

    def chain(self, models: Mapping[int, SymbolModel], of: Sequence[int], also: list[int], last: int, out: list[int]) -> int:
        """A symbol for each of also, by the model of its context: what `of` says of the last symbol, and the one of also. Gives the last."""
        data, at, end, value, size, push = self.data, self.at, self.end, self.value, self.range, out.append
        for more in also:
            model = models[of[last] | more]
            below, unit = model.below, size >> SYMBOL_SHIFT
            last = bisect_right(below, value // unit) - 1
            low = below[last] * unit
            value -= low
            size = (below[last + 1] * unit if last < model.last else size) - low
            while size < LEAST_RANGE:
                value = value << 8 | (data[at] if at < end else 0)
                at += 1
                size <<= 8
            model.counts[last] += 1
            model.left -= 1
            if not model.left:
                model._refresh()
            push(last)
        self.at, self.value, self.range = at, value, size
        return last

    def raw(self, n: int) -> int:
        """n bits without a model, the low 16 first if there are more than 19."""
        if n > 19:
            low = self.raw(16)
            return low | self.raw(n - 16) << 16
        unit = self.range >> n
        out = self.value // unit
        self._narrow(out * unit, unit)
        return out


class IntegerDecoder:
    """Values near a prediction: the bucket of the correction by context, then the correction within its bucket.

    Bucket 0 holds 0 and 1; bucket k the values from -(2**k - 1) to -2**(k-1) and from 2**(k-1) + 1 to 2**k. Only the
    HIGH leading bits of a correction are modelled. Results wrap around in `bits` bits.
    """

    HIGH = 8

    def __init__(self, decoder: RangeDecoder, bits: int = 16, contexts: int = 1):
        self.decoder, self.bits = decoder, bits
        self.bucket = [SymbolModel(bits + 1) for _ in range(contexts)]
        self.zero = BitModel()
        self.within = Models(lambda at: 1 << min(at + 1, self.HIGH))
        self.k = 0  # the last bucket, which other fields take as a context

    def correction(self, context: int) -> int:
        """Most of what is decoded, hence symbols and bits are written out, as in RangeDecoder.symbol()."""
        d, model = self.decoder, self.bucket[context]
        data, at, end, value, size = d.data, d.at, d.end, d.value, d.range
        below, unit = model.below, size >> SYMBOL_SHIFT
        k = bisect_right(below, value // unit) - 1
        low = below[k] * unit
        value -= low
        size = (below[k + 1] * unit if k < model.last else size) - low
        while size < LEAST_RANGE:
            value = value << 8 | (data[at] if at < end else 0)
            at += 1
            size <<= 8
        model.counts[k] += 1
        model.left -= 1
        if not model.left:
            model._refresh()
        self.k = k
        if not 0 < k < 32:
            d.at, d.value, d.range = at, value, size
            return -(1 << 31) if k else d.bit(self.zero)
        model = self.within[k - 1]
        below, unit = model.below, size >> SYMBOL_SHIFT
        c = bisect_right(below, value // unit) - 1
        low = below[c] * unit
        value -= low
        size = (below[c + 1] * unit if c < model.last else size) - low
        while size < LEAST_RANGE:
            value = value << 8 | (data[at] if at < end else 0)
            at += 1
            size <<= 8
        model.counts[c] += 1
        model.left -= 1
        if not model.left:
            model._refresh()
        n = k - self.HIGH
        if 0 < n < 20:
            size >>= n
            low = value // size
            value -= low * size
            while size < LEAST_RANGE:
                value = value << 8 | (data[at] if at < end else 0)
                at += 1
                size <<= 8
            c = c << n | low
        d.at, d.value, d.range = at, value, size
        if n > 19:
            c = c << n | d.raw(n)
        return c + 1 if c >> (k - 1) else c - ((1 << k) - 1)

    def decode(self, prediction: int, context: int = 0) -> int:
        v = prediction + self.correction(context)
        if self.bits == 32:
            return ((v + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
        return v & ((1 << self.bits) - 1)


class RunningMedian:
    """Median of five kept values. A new value takes the place of the greatest or of the least kept one by turns; the turn
    passes on when the value falls on the side of the one it replaced (or on the median)."""

    def __init__(self) -> None:
        self.kept, self.high = [0] * 5, True

    def add(self, v: int) -> None:
        middle = self.kept[2]
        self.kept.pop(4 if self.high else 0)
        insort(self.kept, v)
        if (v >= middle) if self.high else (v <= middle):
            self.high = not self.high

    @property
    def value(self) -> int:
        return self.kept[2]
