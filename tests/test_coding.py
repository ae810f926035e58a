"""The decoder against an encoder of the same scheme."""

import random

import pytest

from voxelweave.sources.coding import BitModel, IntegerDecoder, Models, RangeDecoder, RunningMedian, SymbolModel
from voxelweave.sources.encode import Encoder


def test_bits_symbols_and_raw():
    r, e = random.Random(1), Encoder()
    b, s, tiny = BitModel(), SymbolModel(200), SymbolModel(3)
    want = []
    for _ in range(6000):
        v = (int(r.random() < 0.1), min(199, int(r.expovariate(0.1))), r.randrange(3), n := r.randrange(1, 32), r.getrandbits(n))
        want.append(v)
        e.bit(b, v[0]), e.symbol(s, v[1]), e.symbol(tiny, v[2]), e.raw(n, v[4])
    d = RangeDecoder(e.done())
    b, s, tiny = BitModel(), SymbolModel(200), SymbolModel(3)
    assert [(d.bit(b), d.symbol(s), d.symbol(tiny), v[3], d.raw(v[3])) for v in want] == want


def test_a_skewed_bit_takes_little_room():
    e, m = Encoder(), BitModel()
    for i in range(20_000):
        e.bit(m, int(i % 500 == 0))
    assert len(e.done()) < 100


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_integers(bits):
    r, e = random.Random(bits), Encoder()
    m = IntegerDecoder(None, bits, 2)
    lo, hi = (-(1 << 31), (1 << 31) - 1) if bits == 32 else (0, (1 << bits) - 1)
    want, last = [], 0
    for i in range(4000):
        v = r.randint(lo, hi) if i % 5 == 0 else max(lo, min(hi, last + r.randint(-40, 40)))
        v = (lo, hi)[i % 2] if i % 97 == 0 else v
        e.integer(m, last, v, i % 2)
        want.append(v)
        last = v
    d, last = IntegerDecoder(RangeDecoder(e.done()), bits, 2), 0
    for i, v in enumerate(want):
        last = d.decode(last, i % 2)
        assert last == v, i


def test_running_median():
    m, r = RunningMedian(), random.Random(4)
    for _ in range(50):
        m.add(1000 + r.randint(-3, 3))
    assert abs(m.value - 1000) <= 3
    m.add(10**6)
    assert abs(m.value - 1000) <= 3  # one outlier doesn't move it


def test_runs_of_symbols_are_read_as_one_by_one():
    r, e, s = random.Random(3), Encoder(), SymbolModel(64)
    want = [min(63, int(r.expovariate(0.2))) for _ in range(3000)]
    for v in want:
        e.symbol(s, v)
    by_last, also = Models(64), [r.randrange(2) for _ in range(3000)]
    last = 5
    for v, more in zip(want, also):
        e.symbol(by_last[last & 12 | more], v)
        last = v
    d, s, out = RangeDecoder(e.done()), SymbolModel(64), []
    assert d.symbols(s, 1234) + d.symbols(s, 1766) == want
    models, of = Models(64), [v & 12 for v in range(64)]
    last = d.chain(models, of, also[:700], 5, out)
    assert d.chain(models, of, also[700:], last, out) == want[-1] and out == want


def test_models_are_made_when_they_are_asked_for():
    """A chunk of a few points took most of its time for models that no point needed."""
    assert len(IntegerDecoder(None, 32, 2).within) == 0
