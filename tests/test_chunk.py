"""The chunk decoder against an encoder that goes point by point."""

import hashlib
import time

import numpy as np
import pytest
from points import some_points

from voxelweave.sources import chunk
from voxelweave.sources.encode import encode_chunk, layered_chunk, single_chunk
from voxelweave.sources.records import POINT, FormatError

#: Fixed values of the format, written out where the decoder has a rule: number of returns by return number.
RETURNS = [
    [0, 1, 2, 3, 4, 5, 3, 4, 4, 5, 5, 5, 5, 5, 5, 5],
    [1, 0, 1, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3],
    [2, 1, 2, 4, 4, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3],
    [3, 3, 4, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4],
]


@pytest.mark.parametrize("fmt, channels, extra", [(6, 1, 0), (6, 4, 3), (7, 1, 0), (7, 3, 2), (8, 1, 0), (8, 4, 5)])
def test_layered_formats(fmt, channels, extra):
    p = some_points(fmt, 1200, fmt + channels, channels)
    more = np.random.default_rng(1).integers(0, 256, (len(p), extra)).astype(np.uint8)
    length = POINT[fmt].itemsize + extra
    got = chunk.decode_chunk(layered_chunk(p, more), len(p), fmt, length)
    base = np.ascontiguousarray(got[:, : POINT[fmt].itemsize]).view(POINT[fmt]).ravel()
    for name in p.dtype.names:
        assert (base[name].view(f"V{base[name].itemsize}") == p[name].view(f"V{base[name].itemsize}")).all(), name
    assert (got[:, POINT[fmt].itemsize :] == more).all()


@pytest.mark.parametrize("n", [1, 2, 1500])
def test_format_0(n):
    p = some_points(0, n, 5)
    got = chunk.decode_chunk(single_chunk(p), n, 0, 20).view(POINT[0]).ravel()
    assert (got == p).all()


def test_core_streams_keep_the_other_fields_of_the_first_point():
    p = some_points(8, 400, 2, 2)
    got = chunk.decode_chunk(layered_chunk(p), len(p), 8, POINT[8].itemsize, chunk.CORE).view(POINT[8]).ravel()
    for name in ("X", "Y", "Z", "returns", "Red", "Green", "Blue"):
        assert (got[name] == p[name]).all(), name
    for name in ("Intensity", "Classification", "UserData", "PointSourceId", "ScanAngle", "Nir"):
        assert (got[name] == p[name][0]).all() and not (p[name] == p[name][0]).all(), name
    assert ((got["flags"] >> 4 & 3) == (p["flags"] >> 4 & 3)).all()


def test_repeated_points_have_no_streams():
    p = np.repeat(some_points(7, 1), 50)
    data = p[:1].tobytes() + (50).to_bytes(4, "little") + bytes(40)
    assert (chunk.decode_chunk(data, 50, 7, 36).view(POINT[7]).ravel() == p).all()


def test_contexts_of_places_are_the_format_s_table():
    for n, row in enumerate(RETURNS):
        assert [chunk.spread(n, r) for r in range(16)] == row == [chunk.spread(r, n) for r in range(16)]
    assert [[chunk.spread(n, r) for r in range(10, 16)] for n in (10, 11, 13, 15)] == [[5, 4, 4, 4, 4, 4], [4, 5, 5, 4, 4, 4], [4, 4, 5, 5, 5, 4], [4, 4, 4, 4, 5, 5]]
    assert [chunk.level(n, r) for n, r in ((0, 0), (3, 1), (15, 2))] == [0, 2, 7]


def test_bad_chunks():
    p = some_points(6, 30)
    data = layered_chunk(p)
    for cut in (0, 10, 31, 60, len(data) - 5):
        with pytest.raises(FormatError):
            chunk.decode_chunk(data[:cut], 30, 6, 30)
    with pytest.raises(FormatError):
        chunk.decode_chunk(data, 30, 7, 30)
    with pytest.raises(NotImplementedError, match="format 3"):
        chunk.decode_chunk(data, 30, 3, 34)
    assert len(chunk.decode_chunk(data, 0, 6, 30)) == 0
    with pytest.raises(FormatError, match="only points"):
        encode_chunk(np.zeros(2, dtype=POINT[3]))
    spoilt = bytearray(data)
    spoilt[90] ^= 0xFF  # wrong bytes give other points, not an endless loop
    assert len(chunk.decode_chunk(bytes(spoilt), 30, 6, 30)) == 30


#: Digests of what an encoder that went point by point made of the same points, by format, channels, extra bytes and number.
CODED = {
    (6, 1, 0, 2): "b34cd3a52ab48896",
    (6, 4, 3, 1500): "974f06262c20f9cd",
    (7, 1, 8, 1500): "7d30802ef1b33fe1",
    (7, 2, 0, 3): "f23829dac66f625a",
    (7, 4, 8, 2500): "299deb1df57ae524",
    (8, 1, 0, 1): "bd714e3593f56c8d",
    (8, 3, 5, 1500): "e2254987c6e05bd5",
}


@pytest.mark.parametrize("fmt, channels, extra, n", CODED)
def test_coded_bytes_are_those_of_an_encoder_that_goes_point_by_point(fmt, channels, extra, n):
    p = some_points(fmt, n, fmt * 7 + channels + n, channels)
    more = np.random.default_rng(1).integers(0, 256, (n, extra)).astype(np.uint8)
    data = layered_chunk(p, more)
    assert hashlib.sha256(data).hexdigest()[:16] == CODED[fmt, channels, extra, n]
    got = chunk.decode_chunk(data, n, fmt, POINT[fmt].itemsize + extra)
    assert got.tobytes() == np.concatenate((p.view(np.uint8).reshape(n, -1), more), axis=1).tobytes()


def took(f):
    best = None
    for _ in range(3):
        t = time.process_time()
        f()
        best = min(time.process_time() - t, best or 1e9)
    return best


def test_encoding_goes_stream_by_stream():
    """Point by point it took as long as 1163 steps of a plain loop a point; stream by stream 237."""
    p, more = some_points(7, 6000, 4), np.random.default_rng(1).integers(0, 256, (6000, 8)).astype(np.uint8)

    def steps():
        x = 0
        for i in range(1_000_000):
            x += i * i

    assert took(lambda: layered_chunk(p, more)) / len(p) < 600 * took(steps) / 1_000_000
