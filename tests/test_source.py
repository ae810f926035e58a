import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan
from points import some_points

from voxelweave.sources import octree
from voxelweave.sources.encode import layered_chunk
from voxelweave.sources.records import POINT, Dimension, FormatError, Header, Info, Vlr, pack_page, parse_dimensions, parse_page


def record(fmt, x, y, z, extra=b"", **more):
    p = np.zeros(1, dtype=POINT[fmt])
    for k, v in {"X": x, "Y": y, "Z": z, **more}.items():
        p[k] = v
    return p.tobytes() + extra


def chunk(fmt, first, n):
    extra = len(first) - POINT[fmt].itemsize
    return first + struct.pack("<I", n) + bytes(4 * (9 + (fmt in (7, 8)) + (fmt == 8) + extra))


def build(path, fmt=7, dims=(), chunks=(), nested=True, **header):
    """A file of chunks [(key, n, bytes)]; with nested the last one's entry sits in a page of its own."""
    length = POINT[fmt].itemsize + sum(d.size for d in dims)
    fixed = 375 + 54 + 160 + (54 + 192 * len(dims) if dims else 0)
    at, body, entries = fixed, b"", []
    for key, n, data in chunks:
        entries.append((*key, at + len(body), len(data), n))
        body += data
    sub = b""
    if nested:
        sub = pack_page(entries[-1:])
        entries = [*entries[:-1], (*chunks[-1][0], at + len(body), len(sub), -1)]
    page = pack_page(entries)
    info = Info((50.0, 50.0, 50.0), 50.0, 8.0, at + len(body) + len(sub), len(page))
    vlrs = [Vlr("copc", 1, info.pack()), *([Vlr("LASF_Spec", 4, b"".join(d.pack() for d in dims))] if dims else [])]
    h = Header(point_offset=fixed, n_vlrs=len(vlrs), point_format=fmt, record_length=length, point_count=sum(c[1] for c in chunks), scale=(0.5,) * 3, offset=(1.0, 2.0, 3.0), high=(100.0, 90.0, 80.0), **header)
    path.write_bytes(h.pack() + b"".join(v.pack() for v in vlrs) + body + sub + page)
    return str(path)


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    octree.register(spark)
    dims = (Dimension(3, "height", scale=(0.1, 0, 0), offset=(5.0, 0, 0)), Dimension(21, "rgb8"))
    one = record(7, 10, 20, 30, struct.pack("<H3B", 70, 1, 2, 3), Red=100, Green=255, Blue=0, returns=0x21, flags=0xC0, Classification=6, Intensity=9, GpsTime=1.5, ScanAngle=100)
    two = record(7, -4, 0, 8, struct.pack("<H3B", 10, 9, 8, 7), Red=4000)
    return build(tmp_path_factory.mktemp("oct") / "a.laz", 7, dims, [((0, 0, 0, 0), 1, chunk(7, one, 1)), ((1, 1, 0, 1), 3, chunk(7, two, 3))])


def load(spark, file, table, **options):
    r = spark.read.format("octree").option("table", table)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(file)


def test_metadata(spark, file):
    h = load(spark, file, "header").first()
    assert (h["point_format"], h["compressed"], h["point_count"], h["half"], h["low"], h["high"]) == (7, True, 4, 50.0, [0, 0, 0], [100, 90, 80])
    assert [(v["user_id"], v["record_id"]) for v in load(spark, file, "vlrs").collect()] == [("copc", 1), ("LASF_Spec", 4)]
    assert [(d["name"], d["components"], d["size"]) for d in load(spark, file, "dims").collect()] == [("height", 1, 2), ("rgb8", 3, 3)]


def test_hierarchy(spark, file):
    assert [(e["page_key"], e["d"], e["point_count"]) for e in load(spark, file, "entries").orderBy("seq").collect()] == [("0-0-0-0", 0, 1), ("0-0-0-0", 1, -1), ("1-1-0-1", 1, 3)]
    n = load(spark, file, "nodes").where("d = 1").first()
    assert (n["min_x"], n["max_x"], n["min_y"], n["max_z"], n["resolution"]) == (50, 100, 0, 100, 4.0)
    assert load(spark, file, "chunks").count() == 2


def test_points(spark, file):
    p = load(spark, file, "points").orderBy("d", "ord").collect()
    assert [(r["X"], r["Y"], r["Z"]) for r in p] == [(6, 12, 18)] + [(-1, 2, 7)] * 3
    a = p[0]
    assert (a["ReturnNumber"], a["NumberOfReturns"], a["ScanDirectionFlag"], a["EdgeOfFlightLine"], a["Classification"], a["GpsTime"], a["Nir"]) == (1, 2, True, True, 6, 1.5, None)
    assert a["Red"] == pytest.approx(100 / 255) and p[1]["Red"] == pytest.approx(4000 / 4095) and a["ScanAngle"] == pytest.approx(0.6)
    assert a["height"] == pytest.approx(12.0) and a["rgb8"] == [1, 2, 3] and p[3]["rgb8"] == [9, 8, 7]


def test_filters_choose_nodes(spark, file):
    assert load(spark, file, "points").where("d >= 1 AND kx = 1").count() == 3
    r = octree.OctreeReader({"path": file, "table": "points"})
    assert list(r.pushFilters([EqualTo(("d",), 0), EqualTo(("Intensity",), 1)])) == [EqualTo(("Intensity",), 1)]
    assert sum(len(q.rows) for q in r.partitions()) == 1


def test_formats(spark, tmp_path):
    octree.register(spark)
    for fmt in (6, 8):
        f = build(tmp_path / f"{fmt}.laz", fmt, (), [((0, 0, 0, 0), 2, chunk(fmt, record(fmt, 2, 4, 6), 2))], nested=False)
        assert load(spark, f, "points").select("X", "Nir").collect() == [(2.0, 0 if fmt == 8 else None)] * 2


def test_bad_chunks(spark, tmp_path):
    octree.register(spark)
    good = some_points(6, 40)
    for k, bad in enumerate((layered_chunk(good)[:50], layered_chunk(good)[:-9], record(6, 1, 1, 1)[:20], b"")):
        f = build(tmp_path / f"{k}.laz", 6, (), [((0, 0, 0, 0), 40, layered_chunk(good)), ((1, 0, 0, 0), 40, bad)], nested=False)
        assert load(spark, f, "points", mode="PERMISSIVE").count() == 40
        if bad:
            with pytest.raises(Exception, match="shorter"):
                load(spark, f, "points").count()
    # a record that the chunk's bytes don't fill
    f = build(tmp_path / "raw.laz", 6, (), [((0, 0, 0, 0), 2, record(6, 2, 4, 6) * 2), ((1, 0, 0, 0), 3, record(6, 2, 4, 6) * 2)], nested=False, compressed=False)
    assert load(spark, f, "points", mode="PERMISSIVE").count() == 2
    with pytest.raises(Exception, match="60 bytes for 3 points"):
        load(spark, f, "points").count()
    # the file ends in a chunk
    whole = build(tmp_path / "short.laz", 6, (), [((0, 0, 0, 0), 40, layered_chunk(good))], nested=False)
    with octree.open_file(whole) as h, pytest.raises(EOFError):
        octree.read_at(h, 10**6, 5)


@pytest.fixture(scope="module")
def coded(spark, tmp_path_factory):
    """A file of entropy-coded chunks: three nodes with an extra dimension."""
    octree.register(spark)
    dims = (Dimension(3, "height"),)
    points, extra, chunks = [], [], []
    for k, key in enumerate([(0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 1, 1)]):
        p = some_points(7, 150, k, 2)
        for axis, low in zip("XYZ", (1.0, 2.0, 3.0)):  # places within the node's cube
            side = 100 / 2 ** key[0]
            p[axis] = np.clip(np.abs(p[axis]) % 90 * side / 100 / 0.5 + (key["XYZ".index(axis) + 1] * side - low) / 0.5 + 3, None, None)
        more = np.random.default_rng(k).integers(0, 256, (150, 2)).astype(np.uint8)
        points.append(p)
        extra.append(more.view("<u2").ravel())
        chunks.append((key, 150, layered_chunk(p, more)))
    return build(tmp_path_factory.mktemp("coded") / "c.laz", 7, dims, chunks), points, extra


def test_coded_points(spark, coded):
    file, points, extra = coded
    got = load(spark, file, "points").orderBy("d", "kx", "ord").toPandas()
    p = np.concatenate(points)
    assert len(got) == 450
    for axis, low in zip("XYZ", (1.0, 2.0, 3.0)):
        assert np.array_equal(got[axis], p[axis] * 0.5 + low)
    assert np.array_equal(got["Intensity"], p["Intensity"]) and np.array_equal(got["Classification"], p["Classification"]) and np.array_equal(got["GpsTime"], p["GpsTime"])
    assert np.array_equal(got["ReturnNumber"], p["returns"] & 15) and np.array_equal(got["NumberOfReturns"], p["returns"] >> 4) and np.array_equal(got["height"], np.concatenate(extra))
    top = [max(int(q[c][:64].max()) for c in ("Red", "Green", "Blue")) for q in points]
    assert np.allclose(got["Green"][:150], points[0]["Green"] / np.float32(65535 if top[0] > 4095 else 4095))


def test_core_streams(spark, coded):
    file, points, _ = coded
    got = load(spark, file, "points", streams="core").where("d = 0").orderBy("ord").toPandas()
    assert np.array_equal(got["Z"], points[0]["Z"] * 0.5 + 3.0) and (got["Intensity"] == points[0]["Intensity"][0]).all()


def test_places_choose_nodes(spark, coded):
    file, _, _ = coded
    r = octree.OctreeReader({"path": file, "table": "points"})
    tests = [GreaterThan(("X",), 60.0), EqualTo(("d",), 1)]
    assert list(r.pushFilters(tests)) == tests[:1]
    assert [q[2:6] for part in r.partitions() for q in part.rows] == [(1, 1, 1, 1)]
    want = load(spark, file, "points").toPandas()
    assert load(spark, file, "points").where("X > 60 AND Y <= 80.5 AND Z >= 55").count() == ((want["X"] > 60) & (want["Y"] <= 80.5) & (want["Z"] >= 55)).sum() > 0


def test_many_files(spark, coded, tmp_path):
    file, points, _ = coded
    for name in ("a.laz", "b.laz", "c.txt"):
        (tmp_path / name).write_bytes(open(file, "rb").read())
    for path in (str(tmp_path), f"{tmp_path}/*.laz", f"file://{tmp_path}/[ab].laz"):
        got = load(spark, path, "points", withFile="true").groupBy("file").count().collect()
        assert sorted((r["file"].rsplit("/", 1)[1], r["count"]) for r in got) == [("a.laz", 450), ("b.laz", 450)]
    assert load(spark, str(tmp_path), "nodes").where("d = 1").count() == 4 and load(spark, str(tmp_path), "header").count() == 2
    with pytest.raises(FileNotFoundError):
        octree.files_of(f"{tmp_path}/*.none")


def test_chunk_dump(spark, coded, tmp_path):
    octree.write_chunks(spark, coded[0], str(tmp_path / "dump"))
    got = {r["d"]: (r["nodes"], r["points"], r["bytes"]) for r in octree.chunk_totals(spark.read.parquet(str(tmp_path / "dump"))).collect()}
    nodes = load(spark, coded[0], "nodes").collect()
    assert got == {d: (sum(n["d"] == d for n in nodes), sum(n["point_count"] for n in nodes if n["d"] == d), sum(n["byte_size"] for n in nodes if n["d"] == d)) for d in (0, 1)}


def test_errors(tmp_path):
    with pytest.raises(FormatError, match="signature"):
        Header.parse(b"ABCD" + bytes(400))
    with pytest.raises(FormatError, match="160"):
        Info.parse(bytes(159))
    with pytest.raises(FormatError, match="31 bytes"):
        parse_page(bytes(31))
    with pytest.raises(FormatError, match="negative"):
        parse_page(pack_page([(0, 0, 0, 0, 0, 0, -2)]))
    f = build(tmp_path / "v.laz", 6, (), [((0, 0, 0, 0), 1, b"x" * 80)], nested=False, version=(1, 3))
    with octree.open_file(f) as h, pytest.raises(FormatError, match="1.3"):
        octree.read_meta(h)


@pytest.mark.parametrize("kind", range(31))
def test_dimension_kinds(kind):
    d = Dimension(kind, "a", scale=(0.0, 2.0, 0.0), offset=(1.0, 1.0, 1.0))
    assert parse_dimensions(d.pack() + b"trailing") == [d]
    raw = np.array([[*(np.arange(1, d.components + 1).astype(d.base).tobytes() if kind else b"")]], dtype=np.uint8).reshape(1, -1)
    want = [0.0] if not kind else [1.0, 5.0, 3.0][: d.components]
    assert d.values(raw, 0).tolist() == [want]


def test_header_round_trip():
    h = Header(point_offset=999, n_vlrs=3, point_count=1 << 40, scale=(0.1, 0.2, 0.3), low=(-1.0, -2.0, -3.0), high=(4.0, 5.0, 6.0), by_return=tuple(range(15)), system="s", software="w")
    assert Header.parse(h.pack()) == h and len(h.pack()) == 375


def test_extended_records(tmp_path):
    """A projection that lies behind the points is found; one that is cut short is an error."""
    from dataclasses import replace

    path = build(tmp_path / "e.laz", 6, (), [((0, 0, 0, 0), 1, chunk(6, record(6, 1, 2, 3), 1))], nested=False)
    data = open(path, "rb").read()
    one = lambda user, number, body: struct.pack("<H16sHQ32s", 0, user, number, len(body), b"x") + body
    extended = one(b"other", 7, b"12345") + one(b"LASF_Projection", 2112, b"PROJCS[]\0tail")
    head = replace(Header.parse(data), evlr_offset=len(data), n_evlrs=2)
    for whole, n in ((extended, 0), (extended[:-3], 1)):
        (tmp_path / f"{n}.laz").write_bytes(head.pack() + data[375:] + whole)
        with octree.open_file(str(tmp_path / f"{n}.laz")) as f:
            if n:
                with pytest.raises(EOFError):
                    octree.read_meta(f)
            else:
                assert octree.read_meta(f).wkt == "PROJCS[]"
