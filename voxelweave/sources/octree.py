"""Spark data source of octree point cloud files.

    octree.register(spark)
    spark.read.format("octree").option("table", "nodes").load("hdfs://.../a.laz")

The path is a file, a folder of .laz files (and .las) or a pattern. Tables: header, vlrs, dims (metadata), entries (all
of the hierarchy), nodes (with bounds), chunks (nodes with their bytes) and points. Of one file, the hierarchy is walked
by the planning worker, and chunks and points are read by tasks of about `chunkBytes` each, in file order; of many
files, each is a task of its own, which walks its hierarchy itself. withFile=true adds the file's path as a column.

Comparisons of d, kx, ky, kz, point_count and resolution with literals choose nodes before any chunk is read, and so do
those of X, Y and Z, by the cubes of the nodes; Spark then tests the points. mode=FAILFAST fails on a bad chunk,
PERMISSIVE leaves it out. streams=core decodes places, returns, colours and extra dimensions only and leaves other
fields of compressed points as their chunk's first point has them; all is the default, and other streams may be added by
name, as in core,PointSourceId.

    points.repartition("d", "kx", "ky", "kz").sortWithinPartitions("d", "kx", "ky", "kz", "ord")
        .write.format("octree").mode("append").option("center", "0,0,0").option("half", 50).save(folder)

writes a file for each partition that has rows, with the nodes that its rows belong to: rows of one node must come one
after another. Options: center and half (the cube), spacing, pointFormat (6, 7 or 8), compressed, scale, offset, low
and high (three numbers each), wkt. Columns that are no field of a point become extra dimensions of 32-bit floats.
"""

from __future__ import annotations

import fnmatch
import logging
import operator
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.voxel import Octree
from .chunk import ALL, CORE, decode_chunk
from .encode import encode_chunk
from .records import DIM_BYTES, ENTRY, EVLR_BYTES, HEADER_BYTES, INFO_BYTES, POINT, Dimension, FormatError, Header, Info, Vlr, evlr_head, find_vlr, kind_of, pack_page, parse_dimensions, parse_page, parse_vlrs


log = logging.getLogger(__name__)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def open_file(path: str) -> pa.NativeFile:
    fs, path = filesystem(path)
    return fs.open_input_file(path)


def files_of(path: str) -> list[str]:
    """The files that a path, a folder or a pattern of names (* ? [ in the last part) stands for."""
    head, last = posixpath.split(path.rstrip("/"))
    pattern = any(c in last for c in "*?[")
    fs, inner = filesystem(head if pattern else path)
    if not pattern and fs.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
        return [path]
    found = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if i.type == pyarrow.fs.FileType.File]
    own = [f for f in found if fnmatch.fnmatchcase(posixpath.basename(f), last if pattern else "*.la[sz]")]
    if not own:
        raise FileNotFoundError(f"no files at {path}")
    base = (head if pattern else path).rstrip("/")
    return sorted(f"{base}/{posixpath.basename(f)}" for f in own)


class Opened:
    """A file that is open already, or any seekable stream of bytes, read by offset. leave_open: close() leaves it so."""

    def __init__(self, stream: object, leave_open: bool = True):
        self.stream, self.leave_open = stream, leave_open

    def read_at(self, n: int, at: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def close(self) -> None:
        if not self.leave_open:
            self.stream.close()

    def __enter__(self) -> "Opened":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def read_points(f: "pa.NativeFile | Opened", streams: frozenset = ALL) -> Iterator[tuple[tuple[int, ...], dict[str, np.ndarray | None]]]:
    """Without Spark: the key of each node of one file and its points as columns, in file order."""
    meta = read_meta(f)
    entries, _ = read_entries(f, meta.info)
    for e in entries[np.argsort(entries["offset"], kind="stable")]:
        if kind_of(e) == "node":
            yield tuple(int(e[k]) for k in "dxyz"), points_of(decode(read_at(f, int(e["offset"]), int(e["byte_size"])), int(e["point_count"]), meta.header, streams), meta)


def read_at(f: pa.NativeFile, at: int, n: int) -> bytes:
    data = f.read_at(n, at)
    if len(data) < n:
        raise EOFError(f"{n} bytes wanted at {at}, {len(data)} there")
    return data


@dataclass(frozen=True)
class Meta:
    header: Header
    vlrs: tuple[Vlr, ...]
    info: Info
    dims: tuple[Dimension, ...]
    wkt: str | None

    def octree(self, bounds_mode: str = "extents") -> Octree:
        return Octree(self.info.center, self.info.half, self.info.spacing, self.header.low, self.header.high, bounds_mode)


def read_meta(f: pa.NativeFile) -> Meta:
    header = Header.parse(f.read_at(HEADER_BYTES, 0))
    if header.version != (1, 4):
        raise FormatError(f"version {header.version[0]}.{header.version[1]} instead of 1.4")
    vlrs = parse_vlrs(read_at(f, header.header_size, header.point_offset - header.header_size), header.n_vlrs)
    info = find_vlr(vlrs, "copc", 1)
    if info is None:
        raise FormatError("no octree record")
    dims = find_vlr(vlrs, "LASF_Spec", 4)
    wkt = find_vlr(vlrs, "LASF_Projection", 2112)
    text = wkt.data if wkt else _extended(f, header, "LASF_Projection", 2112)
    return Meta(header, tuple(vlrs), Info.parse(info.data), tuple(parse_dimensions(dims.data)) if dims else (), text.split(b"\0")[0].decode("utf-8", "replace") if text is not None else None)


def _extended(f: "pa.NativeFile | Opened", header: Header, user_id: str, record_id: int) -> bytes | None:
    """The data of an extended record, which lie behind the points; others are passed over."""
    at = header.evlr_offset
    for _ in range(header.n_evlrs if at else 0):
        one, length = evlr_head(read_at(f, at, EVLR_BYTES))
        at += EVLR_BYTES
        if (one.user_id, one.record_id) == (user_id, record_id):
            return read_at(f, at, length)
        at += length
    return None


def read_entries(f: pa.NativeFile, info: Info) -> tuple[np.ndarray, list[str]]:
    """All entries in file order, a page's own ones before those of its subpages, and the page key of each."""
    out, pages, todo = [], [], [("0-0-0-0", info.root_offset, info.root_size)]  # the next page is the last
    seen = set()
    while todo:
        key, at, size = todo.pop()
        if at in seen:
            raise FormatError("a hierarchy page refers to itself")
        seen.add(at)
        e = parse_page(read_at(f, at, size))
        out.append(e)
        pages += [key] * len(e)
        sub = e[e["point_count"] < 0]
        todo += [(f"{p['d']}-{p['x']}-{p['y']}-{p['z']}", int(p["offset"]), int(p["byte_size"])) for p in sub[::-1]]
    return np.concatenate(out) if out else np.zeros(0, dtype=ENTRY), pages


def decode(chunk: bytes, n: int, header: Header, streams: frozenset = ALL) -> np.ndarray:
    """The n records of a chunk as bytes (n, record length)."""
    length, fmt = header.record_length, header.point_format
    if header.compressed:
        return decode_chunk(chunk, n, fmt, length, streams)
    if fmt not in POINT or length < POINT[fmt].itemsize:
        raise FormatError(f"points of format {fmt} and {length} bytes")
    if len(chunk) < n * length:
        raise FormatError(f"a chunk of {len(chunk)} bytes for {n} points of {length}")
    return np.frombuffer(chunk, dtype=np.uint8, count=n * length).reshape(n, length)


def points_of(raw: np.ndarray, meta: Meta) -> dict[str, np.ndarray | None]:
    header = meta.header
    base = POINT[header.point_format]
    p = np.ascontiguousarray(raw[:, : base.itemsize]).view(base).ravel()
    out: dict = {a: p[a] * header.scale[i] + header.offset[i] for i, a in enumerate("XYZ")}
    new = header.point_format >= 6
    bits = p["returns"] if new else p["bits"]
    flags = p["flags"] if new else p["bits"]
    out |= {
        "Intensity": p["Intensity"].astype(np.int32), "ReturnNumber": (bits & (15 if new else 7)).astype(np.int16), "NumberOfReturns": ((bits >> (4 if new else 3)) & (15 if new else 7)).astype(np.int16),
        "ScanDirectionFlag": (flags >> 6) & 1 == 1, "EdgeOfFlightLine": (flags >> 7) & 1 == 1, "Classification": (p["Classification"] & (255 if new else 31)).astype(np.int16),
        "ScanAngle": p["ScanAngle"] * 0.006 if new else p["ScanAngle"].astype(np.float64), "UserData": p["UserData"].astype(np.int16), "PointSourceId": p["PointSourceId"].astype(np.int32),
        "GpsTime": p["GpsTime"] if "GpsTime" in base.names else None, "Nir": p["Nir"].astype(np.int32) if "Nir" in base.names else None,
    }
    if "Red" in base.names and len(p):
        top = max(int(p[c][:64].max()) for c in ("Red", "Green", "Blue"))
        by = np.float32(255 if top <= 255 else 4095 if top <= 4095 else 65535)
    for c in ("Red", "Green", "Blue"):
        out[c] = (p[c].astype(np.float32) / by if len(p) else p[c].astype(np.float32)) if c in base.names else None
    extra, at = raw[:, base.itemsize :], 0
    for dim in meta.dims:
        v = dim.values(extra, at)
        out[dim.name] = v[:, 0] if dim.components == 1 else v
        at += dim.size if at + dim.size <= extra.shape[1] else 0
    return out


_KEY = "d int, kx int, ky int, kz int"
_BOUNDS = "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
_ENTRY = f"seq int, page_key string, {_KEY}, offset long, byte_size int, point_count int"
_FIELDS = (
    "X double, Y double, Z double, Intensity int, ReturnNumber short, NumberOfReturns short, ScanDirectionFlag boolean, EdgeOfFlightLine boolean, Classification short, ScanAngle double, "
    "UserData short, PointSourceId int, GpsTime double, Red float, Green float, Blue float, Nir int"
)


def streams_of(option: str) -> frozenset:
    """all or core, or names of streams, or several of these between commas."""
    known = {"all": ALL, "core": CORE} | {name.lower(): frozenset({name}) for name in ALL}
    return frozenset().union(*(known[one.strip().lower()] for one in option.split(",")))


class OctreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "octree"

    def schema(self) -> str:
        table = self.options.get("table", "points")
        if table == "points":
            with open_file(files_of(self.options["path"])[0]) as f:  # all files have the first one's extra dimensions
                dims = read_meta(f).dims
            extra = "".join(f", `{d.name}` {'float' if d.components == 1 else 'array<float>'}" for d in dims)
            return f"{_KEY}, ord int, {_FIELDS}{extra}{self._file()}"
        known = {
            "header": "point_format int, compressed boolean, record_length int, point_count long, scale array<double>, offset array<double>, low array<double>, high array<double>, center array<double>, half double, spacing double, wkt string",
            "vlrs": "seq int, user_id string, record_id int, description string, data binary", "dims": "ordinal int, name string, kind int, components int, size int, scale array<double>, offset array<double>, description string",
            "entries": _ENTRY, "nodes": f"seq int, {_KEY}, offset long, byte_size int, point_count int, {_BOUNDS}, resolution double", "chunks": f"seq int, {_KEY}, point_count int, data binary",
        }
        if table not in known:
            raise ValueError(f"unknown table {table}")
        return known[table] + self._file()

    def _file(self) -> str:
        return ", file string" if _flag(self.options, "withFile") else ""

    def reader(self, schema: object) -> "OctreeReader":
        return OctreeReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> "OctreeWriter":
        return OctreeWriter(dict(self.options), [f.name for f in schema.fields], overwrite)


def _flag(options: dict[str, str], name: str) -> bool:
    return str(options.get(name, options.get(name.lower(), "false"))).lower() == "true"


@dataclass
class Part(InputPartition):
    """Rows of one file's hierarchy, or None: the task finds them itself."""

    path: str
    rows: list | None = None


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class OctreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table, self.files = options.get("table", "points"), files_of(options["path"])
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.chunk_bytes = int(options.get("chunkbytes", options.get("chunkBytes", 64 << 20)))
        self.bounds_mode = options.get("boundsmode", options.get("boundsMode", "extents"))
        self.streams = streams_of(options.get("streams", "all"))
        self.with_file = _flag(options, "withFile")
        self.tests: list[tuple] = []
        self.metas: dict[str, Meta] = {}
        self._meta(self.files[0])

    def _meta(self, path: str) -> Meta:
        if path not in self.metas:
            with open_file(path) as f:
                self.metas[path] = read_meta(f)
        return self.metas[path]

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of the node's own columns choose nodes; Spark keeps all others, and those of places besides."""
        if self.table in ("nodes", "chunks", "points", "entries"):
            names = {"d", "kx", "ky", "kz"} | ({"point_count"} if self.table != "points" else set()) | ({"resolution"} if self.table == "nodes" else set())
            for one in filters:
                plain = type(one) in _TESTS and len(one.attribute) == 1
                if plain and one.attribute[0] in names:
                    self.tests.append((one.attribute[0], type(one).__name__, one.value))
                    continue
                if plain and self.table == "points" and one.attribute[0] in ("X", "Y", "Z"):
                    self.tests.append((one.attribute[0], type(one).__name__, one.value))
                yield one
        else:
            yield from filters

    def _wanted(self, e: np.ndarray, meta: Meta) -> np.ndarray:
        by = {k.__name__: v for k, v in _TESTS.items()}
        out = np.ones(len(e), dtype=bool)
        for name, test, value in self.tests:
            if name in ("X", "Y", "Z"):
                # the node's cube, wider by a step of the scale for what rounding has moved
                axis = "XYZ".index(name)
                span = 2 * meta.info.half / 2.0 ** e["d"]
                low = meta.info.center[axis] - meta.info.half + e[name.lower()] * span
                room = abs(meta.header.scale[axis])
                if test in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    out &= low + span + room >= value
                if test in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    out &= low - room <= value
            else:
                out &= by[test](meta.info.spacing / 2.0 ** e["d"] if name == "resolution" else e[name.removeprefix("k")], value)
        return out

    def _rows(self, path: str) -> list[tuple]:
        """The wanted entries of a file as (seq, page key, d, x, y, z, offset, byte size, point count)."""
        meta = self._meta(path)
        with open_file(path) as f:
            e, pages = read_entries(f, meta.info)
        pick = self._wanted(e, meta) & ((e["point_count"] >= 0) | (self.table == "entries"))
        rows = [(int(i), pages[i], *map(int, e[i])) for i in np.flatnonzero(pick)]
        return sorted(rows, key=lambda r: r[6]) if self.table in ("chunks", "points") else rows

    def partitions(self) -> list[InputPartition]:
        if len(self.files) > 1 or self.table in ("header", "vlrs", "dims"):
            return [Part(path) for path in self.files]
        path = self.files[0]
        rows = self._rows(path)
        if self.table not in ("chunks", "points"):
            return [Part(path, rows[i : i + 50_000]) for i in range(0, len(rows), 50_000)] or [Part(path, [])]
        out, held, size = [], [], 0
        for r in rows:
            held.append(r)
            size += r[7]
            if size >= self.chunk_bytes:
                out.append(Part(path, held))
                held, size = [], 0
        return [*out, Part(path, held)] if held or not out else out

    def read(self, part: Part) -> Iterator:
        m = self._meta(part.path)
        if self.table in ("chunks", "points"):
            yield from self._chunks(part, m)
            return
        for row in self._records(part, m):
            yield (*row, part.path) if self.with_file else row

    def _records(self, part: Part, m: Meta) -> Iterator[tuple]:
        h = m.header
        if self.table == "header":
            yield (h.point_format, h.compressed, h.record_length, h.point_count, list(h.scale), list(h.offset), list(h.low), list(h.high), list(m.info.center), m.info.half, m.info.spacing, m.wkt)
        elif self.table == "vlrs":
            yield from ((i, v.user_id, v.record_id, v.description, v.data) for i, v in enumerate(m.vlrs))
        elif self.table == "dims":
            yield from ((i, d.name, d.kind, d.components, d.size, list(d.scale), list(d.offset), d.description) for i, d in enumerate(m.dims))
        else:
            rows = self._rows(part.path) if part.rows is None else part.rows
            if self.table == "entries":
                yield from rows
                return
            tree = m.octree(self.bounds_mode)
            for seq, _, d, x, y, z, offset, size, n in rows:
                span = tree.side / 2.0**d
                low = [o + k * span for o, k in zip(tree.origin, (x, y, z))]
                yield (seq, d, x, y, z, offset, size, n, *low, *[v + span for v in low], tree.spacing / 2.0**d)

    def _chunks(self, part: Part, meta: Meta) -> Iterator:
        rows = self._rows(part.path) if part.rows is None else part.rows
        with open_file(part.path) as f:
            for seq, _, d, x, y, z, offset, size, n in rows:
                try:
                    data = read_at(f, offset, size)
                    if self.table == "chunks":
                        yield (seq, d, x, y, z, n, data, part.path) if self.with_file else (seq, d, x, y, z, n, data)
                        continue
                    if not n or not size:
                        continue
                    cols = points_of(decode(data, n, meta.header, self.streams), meta)
                except (FormatError, EOFError, NotImplementedError) as e:
                    if self.permissive:
                        log.warning("%s: chunk %d-%d-%d-%d left out: %s", part.path, d, x, y, z, e)
                        continue
                    raise
                log.debug("%s: %d points of chunk %d-%d-%d-%d", part.path, n, d, x, y, z)
                yield _batch((d, x, y, z), cols, n, part.path if self.with_file else None)


_TYPES = {"Intensity": pa.int32(), "PointSourceId": pa.int32(), "Nir": pa.int32(), "GpsTime": pa.float64(), "Red": pa.float32(), "Green": pa.float32(), "Blue": pa.float32()}
_ORDER = [c.split()[0] for c in _FIELDS.split(", ")]


def _batch(key: tuple[int, ...], cols: dict, n: int, path: str | None) -> pa.RecordBatch:
    """A chunk's points in the order of the schema."""
    names = [*_ORDER, *[c for c in cols if c not in _ORDER]]
    out = [pa.array(np.full(n, k, dtype=np.int32)) for k in key] + [pa.array(np.arange(n, dtype=np.int32))]
    for name in names:
        v = cols[name]
        if v is None:
            out.append(pa.nulls(n, _TYPES[name]))
        elif v.ndim == 2:
            out.append(pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * v.shape[1], np.ascontiguousarray(v).ravel()))
        else:
            out.append(pa.array(np.ascontiguousarray(v), type=_TYPES.get(name)))
    if path is not None:
        out.append(pa.repeat(path, n))
        names.append("file")
    return pa.RecordBatch.from_arrays(out, names=["d", "kx", "ky", "kz", "ord", *names])


@dataclass(frozen=True)
class Config:
    """What a written file's header says beside its points."""

    point_format: int = 7
    compressed: bool = True
    scale: tuple[float, ...] = (0.01,) * 3
    offset: tuple[float, ...] = (0.0,) * 3
    center: tuple[float, ...] = (0.0,) * 3
    half: float = 1.0
    spacing: float = 1.0
    low: tuple[float, ...] | None = None
    high: tuple[float, ...] | None = None
    wkt: str | None = None

    @classmethod
    def of(cls, options: dict[str, str]) -> "Config":
        given = {k.lower(): v for k, v in options.items()}
        three = lambda name, default: tuple(map(float, given[name].split(","))) if name in given else default
        out = cls(
            int(given.get("pointformat", 7)), given.get("compressed", "true").lower() == "true", three("scale", cls.scale), three("offset", cls.offset), three("center", cls.center),
            float(given.get("half", 1)), float(given.get("spacing", 1)), three("low", None), three("high", None), given.get("wkt"),
        )
        if out.point_format not in (6, 7, 8):
            raise ValueError(f"points of format {out.point_format} aren't written")
        return out


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    points: int


class OctreeWriter(DataSourceArrowWriter):
    """A file a task; a failed job's files are deleted."""

    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.folder, self.config, self.names = options["path"].rstrip("/"), Config.of(options), names
        missing = {"d", "kx", "ky", "kz", "X", "Y", "Z"} - set(names)
        if missing:
            raise ValueError(f"points need columns {sorted(missing)}")
        self.dims = tuple(Dimension(9, n) for n in names if n not in {*_ORDER, "d", "kx", "ky", "kz", "ord", "file"})
        fs, inner = filesystem(self.folder)
        if overwrite and fs.get_file_info(inner).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir_contents(inner)
        fs.create_dir(inner, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        path, points = f"{self.folder}/part-{uuid.uuid4().hex}.laz", 0
        file = None
        for key, table in self._nodes(iterator):
            file = file or _FileOfNodes(path, self.config, self.dims)
            file.add(key, *self._records(table))
            points += table.num_rows
        if file:
            file.close()
        return Written(path if file else None, points)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.path:
                fs, inner = filesystem(m.path)
                fs.delete_file(inner)

    def _nodes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(self.names.index(k))) for k in ("d", "kx", "ky", "kz")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                own = tuple(keys[a].tolist())
                if held and own != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield key, pa.Table.from_batches(held)

    def _records(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The points of a node as records, and their extra bytes."""
        c, p = self.config, np.zeros(table.num_rows, dtype=POINT[self.config.point_format])
        get = lambda name: np.asarray(table.column(name).combine_chunks().fill_null(0) if name in table.column_names else np.zeros(len(p)))
        for i, axis in enumerate("XYZ"):
            p[axis] = np.rint((get(axis) - c.offset[i]) / c.scale[i])
        p["returns"] = get("ReturnNumber").astype(int) & 15 | (get("NumberOfReturns").astype(int) & 15) << 4
        p["flags"] = get("ScanDirectionFlag").astype(int) << 6 | get("EdgeOfFlightLine").astype(int) << 7
        p["ScanAngle"] = np.rint(get("ScanAngle") / 0.006)
        for name in ("Intensity", "Classification", "UserData", "PointSourceId", "GpsTime", "Red", "Green", "Blue", "Nir"):
            if name in p.dtype.names:
                p[name] = get(name)
        extra = np.stack([get(d.name).astype("<f4") for d in self.dims], axis=1).view(np.uint8) if self.dims else np.zeros((len(p), 0), dtype=np.uint8)
        return p, extra.reshape(len(p), -1)


class _FileOfNodes:
    """A file to which nodes are added one by one; the header comes first, so its place is kept free until the end."""

    def __init__(self, path: str, config: Config, dims: tuple[Dimension, ...]):
        self.path, self.config, self.dims, self.entries, self.body, self.low, self.high = path, config, dims, [], [], None, None
        self.returns = np.zeros(15, dtype=np.int64)
        self.fixed = HEADER_BYTES + 54 + INFO_BYTES + (54 + DIM_BYTES * len(dims) if dims else 0) + (54 + len(config.wkt.encode()) + 1 if config.wkt else 0)
        self.at = self.fixed

    def add(self, key: tuple[int, ...], p: np.ndarray, extra: np.ndarray) -> None:
        c = self.config
        raw = np.concatenate((p.view(np.uint8).reshape(len(p), -1), extra), axis=1).tobytes()
        data = encode_chunk(p, extra) if c.compressed else raw
        self.entries.append((*key, self.at, len(data), len(p)))
        self.body.append(data)
        self.at += len(data)
        xyz = np.stack([p[a] * c.scale[i] + c.offset[i] for i, a in enumerate("XYZ")])
        self.low = xyz.min(1) if self.low is None else np.minimum(self.low, xyz.min(1))
        self.high = xyz.max(1) if self.high is None else np.maximum(self.high, xyz.max(1))
        self.returns += np.bincount((p["returns"] & 15).astype(int), minlength=16)[1:16]

    def close(self) -> None:
        c, page = self.config, pack_page(self.entries)
        info = Info(c.center, c.half, c.spacing, self.at, len(page))
        vlrs = [Vlr("copc", 1, info.pack())]
        if self.dims:
            vlrs.append(Vlr("LASF_Spec", 4, b"".join(d.pack() for d in self.dims)))
        if c.wkt:
            vlrs.append(Vlr("LASF_Projection", 2112, c.wkt.encode() + b"\0"))
        head = Header(
            point_offset=self.fixed, n_vlrs=len(vlrs), point_format=c.point_format, compressed=c.compressed, record_length=POINT[c.point_format].itemsize + sum(d.size for d in self.dims),
            point_count=sum(e[6] for e in self.entries), by_return=tuple(self.returns.tolist()), scale=c.scale, offset=c.offset, low=c.low or tuple(self.low.tolist()), high=c.high or tuple(self.high.tolist()), software="voxelweave",
        )
        fs, inner = filesystem(self.path)
        with fs.open_output_stream(inner) as f:
            for part in (head.pack(), *(v.pack() for v in vlrs), *self.body, page):
                f.write(part)


def register(spark: object) -> None:
    """Makes the format known and lets Spark hand its filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OctreeSource)


def write_chunks(spark: object, path: str, target: str) -> None:
    """Every node's bytes as a Parquet row, partitioned by depth."""
    register(spark)
    spark.read.format("octree").option("table", "chunks").load(path).write.partitionBy("d").parquet(target)


def chunk_totals(chunks: object) -> object:
    """By depth: nodes, their points and bytes, of the table that write_chunks() has written."""
    from pyspark.sql import functions as F

    return chunks.groupBy("d").agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"), F.sum(F.octet_length("data")).alias("bytes"))
