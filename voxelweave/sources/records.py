"""Binary layouts of the point cloud file: header, records, hierarchy pages, attributes. Little-endian throughout."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

HEADER_BYTES = 375
INFO_BYTES = 160
ENTRY = np.dtype([("d", "<i4"), ("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("offset", "<u8"), ("byte_size", "<i4"), ("point_count", "<i4")])
DIM_BYTES = 192

_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Intensity", "<u2")]
_OLD = [*_CORE, ("bits", "u1"), ("Classification", "u1"), ("ScanAngle", "i1"), ("UserData", "u1"), ("PointSourceId", "<u2")]
_NEW = [*_CORE, ("returns", "u1"), ("flags", "u1"), ("Classification", "u1"), ("UserData", "u1"), ("ScanAngle", "<i2"), ("PointSourceId", "<u2"), ("GpsTime", "<f8")]
_TIME, _RGB = [("GpsTime", "<f8")], [("Red", "<u2"), ("Green", "<u2"), ("Blue", "<u2")]
POINT = {f: np.dtype(x) for f, x in {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: [*_NEW, *_RGB, ("Nir", "<u2")]}.items()}

#: numpy type of the base kinds 1 to 10 of an extra dimension; 11 to 20 are pairs, 21 to 30 triples of them
KINDS = ("u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")


class FormatError(ValueError):
    """The bytes are not what the format asks for."""


@dataclass(frozen=True)
class Header:
    version: tuple[int, int] = (1, 4)
    header_size: int = HEADER_BYTES
    point_offset: int = 0
    n_vlrs: int = 0
    point_format: int = 6
    compressed: bool = True
    record_length: int = 30
    point_count: int = 0
    by_return: tuple[int, ...] = (0,) * 15
    scale: tuple[float, ...] = (0.01,) * 3
    offset: tuple[float, ...] = (0.0,) * 3
    low: tuple[float, ...] = (0.0,) * 3
    high: tuple[float, ...] = (0.0,) * 3
    evlr_offset: int = 0
    n_evlrs: int = 0
    system: str = ""
    software: str = ""

    @classmethod
    def parse(cls, data: bytes) -> "Header":
        if data[:4] != b"LASF":
            raise FormatError("no LASF signature")
        if len(data) < 227:
            raise FormatError("the header is cut short")
        version = (data[24], data[25])
        size, points, n_vlrs, fmt, length, legacy = struct.unpack_from("<HIIBHI", data, 94)
        v = struct.unpack_from("<12d", data, 131)
        out = cls(version, size, points, n_vlrs, fmt & 127, bool(fmt & 128), length, legacy, (0,) * 15, v[0:3], v[3:6], v[7:12:2], v[6:12:2],
                  system=data[26:58].split(b"\0")[0].decode("ascii", "replace"), software=data[58:90].split(b"\0")[0].decode("ascii", "replace"))
        if version >= (1, 4):
            if len(data) < HEADER_BYTES:
                raise FormatError("the header is cut short")
            evlr, n_evlrs, count, *by_return = struct.unpack_from("<QIQ15Q", data, 235)
            out = replace(out, point_count=count, by_return=tuple(by_return), evlr_offset=evlr, n_evlrs=n_evlrs)
        return replace(out, low=tuple(v[7:12:2]), high=tuple(v[6:12:2]))

    def pack(self) -> bytes:
        extents = [x for hi, lo in zip(self.high, self.low) for x in (hi, lo)]
        text = lambda s: s.encode("ascii", "replace")[:32].ljust(32, b"\0")
        return b"".join((
            b"LASF", bytes(20), bytes(self.version), text(self.system), text(self.software), bytes(4),
            struct.pack("<HIIBHI", self.header_size, self.point_offset, self.n_vlrs, self.point_format | 128 * self.compressed, self.record_length, 0), bytes(20),
            struct.pack("<12d", *self.scale, *self.offset, *extents), bytes(8), struct.pack("<QIQ15Q", self.evlr_offset, self.n_evlrs, self.point_count, *self.by_return),
        ))


@dataclass(frozen=True)
class Vlr:
    user_id: str
    record_id: int
    data: bytes
    description: str = ""

    def pack(self) -> bytes:
        return struct.pack("<H16sHH32s", 0, self.user_id.encode("ascii"), self.record_id, len(self.data), self.description.encode("ascii")) + self.data


def parse_vlrs(data: bytes, n: int) -> list[Vlr]:
    """n records from the start of data."""
    out, at = [], 0
    for _ in range(n):
        if len(data) < at + 54:
            raise FormatError("a record is cut short")
        _, user, record, length, text = struct.unpack_from("<H16sHH32s", data, at)
        body = data[at + 54 : at + 54 + length]
        if len(body) < length:
            raise FormatError("a record is cut short")
        out.append(Vlr(user.split(b"\0")[0].decode("ascii", "replace"), record, body, text.split(b"\0")[0].decode("ascii", "replace")))
        at += 54 + length
    return out


#: Bytes of an extended record before its data, whose length is a 64-bit number.
EVLR_BYTES = 60


def evlr_head(data: bytes) -> tuple[Vlr, int]:
    """An extended record without its data, and how long that is."""
    if len(data) < EVLR_BYTES:
        raise FormatError("an extended record is cut short")
    _, user, record, length, text = struct.unpack_from("<H16sHQ32s", data)
    return Vlr(user.split(b"\0")[0].decode("ascii", "replace"), record, b"", text.split(b"\0")[0].decode("ascii", "replace")), length


def find_vlr(vlrs: list[Vlr], user_id: str, record_id: int) -> Vlr | None:
    return next((v for v in vlrs if (v.user_id, v.record_id) == (user_id, record_id)), None)


@dataclass(frozen=True)
class Info:
    center: tuple[float, ...]
    half: float
    spacing: float
    root_offset: int
    root_size: int
    gps: tuple[float, float] = (0.0, 0.0)

    @classmethod
    def parse(cls, data: bytes) -> "Info":
        if len(data) != INFO_BYTES:
            raise FormatError(f"the octree record has {len(data)} bytes, not {INFO_BYTES}")
        v = struct.unpack_from("<5d2Q2d", data)
        return cls(v[:3], v[3], v[4], v[5], v[6], v[7:9])

    def pack(self) -> bytes:
        return struct.pack("<5d2Q2d", *self.center, self.half, self.spacing, self.root_offset, self.root_size, *self.gps).ljust(INFO_BYTES, b"\0")


@dataclass(frozen=True)
class Dimension:
    """An attribute that a file adds to its points: 1 to 3 components of a base kind, scaled if the scale isn't 0."""

    kind: int
    name: str
    scale: tuple[float, ...] = (0.0,) * 3
    offset: tuple[float, ...] = (0.0,) * 3
    description: str = ""
    options: int = 0
    limits: tuple[tuple[float, ...], ...] = field(default=((0.0,) * 3,) * 3)  # no data, least, greatest

    def __post_init__(self) -> None:
        if not 0 <= self.kind <= 30:
            raise FormatError(f"unknown kind {self.kind} of dimension {self.name}")

    @property
    def components(self) -> int:
        return 1 + (self.kind - 1) // 10 if self.kind else 1

    @property
    def base(self) -> np.dtype | None:
        return np.dtype(KINDS[(self.kind - 1) % 10]) if self.kind else None

    @property
    def size(self) -> int:
        return self.base.itemsize * self.components if self.kind else 0

    @classmethod
    def parse(cls, data: bytes) -> "Dimension":
        kind, options = data[2], data[3]
        values = struct.unpack_from("<15d", data, 40)
        text = lambda b: b.split(b"\0")[0].decode("utf-8", "replace")
        return cls(kind, text(data[4:36]), values[9:12], values[12:15], text(data[160:192]), options, (values[0:3], values[3:6], values[6:9]))

    def pack(self) -> bytes:
        values = [x for v in (*self.limits, self.scale, self.offset) for x in v]
        text = lambda s: s.encode()[:32].ljust(32, b"\0")
        return struct.pack("<HBB", 0, self.kind, self.options) + text(self.name) + bytes(4) + struct.pack("<15d", *values) + text(self.description)

    def values(self, raw: np.ndarray, at: int) -> np.ndarray:
        """float32 (n, components) from the extra bytes (n, k) of n points; zeros where the bytes don't reach."""
        n = len(raw)
        if not self.kind or at + self.size > raw.shape[1]:
            return np.zeros((n, self.components), dtype=np.float32)
        v = np.ascontiguousarray(raw[:, at : at + self.size]).view(self.base).astype(np.float64)
        for k in range(self.components):
            if self.scale[k] != 0:
                v[:, k] = v[:, k] * self.scale[k] + self.offset[k]
        return v.astype(np.float32)


def parse_dimensions(data: bytes) -> list[Dimension]:
    """Whole records only; a record of an unknown kind is left out."""
    out = []
    for at in range(0, len(data) // DIM_BYTES * DIM_BYTES, DIM_BYTES):
        try:
            out.append(Dimension.parse(data[at : at + DIM_BYTES]))
        except FormatError:
            continue
    return out


@dataclass(frozen=True)
class Extents:
    """Least and greatest value of dimensions, by name."""

    values: dict[str, tuple[float, float]] = field(default_factory=dict)

    def put(self, name: str, low: float, high: float) -> "Extents":
        return Extents({**self.values, name: (low, high)})

    def get(self, name: str) -> tuple[bool, float, float]:
        """Whether the dimension is known, and its extent, 0 to 0 if not."""
        return (name in self.values, *self.values.get(name, (0.0, 0.0)))

    def __str__(self) -> str:
        return f"extents of {len(self.values)} dimensions"


def kind_of(entry: np.void | tuple) -> str:
    """"page" for an entry that stands for a further page, "node" for one with points, "empty" for one without."""
    n = int(entry["point_count"] if isinstance(entry, np.void) else entry[-1])
    return "page" if n < 0 else "node" if n else "empty"


def parse_page(data: bytes) -> np.ndarray:
    """Entries of a hierarchy page: nodes, and with point_count -1 further pages; of equal keys the last counts."""
    if len(data) % ENTRY.itemsize:
        raise FormatError(f"a page of {len(data)} bytes")
    e = np.frombuffer(data, dtype=ENTRY)
    if (e["point_count"] < -1).any():
        raise FormatError("a negative point count")
    last = {}
    for i, k in enumerate(zip(e["d"].tolist(), e["x"].tolist(), e["y"].tolist(), e["z"].tolist(), (e["point_count"] < 0).tolist())):
        last[k] = i
    return e[sorted(last.values())]


def pack_page(entries: list[tuple]) -> bytes:
    return np.array(entries, dtype=ENTRY).tobytes()
