"""Boxes, spheres, planes and frusta: driver-side values whose tests are Column expressions.

Box-box, sphere-box and clip-frustum tests narrow to 32-bit floats first, as renderers do; containment stays in
doubles. All borders are closed, unless said otherwise. A box as Columns is the mapping min_x .. max_z.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .voxel import AXES

Vec = tuple[float, float, float]
BoxColumns = Mapping[str, Column]


def box_columns(prefix: str = "") -> dict[str, Column]:
    return {f"{m}_{a}": F.col(f"{prefix}{m}_{a}") for a in AXES for m in ("min", "max")}


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("float")


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def squared(p: tuple[Column, ...], q: Vec) -> Column:
    d = [a - F.lit(float(b)) for a, b in zip(p, q)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distance(p: tuple[Column, ...], q: Vec) -> Column:
    return F.sqrt(squared(p, q))


@dataclass(frozen=True)
class Box:
    low: Vec
    high: Vec

    @classmethod
    def around(cls, center: Vec, half: Vec) -> "Box":
        return cls(tuple(c - h for c, h in zip(center, half)), tuple(c + h for c, h in zip(center, half)))

    @property
    def center(self) -> Vec:
        return tuple((a + b) / 2 for a, b in zip(self.low, self.high))

    @property
    def size(self) -> Vec:
        return tuple(b - a for a, b in zip(self.low, self.high))

    def has_point(self, p: tuple[Column, ...]) -> Column:
        return every([c.between(F.lit(float(a)), F.lit(float(b))) for c, a, b in zip(p, self.low, self.high)])

    def has_box(self, b: BoxColumns) -> Column:
        return every([t for a, lo, hi in zip(AXES, self.low, self.high) for t in (b[f"min_{a}"] >= F.lit(float(lo)), b[f"max_{a}"] <= F.lit(float(hi)))])

    def inside(self, b: BoxColumns) -> Column:
        return every([t for a, lo, hi in zip(AXES, self.low, self.high) for t in (b[f"min_{a}"] <= F.lit(float(lo)), b[f"max_{a}"] >= F.lit(float(hi)))])

    def meets(self, b: BoxColumns) -> Column:
        return every([t for a, lo, hi in zip(AXES, self.low, self.high) for t in (f32(b[f"min_{a}"]) <= f32(hi), f32(b[f"max_{a}"]) >= f32(lo))])

    def crosses(self, b: BoxColumns) -> Column:
        return self.meets(b) & ~self.inside(b) & ~self.has_box(b)


@dataclass(frozen=True)
class Sphere:
    center: Vec
    radius: float

    def __post_init__(self) -> None:
        if self.radius < 0:
            raise ValueError("radius must not be negative")

    @property
    def box(self) -> Box:
        return Box.around(self.center, (self.radius,) * 3)

    def has_point(self, p: tuple[Column, ...]) -> Column:
        return squared(p, self.center) <= F.lit(float(self.radius) ** 2)

    def meets(self, b: BoxColumns) -> Column:
        """32-bit squared distance from the centre to the nearest place of the box."""
        d = [f32(c) - F.greatest(f32(b[f"min_{a}"]), F.least(f32(b[f"max_{a}"]), f32(c))) for a, c in zip(AXES, self.center)]
        r = float(np.float32(self.radius) * np.float32(self.radius))
        return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2] <= f32(r)

    def has_box(self, b: BoxColumns) -> Column:
        """By the farthest corner."""
        far = [F.greatest(F.abs(b[f"min_{a}"] - F.lit(float(c))), F.abs(b[f"max_{a}"] - F.lit(float(c)))) for a, c in zip(AXES, self.center)]
        return far[0] * far[0] + far[1] * far[1] + far[2] * far[2] <= F.lit(float(self.radius) ** 2)

    def inside(self, b: BoxColumns) -> Column:
        return self.box.inside(b)


@dataclass(frozen=True)
class Plane:
    """a x + b y + c z + d = 0; the positive side is where the normal points."""

    a: float
    b: float
    c: float
    d: float

    @classmethod
    def through(cls, normal: Vec, point: Vec) -> "Plane":
        return cls(*normal, -sum(n * p for n, p in zip(normal, point)))

    def normalized(self) -> "Plane":
        size = math.sqrt(self.a**2 + self.b**2 + self.c**2)
        return self if size < 1e-10 else Plane(*(v / size for v in (self.a, self.b, self.c, self.d)))

    def signed_distance(self, p: tuple[Column, ...]) -> Column:
        return F.lit(self.a) * p[0] + F.lit(self.b) * p[1] + F.lit(self.c) * p[2] + F.lit(self.d)

    def in_front(self, p: tuple[Column, ...]) -> Column:
        return self.signed_distance(p) > 0

    def meets(self, b: BoxColumns) -> Column:
        """Whether the corner farthest along the normal is in front or on it; which corner is known at plan time."""
        corner = tuple(b[f"max_{a}"] if n >= 0 else b[f"min_{a}"] for a, n in zip(AXES, (self.a, self.b, self.c)))
        return self.signed_distance(corner) >= 0


@dataclass(frozen=True)
class Frustum:
    planes: tuple[Plane, ...]

    @classmethod
    def from_rows(cls, vp: list[float], normalize: bool = True) -> "Frustum":
        """Planes from the rows of a row-major view-projection matrix (column vectors, depth -1 to 1)."""
        if len(vp) != 16:
            raise ValueError("a matrix has 16 values")
        r = np.asarray(vp, dtype=float).reshape(4, 4)
        planes = [Plane(*map(float, v)) for k in range(3) for v in (r[3] + r[k], r[3] - r[k])]
        return cls(tuple(p.normalized() if normalize else p for p in planes))

    @classmethod
    def from_view_and_projection(cls, view: list[float], projection: list[float], normalize: bool = True) -> "Frustum":
        return cls.from_rows((np.reshape(projection, (4, 4)) @ np.reshape(view, (4, 4))).ravel().tolist(), normalize)

    def meets(self, b: BoxColumns) -> Column:
        """Conservative: no plane has the whole box behind it."""
        return every([p.meets(b) for p in self.planes])

    def has_point(self, p: tuple[Column, ...]) -> Column:
        return every([q.signed_distance(p) >= 0 for q in self.planes])


@dataclass(frozen=True)
class ClipFrustum:
    """32-bit frustum from the columns of a matrix (row vectors, depth 0 to 1); a box that only touches is outside."""

    planes: tuple[tuple[float, float, float, float], ...]

    @classmethod
    def from_columns(cls, vp: list[float]) -> "ClipFrustum":
        if len(vp) != 16:
            raise ValueError("a matrix has 16 values")
        m = np.asarray(vp, dtype=np.float32).reshape(4, 4)
        c = [m[:, k] for k in range(4)]
        out = []
        for v in (c[3] + c[0], c[3] - c[0], c[3] - c[1], c[3] + c[1], c[2], c[3] - c[2]):
            size = np.float32(np.sqrt(np.float32((v[:3] * v[:3]).sum())))
            out.append(tuple(float(x) for x in (v / size if size > 1e-10 else v).astype(np.float32)))
        return cls(tuple(out))

    def meets(self, b: BoxColumns) -> Column:
        mid = [(f32(b[f"min_{a}"]) + f32(b[f"max_{a}"])) * f32(0.5) for a in AXES]
        ext = [f32(b[f"max_{a}"]) - m for a, m in zip(AXES, mid)]
        once = F.array(F.struct(*[c.alias(f"{n}{i}") for n, v in (("m", mid), ("e", ext)) for i, c in enumerate(v)]))

        def outside_of_none(v: Column) -> Column:
            tests = []
            for x, y, z, d in self.planes:
                near = v["m0"] * f32(x) + v["m1"] * f32(y) + v["m2"] * f32(z)
                far = v["e0"] * f32(abs(x)) + v["e1"] * f32(abs(y)) + v["e2"] * f32(abs(z))
                tests.append(near + far > f32(-d))
            return every(tests)

        # an array of one, so that centre and extent are worked out once for all six planes
        return F.get(F.transform(once, outside_of_none), 0)


def orthographic(box: Box) -> list[float]:
    """A row-vector matrix whose clip frustum is the box, seen along -z (right-handed, depth 0 to 1)."""
    (w, h, d), c = box.size, box.center
    eye = c[2] + d / 2
    view = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [-c[0], -c[1], -eye, 1]])
    projection = np.array([[2 / w, 0, 0, 0], [0, 2 / h, 0, 0], [0, 0, -1 / d, 0], [0, 0, 0, 1]])
    return (view @ projection).ravel().tolist()
