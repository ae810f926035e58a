"""Octree addresses (d, x, y, z) as Column expressions; a key is a struct of four ints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
PARTS = ("d", *AXES)


@dataclass(frozen=True)
class Octree:
    """What a file's header says: the cube, its point spacing, and the extents of its points.

    Bounds of nodes take their origin from the cube and their span from the extents (bounds_mode "extents"), or both
    from the cube ("cube").
    """

    center: tuple[float, float, float]
    half: float
    spacing: float
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    bounds_mode: str = "extents"

    @property
    def side(self) -> float:
        return 2 * self.half if self.bounds_mode == "cube" else max(h - a for h, a in zip(self.high, self.low))

    @property
    def origin(self) -> tuple[float, ...]:
        return tuple(c - self.half for c in self.center)

    @property
    def cube(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.origin, tuple(c + self.half for c in self.center)


def key(d: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(PARTS, (d, x, y, z))])


def invalid() -> Column:
    return key(*[F.lit(-1)] * 4)


def root() -> Column:
    return key(*[F.lit(0)] * 4)


def is_valid(k: Column) -> Column:
    return F.least(*[k[p] for p in PARTS]) >= 0


def text(k: Column) -> Column:
    return F.concat_ws("-", *[k[p].cast("string") for p in PARTS])


def parse(s: Column) -> Column:
    """The key of "d-x-y-z"; an error unless there are four parts, all ints."""
    parts = F.split(s, "-")
    ok = F.assert_true(F.size(parts) == 4, F.concat(F.lit("not a voxel key: "), s))
    return F.when(ok.isNull(), key(*[parts[i].cast("int") for i in range(4)]))


def child(k: Column, direction: Column) -> Column:
    """The octant: bit 2 of the direction goes to x, bit 1 to y, bit 0 to z."""
    bit = lambda n: F.shiftright(direction, n).bitwiseAND(1)
    return key(k["d"] + 1, k["x"] * 2 + bit(2), k["y"] * 2 + bit(1), k["z"] * 2 + bit(0))


def children(k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: child(k, i))


def at_depth(k: Column, depth: Column) -> Column:
    """The ancestor of that depth (the key itself at its own), invalid beyond."""
    moved = [F.call_function("shiftright", k[p], F.greatest(k["d"] - depth, F.lit(0))) for p in AXES]
    return F.when((depth < 0) | (depth > k["d"]), invalid()).otherwise(key(depth, *moved))


def parent(k: Column) -> Column:
    return F.when(k["d"] <= 0, invalid()).otherwise(at_depth(k, k["d"] - 1))


def ancestors(k: Column, include_self: bool = False) -> Column:
    """From the parent (or the key) up to the root."""
    first = k["d"] if include_self else k["d"] - 1
    none = F.array().cast("array<struct<d:int,x:int,y:int,z:int>>")
    return F.when(first < 0, none).otherwise(F.transform(F.sequence(F.greatest(first, F.lit(0)), F.lit(0), F.lit(-1)), lambda depth: at_depth(k, depth)))


def is_under(k: Column, other: Column) -> Column:
    """Whether k lies strictly below other."""
    a = at_depth(k, other["d"])
    return (k["d"] > other["d"]) & (a["x"] == other["x"]) & (a["y"] == other["y"]) & (a["z"] == other["z"])


def span(d: Column, octree: Octree) -> Column:
    return F.lit(octree.side) / F.call_function("shiftleft", F.lit(1), d)


def resolution(d: Column, octree: Octree) -> Column:
    return F.lit(octree.spacing) / F.call_function("shiftleft", F.lit(1), d)


def bounds(k: Column, octree: Octree) -> dict[str, Column]:
    """min_x .. max_z."""
    s = span(k["d"], octree)
    low = {f"min_{a}": F.lit(float(o)) + k[a] * s for a, o in zip(AXES, octree.origin)}
    return low | {f"max_{a}": low[f"min_{a}"] + s for a in AXES}


def depth_at(wanted: float, octree: Octree) -> int:
    """The least depth whose resolution is at most the wanted one."""
    if wanted <= 0:
        raise ValueError("resolution must be positive")
    depth = 0
    while octree.spacing / (1 << depth) > wanted:
        depth += 1
    return depth
