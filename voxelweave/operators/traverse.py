"""Walking the tree with a verdict for each node: (keep in cache, show, go on to the children).

A node that doesn't go on stops all its descendants; a page of the hierarchy that doesn't, all that is in it, the node of
its own key included. When ancestors come before descendants, as in any
well-formed file, that is one anti join of the nodes against their stopped ancestors; with in_order, an ancestor
stops only what comes after it in the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import voxel
from ..functions.geometry import Vec, box_columns, distance, f32
from .select import Shape


@dataclass(frozen=True)
class Context:
    """What a verdict sees of a node."""

    depth: Column
    resolution: Column
    point_count: Column
    bounds: dict[str, Column]
    key: Column
    is_node: Column  # false for a page, whose point_count is -1

    @property
    def center(self) -> tuple[Column, ...]:
        return tuple((f32(self.bounds[f"min_{a}"]) + f32(self.bounds[f"max_{a}"])) * f32(0.5) for a in voxel.AXES)


Verdict = Callable[[Context], tuple[Column, Column, Column]]


def _context(point_count: Column, is_node: bool) -> Context:
    k = voxel.key(*[F.col(c) for c in OWN])
    return Context(F.col("d"), F.col("resolution"), point_count, box_columns(), k, F.lit(is_node))


OWN = ["d", "kx", "ky", "kz"]


def traverse(nodes: DataFrame, verdict: Verdict, in_order: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """The reached nodes with columns cached and viewed. pages: entries of further pages, judged apart, with the nodes' key, bounds and resolution."""
    here = _context(F.col("point_count"), True)
    cache, view, more = verdict(here)
    judged = nodes.withColumn("cached", cache).withColumn("viewed", view).withColumn("_more", more)
    seq = ["seq"] if in_order else []
    stops = judged.where(~F.col("_more")).select(*[F.col(c).alias(f"_s{c}") for c in OWN + seq])
    same = (F.col("a.d") == F.col("_sd")) & (F.col("a.x") == F.col("_skx")) & (F.col("a.y") == F.col("_sky")) & (F.col("a.z") == F.col("_skz"))
    above = lambda keys: judged.select(*OWN, *seq, F.explode(keys).alias("a"))
    hidden = above(voxel.ancestors(here.key)).join(stops, same & (F.col("_sseq") < F.col("seq")) if in_order else same, "left_semi").select(*OWN)
    if pages is not None:
        closed = pages.where(~verdict(_context(F.lit(-1), False))[2]).select(*[F.col(c).alias(f"_s{c}") for c in OWN])
        hidden = hidden.union(above(F.concat(F.array(here.key), voxel.ancestors(here.key))).join(closed, same, "left_semi").select(*OWN))
    return judged.join(hidden.distinct(), OWN, "left_anti").drop("_more")


def shape(s: Shape, resolution: float = 0, go_on: bool = True) -> Verdict:
    """Nodes that meet the shape and are fine enough; children of any that meet it."""
    def verdict(c: Context) -> tuple[Column, Column, Column]:
        hit = s.meets(c.bounds)
        ok = hit if resolution <= 0 else hit & (c.resolution <= F.lit(float(resolution)))
        return ok, ok, hit & F.lit(go_on)

    return verdict


def by_distance(s: Shape, eye: Vec, slope: float, finest: float, go_on: bool = True) -> Verdict:
    """A node in the shape is wanted if it is as fine as its distance from the eye asks for."""
    def verdict(c: Context) -> tuple[Column, Column, Column]:
        hit = s.meets(c.bounds)
        far = distance(tuple(p.cast("double") for p in c.center), eye)
        ok = hit & (c.resolution <= F.greatest(F.lit(float(finest)), F.lit(float(slope)) * far))
        return ok, ok, hit & F.lit(go_on)

    return verdict


def first_fine(s: Shape, resolution: float) -> Verdict:
    """Down each branch only the first node that is fine enough."""
    def verdict(c: Context) -> tuple[Column, Column, Column]:
        ok = s.meets(c.bounds) & (c.resolution <= F.lit(float(resolution)))
        return ok, ok, ~ok

    return verdict


def view_depth(s: Shape, eye: Vec, direction: Vec, slope: float, finest: float) -> Verdict:
    """As by_distance, by the depth along the view direction, at least 0."""
    def verdict(c: Context) -> tuple[Column, Column, Column]:
        hit = s.meets(c.bounds)
        to = [p.cast("double") - F.lit(float(e)) for p, e in zip(c.center, eye)]
        along = to[0] * F.lit(float(direction[0])) + to[1] * F.lit(float(direction[1])) + to[2] * F.lit(float(direction[2]))
        ok = hit & (c.resolution <= F.greatest(F.lit(float(finest)), F.lit(float(slope)) * F.greatest(F.lit(0.0), along)))
        return ok, ok, hit

    return verdict


def constant(cache: bool, view: bool, more: bool) -> Verdict:
    return lambda c: (F.lit(cache), F.lit(view), F.lit(more))


def to_depth(deepest: int, cache_all: bool = False) -> Verdict:
    """Nodes down to a depth; cache_all caches all of them and shows those."""
    def verdict(c: Context) -> tuple[Column, Column, Column]:
        near = c.depth <= deepest
        return (F.lit(True) if cache_all else near), near, (F.lit(True) if cache_all else c.depth < deepest)

    return verdict
