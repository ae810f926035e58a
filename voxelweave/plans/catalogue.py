"""The registered queries over the derived point tables, each with its DuckDB oracle where SQL expresses it."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import voxel
from ..functions.geometry import Box, ClipFrustum, Frustum, Plane, Sphere, box_columns, distance, orthographic
from ..operators import bits, cache, export, select, traverse
from ..operators import points as pts
from ..sources import catalog as attributes
from ..sources import derived
from ..sources.derived import KEY, OCTREE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BOX = Box((3000.0, 4000.0, 500.0), (9000.5, 12000.25, 9000.0))
SPHERE = Sphere((9000.0, 10000.0, 4000.0), 3000.0)
ROWS = [1 / 6000, 0, 0, -1.5, 0, 1 / 6000, 0, -1.6, 0, 0, 1 / 7000, -0.9, 0, 0, 1 / 40000, 0.75]
FRUSTUM = Frustum.from_rows(ROWS, normalize=False)
CLIP = ClipFrustum.from_columns(orthographic(BOX))
#: The same frusta for the oracles: sums and differences of the matrix' rows, and the faces of the box as 32-bit planes.
SQL_FRUSTUM = [tuple(ROWS[12 + k] + s * ROWS[4 * r + k] for k in range(4)) for r in range(3) for s in (1, -1)]
SQL_CLIP = [
    (1.0, 0.0, 0.0, -3000.0), (-1.0, 0.0, 0.0, 9000.4990234375), (0.0, -1.0, 0.0, 12000.25), (0.0, 1.0, 0.0, -4000.000244140625), (0.0, 0.0, -1.0, 9000.0), (0.0, 0.0, 1.0, -500.0004577636719),
]
EYE, VIEW = (9000.0, 2000.0, 6000.0), (0.0, 1.0, 0.0)
RINGS = ([500.0, 1500.0, 4000.0, 9000.0], [16.0, 32.0, 64.0, 128.0])
RADII = [500.0, 1000.0, 2500.0, 5000.0, 10000.0]
FINE = 32.0
AX = "xyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {derived.POINTS_SQL} {sql}"
        return f

    return add


def _points(s: SparkSession, d: str) -> DataFrame:
    return derived.points(s, d)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return derived.node_table(s, d)


def _key() -> Column:
    return voxel.key(*[F.col(c) for c in KEY])


# SQL of the shapes' tests --------------------------------------------------------------------------------------

def _d(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _f(v: float | str) -> str:
    return f"CAST({v} AS FLOAT)" if isinstance(v, str) else f"CAST({_d(v)} AS FLOAT)"


def _box_meets(b: Box) -> str:
    return " AND ".join(f"{_f(f'min_{a}')} <= {_f(h)} AND {_f(f'max_{a}')} >= {_f(lo)}" for a, lo, h in zip(AX, b.low, b.high))


def _box_holds(b: Box) -> str:
    return " AND ".join(f"min_{a} >= {_d(lo)} AND max_{a} <= {_d(h)}" for a, lo, h in zip(AX, b.low, b.high))


def _box_inside(b: Box) -> str:
    return " AND ".join(f"min_{a} <= {_d(lo)} AND max_{a} >= {_d(h)}" for a, lo, h in zip(AX, b.low, b.high))


def _box_point(b: Box) -> str:
    return " AND ".join(f"{a.upper()} BETWEEN {_d(lo)} AND {_d(h)}" for a, lo, h in zip(AX, b.low, b.high))


def _sphere_meets(s: Sphere) -> str:
    t = [f"({_f(c)} - greatest({_f(f'min_{a}')}, least({_f(f'max_{a}')}, {_f(c)})))" for a, c in zip(AX, s.center)]
    return f"({t[0]} * {t[0]} + {t[1]} * {t[1]}) + {t[2]} * {t[2]} <= {_f(s.radius * s.radius)}"


def _sphere_holds(s: Sphere) -> str:
    t = [f"greatest(abs(min_{a} - {_d(c)}), abs(max_{a} - {_d(c)}))" for a, c in zip(AX, s.center)]
    return f"{t[0]} * {t[0]} + {t[1]} * {t[1]} + {t[2]} * {t[2]} <= {_d(s.radius**2)}"


def _squared(c: tuple[float, ...]) -> str:
    t = [f"({a.upper()} - {_d(v)})" for a, v in zip(AX, c)]
    return f"({t[0]} * {t[0]} + {t[1]} * {t[1]} + {t[2]} * {t[2]})"


def _plane_at(p: tuple, x: str, y: str, z: str) -> str:
    return f"({_d(p[0])} * {x} + {_d(p[1])} * {y} + {_d(p[2])} * {z} + {_d(p[3])})"


def _planes_meet(planes: list[tuple]) -> str:
    return " AND ".join(_plane_at(p, *[f"{'max' if n >= 0 else 'min'}_{a}" for a, n in zip(AX, p)]) + " >= 0" for p in planes)


def _clip_meets(planes: list[tuple]) -> str:
    mid = [f"(({_f(f'min_{a}')} + {_f(f'max_{a}')}) * {_f(0.5)})" for a in AX]
    ext = [f"({_f(f'max_{a}')} - {m})" for a, m in zip(AX, mid)]
    return " AND ".join(f"({' + '.join(f'{m} * {_f(v)}' for m, v in zip(mid, p))}) + ({' + '.join(f'{e} * {_f(abs(v))}' for e, v in zip(ext, p))}) > {_f(-p[3])}" for p in planes)


NODE = ["d", "kx", "ky", "kz", "point_count"]
_NODE = "d, kx, ky, kz, point_count"


# addresses ------------------------------------------------------------------------------------------------------

@query("voxel_children", """, i AS (SELECT unnest(range(8)) AS i)
SELECT d, kx, ky, kz, i::INT AS direction, (d + 1) || '-' || (2 * kx + (i >> 2)) || '-' || (2 * ky + ((i >> 1) & 1)) || '-' || (2 * kz + (i & 1)) AS child FROM nodes, i""")
def voxel_children(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d).select(*KEY, F.posexplode(voxel.children(_key())).alias("direction", "c"))
    return n.select(*KEY, "direction", voxel.text(F.col("c")).alias("child"))


@query("voxel_ancestors", """, i AS (SELECT unnest(range(4)) AS i)
SELECT d || '-' || kx || '-' || ky || '-' || kz AS node, i || '-' || (kx >> (d - i)) || '-' || (ky >> (d - i)) || '-' || (kz >> (d - i)) AS ancestor FROM nodes, i WHERE i < d""")
def voxel_ancestors(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(voxel.text(_key()).alias("node"), F.explode(voxel.ancestors(_key())).alias("a")).select("node", voxel.text(F.col("a")).alias("ancestor"))


@query("voxel_parent_at_depth", """
SELECT d, kx, ky, kz, CASE WHEN d <= 0 THEN '-1--1--1--1' ELSE (d - 1) || '-' || (kx >> 1) || '-' || (ky >> 1) || '-' || (kz >> 1) END AS parent,
  CASE WHEN d < 1 THEN '-1--1--1--1' ELSE '1-' || (kx >> (d - 1)) || '-' || (ky >> (d - 1)) || '-' || (kz >> (d - 1)) END AS at_1, true AS valid FROM nodes""")
def voxel_parent_at_depth(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(*KEY, voxel.text(voxel.parent(_key())).alias("parent"), voxel.text(voxel.at_depth(_key(), F.lit(1))).alias("at_1"), voxel.is_valid(_key()).alias("valid"))


@query("child_of_join", """
SELECT a.d, a.kx, a.ky, a.kz, count(*) AS descendants, sum(b.point_count)::BIGINT AS points
FROM nodes a JOIN nodes b ON b.d > a.d AND b.kx >> (b.d - a.d) = a.kx AND b.ky >> (b.d - a.d) = a.ky AND b.kz >> (b.d - a.d) = a.kz GROUP BY a.d, a.kx, a.ky, a.kz""")
def child_of_join(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)
    up = n.select("point_count", F.explode(voxel.ancestors(_key())).alias("a")).groupBy("a.d", "a.x", "a.y", "a.z").agg(F.count("*").alias("descendants"), F.sum("point_count").alias("points")).toDF("ad", "ax", "ay", "az", "descendants", "points")
    on = (F.col("d") == F.col("ad")) & (F.col("kx") == F.col("ax")) & (F.col("ky") == F.col("ay")) & (F.col("kz") == F.col("az"))
    return n.select(*KEY).join(up, on).select(*KEY, "descendants", "points")


@query("key_format_parse", "SELECT d || '-' || kx || '-' || ky || '-' || kz AS key, d, kx AS x, ky AS y, kz AS z FROM nodes")
def key_format_parse(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(voxel.text(_key()).alias("key")).select("key", voxel.parse(F.col("key")).alias("k")).select("key", "k.*")


@query("voxel_bounds", "SELECT d, kx, ky, kz, min_x, min_y, min_z, max_x, max_y, max_z, resolution FROM nodes")
def voxel_bounds(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(*KEY, *box_columns(), "resolution")


# geometry -------------------------------------------------------------------------------------------------------

@query("box_relations", f"SELECT {_NODE}, {_box_meets(BOX)} AS meets, {_box_holds(BOX)} AS held, {_box_inside(BOX)} AS holds, ({_box_meets(BOX)}) AND NOT ({_box_holds(BOX)}) AND NOT ({_box_inside(BOX)}) AS crosses FROM nodes")
def box_relations(s: SparkSession, d: str) -> DataFrame:
    b = box_columns()
    return _nodes(s, d).select(*NODE, BOX.meets(b).alias("meets"), BOX.has_box(b).alias("held"), BOX.inside(b).alias("holds"), BOX.crosses(b).alias("crosses"))


@query("sphere_relations", f"SELECT {_NODE}, {_sphere_meets(SPHERE)} AS meets, {_sphere_holds(SPHERE)} AS held, {_box_inside(SPHERE.box)} AS holds, {_box_meets(SPHERE.box)} AS meets_aabb FROM nodes")
def sphere_relations(s: SparkSession, d: str) -> DataFrame:
    b = box_columns()
    return _nodes(s, d).select(*NODE, SPHERE.meets(b).alias("meets"), SPHERE.has_box(b).alias("held"), SPHERE.inside(b).alias("holds"), SPHERE.box.meets(b).alias("meets_aabb"))


PLANE = Plane.through((0.5, -0.25, 1.0), (9000.0, 9000.0, 3000.0))
SQL_PLANE = (0.5, -0.25, 1.0, -5250.0)


@query("plane_distance", f"SELECT point_id, {_plane_at(SQL_PLANE, 'X', 'Y', 'Z')} AS signed, {_plane_at(SQL_PLANE, 'X', 'Y', 'Z')} > 0 AS front FROM pts")
def plane_distance(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("point_id", PLANE.signed_distance(pts.xyz()).alias("signed"), PLANE.in_front(pts.xyz()).alias("front"))


@query("plane_box", f"SELECT {_NODE}, {_planes_meet([SQL_PLANE])} AS meets FROM nodes")
def plane_box(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(*NODE, PLANE.meets(box_columns()).alias("meets"))


# nodes ----------------------------------------------------------------------------------------------------------

def _node_query(name: str, where: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"SELECT {_NODE} FROM nodes WHERE {where}")(lambda s, d: f(_nodes(s, d)).select(*NODE))


_node_query("all_nodes", "true", lambda n: n)
_node_query("node_lookup", "d = 1 AND kx = 0 AND ky = 1 AND kz = 0", lambda n: select.node(n, 1, 0, 1, 0))
_node_query("nodes_at_layer", "d = 2", lambda n: select.layer(n, 2))
_node_query("nodes_within_box", _box_holds(BOX), lambda n: select.within(n, BOX))
_node_query("nodes_within_box_res", f"{_box_holds(BOX)} AND resolution <= 16", lambda n: select.within(n, BOX, 16.0))
_node_query("nodes_intersect_box", _box_meets(BOX), lambda n: select.meeting(n, BOX))
_node_query("nodes_intersect_box_res", f"{_box_meets(BOX)} AND resolution <= {_d(FINE)}", lambda n: select.meeting(n, BOX, FINE))
_node_query("nodes_intersect_box_cumulative", _box_meets(BOX), lambda n: select.meeting(n, BOX, FINE, cumulative=True))
_node_query("nodes_in_radius", _sphere_meets(SPHERE), lambda n: select.meeting(n, SPHERE))
_node_query("nodes_in_radius_res", f"{_sphere_meets(SPHERE)} AND resolution <= {_d(FINE)}", lambda n: select.meeting(n, SPHERE, FINE))
_node_query("nodes_in_frustum", _clip_meets(SQL_CLIP), lambda n: select.meeting(n, CLIP))
_node_query("nodes_in_frustum_planes", _planes_meet(SQL_FRUSTUM), lambda n: select.meeting(n, FRUSTUM))
_node_query("nodes_at_resolution", f"d = {voxel.depth_at(50.0, OCTREE)}", lambda n: select.at_resolution(n, 50.0, OCTREE))
_node_query("bbox_lod_nodes", f"d = 3 AND {_box_meets(BOX)}", lambda n: select.meeting(select.layer(n, 3), BOX))
_node_query("bbox_res_nodes", f"d = {voxel.depth_at(20.0, OCTREE)} AND {_box_meets(BOX)}", lambda n: select.meeting(select.at_resolution(n, 20.0, OCTREE), BOX))


@query("layer_bounds", "SELECT d, kx, ky, kz, min_x, min_y, min_z, max_x, max_y, max_z FROM nodes WHERE d = 2")
def layer_bounds(s: SparkSession, d: str) -> DataFrame:
    return select.layer(_nodes(s, d), 2).select(*KEY, *box_columns())


@query("depth_at_resolution", """, w AS (SELECT unnest([200.0, 128.0, 100.0, 32.0, 5.0, 0.1])::DOUBLE AS wanted), i AS (SELECT unnest(range(31)) AS i)
SELECT wanted, min(i)::INT AS depth FROM w, i WHERE CAST(128 AS DOUBLE) / (1 << i) <= wanted GROUP BY wanted""")
def depth_at_resolution(s: SparkSession, d: str) -> DataFrame:
    w = s.sql("SELECT explode(array(200D, 128D, 100D, 32D, 5D, 0.1D)) AS wanted")
    first = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: voxel.resolution(i, OCTREE) <= F.col("wanted"))
    return w.select("wanted", F.get(first, F.lit(0)).alias("depth"))


def random_box(seed: int, share: float = 0.1) -> Box:
    """A box of a share of the extent along each axis, wholly within it, at a place that the seed draws."""
    draw = random.Random(seed)
    size = [share * (h - lo) for lo, h in zip(OCTREE.low, OCTREE.high)]
    low = [lo + draw.random() * (h - lo - w) for lo, h, w in zip(OCTREE.low, OCTREE.high, size)]
    return Box(tuple(low), tuple(v + w for v, w in zip(low, size)))


@query("random_box_nodes", f"SELECT {_NODE} FROM nodes WHERE d = 3 AND {_box_meets(random_box(7))}")
def random_box_nodes(s: SparkSession, d: str) -> DataFrame:
    return select.meeting(select.layer(_nodes(s, d), 3), random_box(7)).select(*NODE)


# traversal ------------------------------------------------------------------------------------------------------

_MID = [f"(({_f(f'min_{a}')} + {_f(f'max_{a}')}) * {_f(0.5)})" for a in AX]
_FAR = "sqrt(" + " + ".join(f"({m}::DOUBLE - {_d(e)}) * ({m}::DOUBLE - {_d(e)})" for m, e in zip(_MID, EYE)) + ")"
_ALONG = " + ".join(f"({m}::DOUBLE - {_d(e)}) * {_d(v)}" for m, e, v in zip(_MID, EYE, VIEW))


def _walk(name: str, cached: str, viewed: str, more: str, verdict: traverse.Verdict, in_order: bool = False) -> None:
    sql = f""", v AS (SELECT *, {cached} AS cached, {viewed} AS viewed, {more} AS more FROM nodes)
SELECT d, kx, ky, kz, cached, viewed FROM v WHERE NOT EXISTS (
  SELECT 1 FROM v p WHERE NOT p.more AND p.d < v.d AND v.kx >> (v.d - p.d) = p.kx AND v.ky >> (v.d - p.d) = p.ky AND v.kz >> (v.d - p.d) = p.kz)"""

    def run(s: SparkSession, d: str) -> DataFrame:
        n = _nodes(s, d)
        return traverse.traverse(n, verdict, in_order).select(*KEY, "cached", "viewed")

    query(name, sql)(run)


_walk("traverse_all", "true", "true", "true", traverse.constant(True, True, True))
_walk("traverse_in_file_order", "true", "true", "d < 2", lambda c: (F.lit(True), F.lit(True), c.depth < 2), in_order=True)
_walk("traverse_stop_at_root", "true", "true", "false", traverse.constant(True, True, False))
_walk("traverse_cache_no_view", "true", "false", "true", traverse.constant(True, False, True))
_walk("traverse_none", "false", "false", "false", traverse.constant(False, False, False))
_walk("traverse_pass_through", "false", "false", "true", traverse.constant(False, False, True))
_walk("traverse_depth01", "d <= 1", "d <= 1", "d < 1", traverse.to_depth(1))
_walk("traverse_cache_all_view01", "true", "d <= 1", "true", traverse.to_depth(1, cache_all=True))
_walk("traverse_box", f"{_box_meets(BOX)} AND resolution <= 64", f"{_box_meets(BOX)} AND resolution <= 64", _box_meets(BOX), traverse.shape(BOX, 64.0))
_walk("traverse_box_stop", _box_meets(BOX), _box_meets(BOX), "false", traverse.shape(BOX, 0, go_on=False))
_walk("traverse_sphere", f"{_sphere_meets(SPHERE)} AND resolution <= 64", f"{_sphere_meets(SPHERE)} AND resolution <= 64", _sphere_meets(SPHERE), traverse.shape(SPHERE, 64.0))
_walk("traverse_frustum", _clip_meets(SQL_CLIP), _clip_meets(SQL_CLIP), _clip_meets(SQL_CLIP), traverse.shape(CLIP))
_ADAPT = f"{_box_meets(BOX)} AND resolution <= greatest(CAST(8 AS DOUBLE), {_d(1 / 256)} * {_FAR})"
_walk("traverse_adaptive", _ADAPT, _ADAPT, _box_meets(BOX), traverse.by_distance(BOX, EYE, 1 / 256, 8.0))
_FIRST = f"{_box_meets(BOX)} AND resolution <= 64"
_walk("traverse_nearest_fine", _FIRST, _FIRST, f"NOT ({_FIRST})", traverse.first_fine(BOX, 64.0))
_DEEP = f"{_box_meets(BOX)} AND resolution <= greatest(CAST(8 AS DOUBLE), {_d(1 / 128)} * greatest(CAST(0 AS DOUBLE), {_ALONG}))"
_walk("traverse_view_depth", _DEEP, _DEEP, _box_meets(BOX), traverse.view_depth(BOX, EYE, VIEW, 1 / 128, 8.0))


_PAGED = f"""v AS (SELECT *, d < 3 AS more FROM nodes), closed AS (SELECT * FROM nodes WHERE d = 1 AND NOT ({_box_meets(BOX)}))
SELECT d, kx, ky, kz, true AS cached, d = 3 AS viewed FROM v WHERE NOT EXISTS (
  SELECT 1 FROM v p WHERE NOT p.more AND p.d < v.d AND v.kx >> (v.d - p.d) = p.kx AND v.ky >> (v.d - p.d) = p.ky AND v.kz >> (v.d - p.d) = p.kz)
AND NOT EXISTS (SELECT 1 FROM closed p WHERE p.d <= v.d AND v.kx >> (v.d - p.d) = p.kx AND v.ky >> (v.d - p.d) = p.ky AND v.kz >> (v.d - p.d) = p.kz)"""


@query("traverse_pages", f", {_PAGED}")
def traverse_pages(s: SparkSession, d: str) -> DataFrame:
    """A hierarchy with a page for each node of depth 1: pages away from the box aren't opened."""
    n = _nodes(s, d)

    def verdict(c: traverse.Context) -> tuple[Column, Column, Column]:
        return F.lit(True), c.depth == 3, F.when(c.is_node, c.depth < 3).otherwise(BOX.meets(c.bounds))

    return traverse.traverse(n, verdict, pages=select.layer(n, 1)).select(*KEY, "cached", "viewed")


# points ---------------------------------------------------------------------------------------------------------

POINT = ["point_id", "X", "Y", "Z", "classification"]
_POINT = "point_id, X, Y, Z, classification"


def _semi(where: str) -> str:
    return f"(d, kx, ky, kz) IN (SELECT (d, kx, ky, kz) FROM nodes WHERE {where})"


def _point_query(name: str, where: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return f(_points(s, d), _nodes(s, d)).select(*POINT)

    query(name, f"SELECT {_POINT} FROM pts WHERE {where}")(run)


_point_query("points_of_nodes", _semi("d = 2"), lambda p, n: pts.of_nodes(p, select.layer(n, 2)))
_point_query("points_in_box", f"{_box_point(BOX)}", lambda p, n: pts.in_shape(p, n, BOX))
_point_query("points_in_radius", f"{_squared(SPHERE.center)} <= {_d(SPHERE.radius**2)}", lambda p, n: pts.in_shape(p, n, SPHERE))
_point_query("points_in_frustum", " AND ".join(_plane_at(q, "X", "Y", "Z") + " >= 0" for q in SQL_FRUSTUM), lambda p, n: pts.in_shape(p, n, FRUSTUM))
_point_query("points_node_granular", _semi(_box_meets(BOX)), lambda p, n: pts.in_shape(p, n, BOX, granularity="node"))
_point_query("points_radius_node_granular", _semi(_sphere_meets(SPHERE)), lambda p, n: pts.in_shape(p, n, SPHERE, granularity="node"))
_point_query("points_frustum_node_granular", _semi(_clip_meets(SQL_CLIP)), lambda p, n: pts.of_nodes(p, select.meeting(n, CLIP)))
_point_query("bbox_lod_points", f"d = 3 AND {_box_point(BOX)}", lambda p, n: pts.of_nodes(p, select.meeting(select.layer(n, 3), BOX)).where(BOX.has_point(pts.xyz())))


@query("radius_with_distance", f"SELECT point_id, sqrt({_squared(SPHERE.center)}) AS distance FROM pts WHERE sqrt({_squared(SPHERE.center)}) <= {_d(SPHERE.radius)}")
def radius_with_distance(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    near = pts.of_nodes(p, select.meeting(_nodes(s, d), SPHERE)).withColumn("distance", distance(pts.xyz(), SPHERE.center))
    return near.where(F.col("distance") <= SPHERE.radius).select("point_id", "distance")


@query("frustum_theta_points", f"""SELECT p.point_id, n.d, n.kx, n.ky, n.kz FROM pts p JOIN (SELECT * FROM nodes WHERE {_clip_meets(SQL_CLIP)}) n
ON p.X BETWEEN n.min_x AND n.max_x AND p.Y BETWEEN n.min_y AND n.max_y AND p.Z BETWEEN n.min_z AND n.max_z""")
def frustum_theta_points(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    hit = pts.in_nodes_bounds(p, select.meeting(_nodes(s, d), CLIP), 16)
    return hit.select("point_id", F.col("n_d").alias("d"), *[F.col(f"n_k{a}").alias(f"k{a}") for a in AX])


@query("knn", f"SELECT point_id, sqrt({_squared(SPHERE.center)}) AS distance FROM pts WHERE {_squared(SPHERE.center)} <= {_d(SPHERE.radius**2)} ORDER BY distance, point_id LIMIT 25")
def knn(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return pts.nearest(p, _nodes(s, d), SPHERE.center, 25, SPHERE.radius).select("point_id", "distance")


def _rings(radii: list[float], resolutions: list[float]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS ring, {_d(r)} AS radius, point_count FROM nodes WHERE {_sphere_meets(Sphere(SPHERE.center, r))}" + (f" AND resolution <= {_d(x)}" if x else "") for i, (r, x) in enumerate(zip(radii, resolutions)))


_PER = "SELECT ring, radius, count(*) AS node_count, sum(point_count)::BIGINT AS points FROM r GROUP BY ring, radius"


@query("lod_rings", f", r AS ({_rings(*RINGS)}) {_PER}")
def lod_rings(s: SparkSession, d: str) -> DataFrame:
    return pts.per_sphere(_nodes(s, d), SPHERE.center, *RINGS)


@query("progressive_stages", f", r AS ({_rings(RINGS[0], RINGS[1])}), q AS ({_PER}) SELECT *, sum(points) OVER (ORDER BY ring)::BIGINT AS loaded FROM q")
def progressive_stages(s: SparkSession, d: str) -> DataFrame:
    """Stages by distance; the few of them, not the points, are added up in order."""
    return pts.per_sphere(_nodes(s, d), SPHERE.center, *RINGS).withColumn("loaded", F.sum("points").over(Window.orderBy("ring")))


@query("multi_resolution", f", w AS (SELECT unnest([128.0, 64.0, 16.0])::DOUBLE AS wanted) SELECT wanted, count(*) AS node_count, sum(point_count)::BIGINT AS points FROM nodes, w WHERE {_sphere_meets(SPHERE)} AND resolution <= wanted GROUP BY wanted")
def multi_resolution(s: SparkSession, d: str) -> DataFrame:
    n = select.meeting(_nodes(s, d), SPHERE).select("point_count", "resolution", F.explode(F.array(*map(F.lit, (128.0, 64.0, 16.0)))).alias("wanted"))
    return n.where("resolution <= wanted").groupBy("wanted").agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))


@query("density_by_radius", f", r AS ({_rings(RADII, [0.0] * 5)}), q AS ({_PER}) SELECT *, points / ({_d(4.0 / 3.0 * 3.141592653589793)} * radius * radius * radius) AS density FROM q")
def density_by_radius(s: SparkSession, d: str) -> DataFrame:
    return pts.densities(_nodes(s, d), SPHERE.center, RADII)


@query("sphere_relation_class", f"""SELECT CASE WHEN {_sphere_holds(SPHERE)} THEN 'inside' WHEN {_sphere_meets(SPHERE)} THEN 'partial' ELSE 'outside' END AS relation, count(*) AS node_count,
  sum(point_count)::BIGINT AS points FROM nodes GROUP BY 1""")
def sphere_relation_class(s: SparkSession, d: str) -> DataFrame:
    b = box_columns()
    n = _nodes(s, d).withColumn("relation", F.when(SPHERE.has_box(b), "inside").when(SPHERE.meets(b), "partial").otherwise("outside"))
    return n.groupBy("relation").agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))


@query("box_vs_radius", f"""SELECT count(*) FILTER (b) AS box_nodes, count(*) FILTER (r) AS sphere_nodes, sum(CASE WHEN b THEN point_count ELSE 0 END)::BIGINT AS box_points,
  sum(CASE WHEN r THEN point_count ELSE 0 END)::BIGINT AS sphere_points, count(*) FILTER (b AND NOT r) AS extra_nodes,
  sum(CASE WHEN b THEN point_count ELSE 0 END)::BIGINT - sum(CASE WHEN r THEN point_count ELSE 0 END)::BIGINT AS extra_points, CAST(100 AS DOUBLE) * count(*) FILTER (r) / nullif(count(*) FILTER (b), 0) AS efficiency FROM (SELECT *, {_box_meets(SPHERE.box)} AS b, {_sphere_meets(SPHERE)} AS r FROM nodes)""")
def box_vs_radius(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d).withColumn("b", SPHERE.box.meets(box_columns())).withColumn("r", SPHERE.meets(box_columns()))
    zero = F.lit(0)
    return n.agg(F.count_if("b").alias("box_nodes"), F.count_if("r").alias("sphere_nodes"), F.sum(F.when(F.col("b"), F.col("point_count")).otherwise(zero)).alias("box_points"), F.sum(F.when(F.col("r"), F.col("point_count")).otherwise(zero)).alias("sphere_points"), F.count_if(F.col("b") & ~F.col("r")).alias("extra_nodes")).withColumn(
        "extra_points", F.col("box_points") - F.col("sphere_points")).withColumn("efficiency", F.lit(100.0) * F.col("sphere_nodes") / F.expr("nullif(box_nodes, 0)"))


# sums -----------------------------------------------------------------------------------------------------------

_LEVEL = "SELECT d, count(*) AS node_count, sum(point_count)::BIGINT AS points, avg(point_count::DOUBLE) AS avg_points, max(resolution) AS resolution FROM"


@query("node_totals", f"SELECT count(*) AS node_count, sum(point_count)::BIGINT AS points FROM nodes WHERE {_box_meets(BOX)}")
def node_totals(s: SparkSession, d: str) -> DataFrame:
    return select.meeting(_nodes(s, d), BOX).agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))


@query("lod_distribution", f"{_LEVEL} nodes GROUP BY d")
def lod_distribution(s: SparkSession, d: str) -> DataFrame:
    return pts.by_level(_nodes(s, d))


@query("bbox_info_by_lod", f"""SELECT d, count(*) AS node_count, sum(point_count)::BIGINT AS points, sum(point_count)::DOUBLE / count(*) AS avg_points, CASE WHEN d IS NOT NULL THEN max(resolution) END AS resolution,
  count(DISTINCT d) AS levels FROM nodes WHERE {_box_meets(BOX)} GROUP BY ROLLUP (d)""")
def bbox_info_by_lod(s: SparkSession, d: str) -> DataFrame:
    """Levels, and with d null the grand total."""
    found = select.meeting(_nodes(s, d), BOX).withColumn("level", F.col("d")).rollup("d").agg(
        F.count("*").alias("node_count"), F.sum("point_count").alias("points"), (F.sum("point_count") / F.count("*")).alias("avg_points"), F.max("resolution").alias("resolution"), F.countDistinct("level").alias("levels"))
    return found.withColumn("resolution", F.when(F.col("d").isNotNull(), F.col("resolution")))


def _info_query(name: str, meets: str, shape: select.Shape) -> None:
    """By level, and with d null in all: the nodes that a shape meets, their points, and the share of the level's nodes."""
    def run(s: SparkSession, d: str) -> DataFrame:
        n = _nodes(s, d).withColumn("hit", shape.meets(box_columns()))
        sums = n.rollup("d").agg(F.count_if("hit").alias("node_count"), F.sum(F.when(F.col("hit"), F.col("point_count")).otherwise(F.lit(0))).alias("points"), (F.lit(100.0) * F.count_if("hit") / F.count("*")).alias("percent"))
        return sums.where("node_count > 0")

    query(name, f"""SELECT * FROM (SELECT d, count(*) FILTER (hit) AS node_count, sum(CASE WHEN hit THEN point_count ELSE 0 END)::BIGINT AS points, CAST(100 AS DOUBLE) * count(*) FILTER (hit) / count(*) AS percent
      FROM (SELECT *, {meets} AS hit FROM nodes) GROUP BY ROLLUP (d)) WHERE node_count > 0""")(run)


_info_query("frustum_info_by_lod", _clip_meets(SQL_CLIP), CLIP)
_info_query("radius_info_by_lod", _sphere_meets(SPHERE), SPHERE)


@query("bbox_info_samples", f"""SELECT {_NODE}, rank FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY seq) AS rank, dense_rank() OVER (ORDER BY d) AS level FROM nodes WHERE {_box_meets(BOX)}) WHERE rank <= 5 AND level <= 3""")
def bbox_info_samples(s: SparkSession, d: str) -> DataFrame:
    """Of the three coarsest levels that the box meets, the first five nodes in file order."""
    n = select.meeting(_nodes(s, d), BOX)
    levels = n.select("d").distinct().orderBy("d").limit(3)
    first = n.join(F.broadcast(levels), "d", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy("seq"))).where("rank <= 5")
    return first.select(*NODE, F.col("rank").cast("long").alias("rank"))


@query("layer_stats", """SELECT d, count(*) AS node_count, (CAST(8 AS DOUBLE) ** d)::BIGINT AS possible, avg(max_x - min_x) AS avg_width, avg(max_y - min_y) AS avg_height, avg(max_z - min_z) AS avg_depth,
  sum(point_count)::BIGINT AS points, avg(point_count::DOUBLE) AS avg_points, count(*) * CAST(100 AS DOUBLE) / (CAST(8 AS DOUBLE) ** d)::BIGINT AS fill_percent FROM nodes GROUP BY d""")
def layer_stats(s: SparkSession, d: str) -> DataFrame:
    return pts.layer_stats(_nodes(s, d))


@query("layer_compare", ", l AS (SELECT unnest([0, 2, 3, 7]) AS layer) SELECT layer, count(d) AS node_count, coalesce(sum(point_count), 0)::BIGINT AS points FROM l LEFT JOIN nodes ON d = layer GROUP BY layer")
def layer_compare(s: SparkSession, d: str) -> DataFrame:
    return pts.compare_layers(_nodes(s, d), [0, 2, 3, 7])


_STATS = "count(*) AS n, min(X) AS min_x, max(X) AS max_x, min(Y) AS min_y, max(Y) AS max_y, min(Z) AS min_z, max(Z) AS max_z, sum(intensity)::DOUBLE / count(*) AS avg_intensity"


@query("point_stats", f"SELECT {_STATS} FROM pts WHERE {_box_point(BOX)}")
def point_stats(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return pts.point_stats(pts.in_shape(p, _nodes(s, d), BOX))


@query("class_top5", "SELECT classification, count(*) AS n, CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS percent FROM pts GROUP BY classification ORDER BY n DESC, classification LIMIT 5")
def class_top5(s: SparkSession, d: str) -> DataFrame:
    return pts.top_classes(_points(s, d))


@query("centroid", """SELECT sum(raw_x)::DOUBLE / count(*) AS cx, sum(raw_y)::DOUBLE / count(*) AS cy, sum(raw_z)::DOUBLE / count(*) AS cz, min(intensity) AS min_intensity, max(intensity) AS max_intensity,
  (count(*) * 30)::DOUBLE / sum(raw_r + 1) AS ratio FROM pts WHERE d <= 1""")
def centroid(s: SparkSession, d: str) -> DataFrame:
    """Means of the raw coordinates, and record bytes over what stands for the compressed bytes."""
    p = _points(s, d).where("d <= 1")
    return p.agg(*[(F.sum(f"raw_{a}") / F.count("*")).alias(f"c{a}") for a in AX], F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"), ((F.count("*") * 30) / F.sum(F.col("raw_r") + 1)).alias("ratio"))


@query("normal_length", "SELECT round(avg(sqrt(x * x + y * y + z * z)), 6) AS avg_length FROM (SELECT raw_r::DOUBLE / 128 - 1 AS x, raw_g::DOUBLE / 128 - 1 AS y, raw_b::DOUBLE / 128 - 1 AS z FROM pts WHERE d = 3)")
def normal_length(s: SparkSession, d: str) -> DataFrame:
    n = [F.col(f"raw_{c}").cast("double") / 128 - 1 for c in "rgb"]
    return _points(s, d).where("d = 3").agg(F.round(F.avg(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])), 6).alias("avg_length"))


@query("node_page", f"SELECT {_NODE}, seq FROM nodes ORDER BY seq LIMIT 10 OFFSET 5")
def node_page(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).orderBy("seq").offset(5).limit(10).select(*NODE, F.col("seq").cast("long").alias("seq"))


@query("first_root_node", f"SELECT {_NODE} FROM nodes WHERE d = 0 ORDER BY kx, ky, kz LIMIT 1")
def first_root_node(s: SparkSession, d: str) -> DataFrame:
    return select.layer(_nodes(s, d), 0).orderBy(*KEY).limit(1).select(*NODE)


@query("shuffle_sample", f"SELECT {_NODE} FROM nodes ORDER BY ((d::BIGINT * 73856093 + kx * 19349663 + ky * 83492791 + kz * 49979687 + 12345) % 1000003 * 7919::BIGINT) % 1000003, d, kx, ky, kz LIMIT 200")
def shuffle_sample(s: SparkSession, d: str) -> DataFrame:
    """200 nodes in an order that a seed and a hash fix."""
    seed = 12345
    mixed = F.expr(f"((cast(d AS bigint) * 73856093L + kx * 19349663L + ky * 83492791L + kz * 49979687L + {seed}) % 1000003L * 7919L) % 1000003L")
    return _nodes(s, d).orderBy(mixed, *KEY).limit(200).select(*NODE)


@query("node_offsets", "SELECT d, kx, ky, kz, (sum(point_count) OVER (ORDER BY seq) - point_count)::BIGINT AS first FROM nodes")
def node_offsets(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).select(*KEY, "first")


@query("set_difference_union", f"SELECT {_NODE}, 'old' AS part FROM nodes WHERE {_box_meets(BOX)} UNION ALL (SELECT {_NODE}, 'new' FROM (SELECT {_NODE} FROM nodes WHERE {_sphere_meets(SPHERE)} EXCEPT SELECT {_NODE} FROM nodes WHERE {_box_meets(BOX)}))")
def set_difference_union(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)
    old, new = select.meeting(n, BOX).select(*NODE), select.meeting(n, SPHERE).select(*NODE)
    return old.withColumn("part", F.lit("old")).unionByName(new.subtract(old).withColumn("part", F.lit("new")))


# attributes and export ------------------------------------------------------------------------------------------

_BY = "CASE WHEN top <= 255 THEN 255 WHEN top <= 4095 THEN 4095 ELSE 65535 END"
_COLOR = f""", c AS (SELECT *, max(CASE WHEN ord < 64 THEN greatest(raw_r, raw_g, raw_b) END) OVER (PARTITION BY d, kx, ky, kz) AS top FROM op),
col AS (SELECT *, {_BY} AS divisor, (raw_r::FLOAT / ({_BY})::FLOAT)::FLOAT AS red, (raw_g::FLOAT / ({_BY})::FLOAT)::FLOAT AS green, (raw_b::FLOAT / ({_BY})::FLOAT)::FLOAT AS blue FROM c)"""


def _colored(s: SparkSession, d: str) -> DataFrame:
    return pts.colors(_points(s, d))


@query("color_normalise", f"{_COLOR} SELECT point_id, divisor, red::DOUBLE AS red, green::DOUBLE AS green, blue::DOUBLE AS blue FROM col")
def color_normalise(s: SparkSession, d: str) -> DataFrame:
    return _colored(s, d).select("point_id", "divisor", *[F.col(c).cast("double").alias(c) for c in ("red", "green", "blue")])


@query("scale_offset", "SELECT point_id, raw_x * CAST(0.25 AS DOUBLE) + CAST(1000 AS DOUBLE) AS x, raw_y * CAST(0.25 AS DOUBLE) + CAST(2000 AS DOUBLE) AS y, raw_z * CAST(0.25 AS DOUBLE) AS z FROM pts")
def scale_offset(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("point_id", *[(F.col(f"raw_{a}") * F.lit(0.25) + F.lit(o)).alias(a) for a, o in zip(AX, (1000.0, 2000.0, 0.0))])


@query("bitfields10", "SELECT point_id, v & 7 AS return_number, (v >> 3) & 7 AS number_of_returns, (v >> 6) & 1 AS scan_direction, (v >> 7) & 1 AS edge_of_flight, v AS packed FROM (SELECT point_id, (raw_x & 255)::INT AS v FROM pts)")
def bitfields10(s: SparkSession, d: str) -> DataFrame:
    u = bits.unpack_legacy(F.col("raw_x").bitwiseAND(255))
    p = _points(s, d).select("point_id", *[c.alias(n) for n, c in u.items()])
    return p.withColumn("packed", bits.pack_legacy(*[F.col(n) for n in u]))


@query("bitfields14", """SELECT point_id, r & 15 AS return_number, (r >> 4) & 15 AS number_of_returns, f & 15 AS class_flags, (f >> 4) & 3 AS scanner_channel, (f >> 6) & 1 AS scan_direction, (f >> 7) & 1 AS edge_of_flight
FROM (SELECT point_id, (raw_x & 255)::INT AS r, (raw_y & 255)::INT AS f FROM pts)""")
def bitfields14(s: SparkSession, d: str) -> DataFrame:
    u = bits.unpack_extended(F.col("raw_x").bitwiseAND(255), F.col("raw_y").bitwiseAND(255))
    return _points(s, d).select("point_id", *[c.alias(n) for n, c in u.items()])


@query("export_separated", f"""{_COLOR} SELECT point_id, X::FLOAT::DOUBLE AS px, Y::FLOAT::DOUBLE AS py, Z::FLOAT::DOUBLE AS pz, CAST(1 AS DOUBLE) AS pw, red::DOUBLE AS cr, green::DOUBLE AS cg, blue::DOUBLE AS cb, CAST(1 AS DOUBLE) AS ca, d AS depth,
  coalesce(extra_k::FLOAT, 0)::DOUBLE AS k FROM col""")
def export_separated(s: SparkSession, d: str) -> DataFrame:
    out = export.separated(_colored(s, d), {"k": F.col("extra_k"), "unused": F.col("raw_r")}, ["k"])
    return out.select("point_id", *[F.col(c).cast("double").alias(c) for c in out.columns if c not in ("point_id", "depth")], "depth")


@query("export_with_normals", f"{_COLOR} SELECT point_id, raw_r::FLOAT::DOUBLE AS nx, raw_g::FLOAT::DOUBLE AS ny, raw_b::FLOAT::DOUBLE AS nz FROM col")
def export_with_normals(s: SparkSession, d: str) -> DataFrame:
    extras = {"NormalX": F.col("raw_r"), "ny": F.col("raw_g"), "Normal Z": F.col("raw_b")}
    out = export.separated(_colored(s, d), extras, ["NormalX"])
    return out.select("point_id", *[F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz")])


@query("export_rows")
def export_rows(s: SparkSession, d: str) -> DataFrame:
    return export.rows(_colored(s, d), {"k": F.col("extra_k"), "rgb": F.array("raw_r", "raw_g", "raw_b")})


@query("export_rows_unnested", f"""{_COLOR} SELECT point_id, X::FLOAT::DOUBLE AS px, Y::FLOAT::DOUBLE AS py, Z::FLOAT::DOUBLE AS pz, CAST(1 AS DOUBLE) AS pw, red::DOUBLE AS cr, CAST(1 AS DOUBLE) AS ca, d AS depth, extra_k::DOUBLE AS k, raw_b::DOUBLE AS rgb_2, 2 AS names FROM col""")
def export_rows_unnested(s: SparkSession, d: str) -> DataFrame:
    """export_rows with its arrays and map taken apart."""
    r = export_rows(s, d)
    at = lambda c, i: F.get(F.col(c), i).cast("double")
    extra = lambda name, i: F.get(F.col("extra")[name], i).cast("double")
    return r.select("point_id", at("position", 0).alias("px"), at("position", 1).alias("py"), at("position", 2).alias("pz"), at("position", 3).alias("pw"), at("color", 0).alias("cr"), at("color", 3).alias("ca"), "depth",
                    extra("k", 0).alias("k"), extra("rgb", 2).alias("rgb_2"), F.size("extra").alias("names"))


@query("dims_distinct", "SELECT 'k' AS name, 1 AS components UNION ALL SELECT 'rgb', 3")
def dims_distinct(s: SparkSession, d: str) -> DataFrame:
    return export.dim_names(export_rows(s, d))


def _export_query(name: str, where: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Columns of the points that a shape chooses, as a renderer takes them."""
    def run(s: SparkSession, d: str) -> DataFrame:
        out = export.separated(f(_colored(s, d), _nodes(s, d)), {"k": F.col("extra_k")}, ["k"])
        return out.select("point_id", *[F.col(c).cast("double").alias(c) for c in ("px", "py", "pz", "cr", "cg", "cb", "k")], "depth")

    query(name, f"""{_COLOR} SELECT point_id, X::FLOAT::DOUBLE AS px, Y::FLOAT::DOUBLE AS py, Z::FLOAT::DOUBLE AS pz, red::DOUBLE AS cr, green::DOUBLE AS cg, blue::DOUBLE AS cb, d AS depth,
      coalesce(extra_k::FLOAT, 0)::DOUBLE AS k FROM col WHERE {where}""")(run)


_export_query("export_in_box", _semi(_box_meets(BOX)), lambda p, n: pts.in_shape(p, n, BOX, granularity="node"))
_export_query("export_in_radius", _semi(_sphere_meets(SPHERE)), lambda p, n: pts.in_shape(p, n, SPHERE, granularity="node"))
_export_query("export_in_frustum", _semi(_clip_meets(SQL_CLIP)), lambda p, n: pts.of_nodes(p, select.meeting(n, CLIP)))
_export_query("export_node_set", _semi("d = 2 AND kx = 1"), lambda p, n: pts.of_nodes(p, select.layer(n, 2).where("kx = 1")))
_export_query("warm_separated", _semi(f"{_sphere_meets(SPHERE)} AND NOT ({_box_meets(BOX)})"), lambda p, n: pts.of_nodes(p, select.meeting(n, SPHERE).join(select.meeting(n, BOX).select(*KEY), KEY, "left_anti")))


@query("separated_sizes", f"SELECT d, kx, ky, kz, 2 * (24 + 16 * point_count) + 2 * (24 + 4 * point_count) AS bytes FROM nodes WHERE {_box_meets(BOX)}")
def separated_sizes(s: SparkSession, d: str) -> DataFrame:
    """What a cache counts for the columns of each node: positions and colours, depth and one extra dimension."""
    return select.meeting(_nodes(s, d), BOX).select(*KEY, cache.separated_bytes(F.col("point_count"), 2, 2).alias("bytes"))


@query("export_node_order", "SELECT p.point_id, n.seq FROM op p JOIN nodes n USING (d, kx, ky, kz) WHERE d = 2")
def export_node_order(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return export.export_order(derived.with_ord(p), select.layer(_nodes(s, d), 2)).select("point_id", F.col("seq").cast("long").alias("seq"))


@query("export_sizes", "SELECT count(*) AS n, count(*) * 64 AS memory_bytes FROM pts")
def export_sizes(s: SparkSession, d: str) -> DataFrame:
    return export.sizes(_points(s, d))


# every name typed anew: which formats have it, type, least, greatest
_ATTRIBUTES = """, a AS (SELECT * FROM (VALUES
  ('X', [0,1,2,3,4,5,6,7,8,9,10], 'double', NULL, NULL, 'easting, scaled'), ('Y', [0,1,2,3,4,5,6,7,8,9,10], 'double', NULL, NULL, 'northing, scaled'), ('Z', [0,1,2,3,4,5,6,7,8,9,10], 'double', NULL, NULL, 'height, scaled'),
  ('Intensity', [0,1,2,3,4,5,6,7,8,9,10], 'uint16', 0, 65535, 'strength of the return'), ('ReturnNumber', [0,1,2,3,4,5,6,7,8,9,10], 'uint8', 1, 15, 'which return of its pulse'),
  ('NumberOfReturns', [0,1,2,3,4,5,6,7,8,9,10], 'uint8', 1, 15, 'returns of its pulse'), ('Classification', [0,1,2,3,4,5,6,7,8,9,10], 'uint8', 0, 255, 'class of the point'),
  ('ScanAngle', [0,1,2,3,4,5,6,7,8,9,10], 'float32', -180, 180, 'angle of the scan, degrees'), ('UserData', [0,1,2,3,4,5,6,7,8,9,10], 'uint8', 0, 255, 'free for the user'),
  ('PointSourceId', [0,1,2,3,4,5,6,7,8,9,10], 'uint16', 0, 65535, 'flight line or file'), ('GpsTime', [1,3,6,7,8], 'double', NULL, NULL, 'time of the pulse'),
  ('Red', [2,3,7,8], 'uint16', 0, 65535, 'red of the colour'), ('Green', [2,3,7,8], 'uint16', 0, 65535, 'green of the colour'), ('Blue', [2,3,7,8], 'uint16', 0, 65535, 'blue of the colour'), ('NIR', [8], 'uint16', 0, 65535, 'near infrared'),
  ('ScanDirectionFlag', [6,7,8], 'uint8', 0, 1, 'direction of the mirror'), ('EdgeOfFlightLine', [6,7,8], 'uint8', 0, 1, 'last point of a scan line')) AS v(name, formats, kind, least, greatest, description)
), t AS (SELECT unnest(formats)::INT AS point_format, name, kind, 1 AS components, least::DOUBLE AS least, greatest::DOUBLE AS greatest, true AS required, description FROM a)"""


@query("attribute_lookup", f"{_ATTRIBUTES} SELECT * FROM t WHERE name = 'GpsTime'")
def attribute_lookup(s: SparkSession, d: str) -> DataFrame:
    return attributes.attribute(attributes.all_formats(s), "gpstime")


@query("attribute_catalogue", f"{_ATTRIBUTES} SELECT * FROM t")
def attribute_catalogue(s: SparkSession, d: str) -> DataFrame:
    return attributes.all_formats(s)


@query("points_extents", "SELECT min(X) AS min_x, max(X) AS max_x, min(Y) AS min_y, max(Y) AS max_y, min(Z) AS min_z, max(Z) AS max_z, min(gps_us) AS min_gps_us, max(gps_us) AS max_gps_us FROM pts")
def points_extents(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).agg(*[f(c).alias(f"{n}_{c.lower()}") for c in ("X", "Y", "Z", "gps_us") for n, f in (("min", F.min), ("max", F.max))])


# cache ----------------------------------------------------------------------------------------------------------

_LOG = """, log AS (SELECT p.user_id AS session, row_number() OVER (PARTITION BY p.user_id ORDER BY gps_us, point_id) AS seq, p.d || '-' || p.kx || '-' || p.ky || '-' || p.kz AS key, n.point_count AS n_points
  FROM pts p JOIN nodes n USING (d, kx, ky, kz))"""


def access_log(s: SparkSession, d: str) -> DataFrame:
    """(session, seq, key, n_points): each event reads its point's node; a user's events are a session."""
    p = _points(s, d)
    log = p.join(select.broadcast_nodes(_nodes(s, d).select(*KEY, "point_count")), KEY).withColumn("session", F.col("user_id"))
    seq = F.row_number().over(Window.partitionBy("session").orderBy("gps_us", "point_id")).cast("long")
    return log.select("session", seq.alias("seq"), voxel.text(_key()).alias("key"), F.col("point_count").alias("n_points"))


@query("cache_hits_unbounded", f"{_LOG} SELECT session, seq, key, row_number() OVER (PARTITION BY session, key ORDER BY seq) > 1 AS hit FROM log")
def cache_hits_unbounded(s: SparkSession, d: str) -> DataFrame:
    return cache.unbounded(access_log(s, d)).select("session", "seq", "key", "hit")


@query("cache_stats_unbounded", f"""{_LOG}, h AS (SELECT *, row_number() OVER (PARTITION BY session, key ORDER BY seq) > 1 AS hit FROM log)
SELECT session, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(100 AS DOUBLE) * count(*) FILTER (hit) / count(*) AS hit_rate, sum(CASE WHEN hit THEN 0 ELSE 24 + 100 * n_points END)::BIGINT AS used_bytes FROM h GROUP BY session""")
def cache_stats_unbounded(s: SparkSession, d: str) -> DataFrame:
    h = cache.unbounded(access_log(s, d))
    return h.groupBy("session").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.lit(100.0) * F.count_if("hit") / F.count("*")).alias("hit_rate"), F.sum(F.when(F.col("hit"), 0).otherwise(cache.ENTRY + cache.PER_POINT * F.col("n_points"))).alias("used_bytes"))


@query("cached_nodes_order", f"{_LOG}, l AS (SELECT session, key, max(seq) AS last, count(*) AS accesses, max(n_points) AS n FROM log GROUP BY session, key) SELECT session, key, accesses, row_number() OVER (PARTITION BY session ORDER BY last DESC) AS rank, 24 + n * 100 AS bytes FROM l")
def cached_nodes_order(s: SparkSession, d: str) -> DataFrame:
    return cache.cached_nodes(access_log(s, d)).select("session", "key", "accesses", F.col("rank").cast("long").alias("rank"), "bytes")


@query("warm_missing", f"SELECT {_NODE} FROM nodes WHERE {_sphere_meets(SPHERE)} AND NOT ({_box_meets(BOX)})")
def warm_missing(s: SparkSession, d: str) -> DataFrame:
    """What a warm-up of the sphere's nodes loads when the box's are cached."""
    n = _nodes(s, d)
    return select.meeting(n, SPHERE).join(select.meeting(n, BOX).select(*KEY), KEY, "left_anti").select(*NODE)


_CACHED = "l AS (SELECT key, row_number() OVER (ORDER BY max(seq) DESC) AS rank FROM log WHERE session = 1 GROUP BY key)"


@query("export_cached", f"{_LOG}, {_CACHED} SELECT p.point_id, l.rank, p.X::FLOAT::DOUBLE AS px, p.Y::FLOAT::DOUBLE AS py, p.Z::FLOAT::DOUBLE AS pz, p.d AS depth FROM pts p JOIN l ON l.key = p.d || '-' || p.kx || '-' || p.ky || '-' || p.kz")
def export_cached(s: SparkSession, d: str) -> DataFrame:
    """Columns of the points of all nodes that a session's cache holds, with the node's rank, most recent first."""
    held = cache.cached_nodes(access_log(s, d).where("session = 1")).select(F.col("key").alias("held"), F.col("rank").cast("long").alias("rank"))
    p = _points(s, d).join(select.broadcast_nodes(held), voxel.text(_key()) == F.col("held"))
    at = lambda c: F.col(c).cast("float").cast("double")
    return p.select("point_id", "rank", at("X").alias("px"), at("Y").alias("py"), at("Z").alias("pz"), F.col("d").alias("depth"))


@query("lru_replay")
def lru_replay(s: SparkSession, d: str) -> DataFrame:
    return cache.replay(access_log(s, d), max_bytes=64 << 10)


from . import files  # noqa: E402, F401  registers the queries over files
