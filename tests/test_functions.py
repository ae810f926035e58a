import math

import pytest
from pyspark.sql import functions as F

from voxelweave.functions import voxel
from voxelweave.functions.geometry import Box, ClipFrustum, Frustum, Plane, Sphere, orthographic
from voxelweave.functions.voxel import Octree
from voxelweave.operators import bits, select, traverse
from voxelweave.operators.cache import PointCache, replay

TREE = Octree((50.0, 50.0, 50.0), 50.0, 10.0, (0.0, 0.0, 0.0), (100.0, 80.0, 60.0))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(spark, low, high, test):
    cols = {f"{m}_{a}": F.lit(float(v)) for m, p in (("min", low), ("max", high)) for a, v in zip("xyz", p)}
    return one(spark, test(cols).alias("v"))["v"]


def test_keys(spark):
    k = voxel.key(*[F.lit(v) for v in (2, 3, 1, 0)])
    r = one(spark, voxel.text(k).alias("t"), voxel.text(voxel.parent(k)).alias("p"), voxel.text(voxel.child(k, F.lit(5))).alias("c"), F.size(voxel.children(k)).alias("n"),
            voxel.text(voxel.parent(voxel.root())).alias("r"), voxel.is_valid(voxel.invalid()).alias("i"), F.size(voxel.ancestors(voxel.root())).alias("a"), F.size(voxel.ancestors(k, True)).alias("s"),
            voxel.is_under(k, voxel.root()).alias("u"), voxel.is_under(k, k).alias("self"), voxel.text(voxel.at_depth(k, F.lit(5))).alias("deep"))
    assert tuple(r) == ("2-3-1-0", "1-1-0-0", "3-7-2-1", 8, "-1--1--1--1", False, 0, 3, True, False, "-1--1--1--1")
    assert one(spark, voxel.text(voxel.parse(F.lit("4-1-2-3"))).alias("v"))["v"] == "4-1-2-3"
    with pytest.raises(Exception, match="not a voxel key"):
        one(spark, voxel.parse(F.lit("1-2")).alias("v"))


def test_every_child_has_its_parent(spark):
    rows = spark.range(64).select(voxel.key(F.lit(3), *[(F.col("id") * m % 8).cast("int") for m in (1, 3, 5)]).alias("k"))
    rows = rows.select("k", F.explode(voxel.children(F.col("k"))).alias("c"))
    assert rows.where(voxel.parent(F.col("c")) != F.col("k")).count() == 0


def test_bounds_and_depth(spark):
    b = voxel.bounds(voxel.key(*[F.lit(v) for v in (1, 1, 0, 1)]), TREE)
    assert tuple(one(spark, *[c.alias(n) for n, c in b.items()])) == (50.0, 0.0, 50.0, 100.0, 50.0, 100.0)
    assert [voxel.depth_at(r, TREE) for r in (20, 10, 9.9, 1.25)] == [0, 0, 1, 3]
    with pytest.raises(ValueError):
        voxel.depth_at(0, TREE)


def test_boxes_touch(spark):
    b = Box((0, 0, 0), (10, 10, 10))
    assert box(spark, (10, 0, 0), (20, 5, 5), b.meets) and not box(spark, (10.001, 0, 0), (20, 5, 5), b.meets)
    # 32-bit narrowing makes these touch
    assert box(spark, (10.0000001, 0, 0), (20, 5, 5), b.meets)
    assert box(spark, (0, 0, 0), (10, 10, 10), b.has_box) and box(spark, (0, 0, 0), (10, 10, 10), b.inside)
    assert not box(spark, (2, 2, 2), (3, 3, 3), b.crosses) and box(spark, (5, 5, 5), (15, 6, 6), b.crosses)
    assert Box.around((1, 1, 1), (1, 2, 3)).size == (2, 4, 6)


def test_spheres(spark):
    s = Sphere((0, 0, 0), 5)
    assert box(spark, (3, 4, 0), (9, 9, 9), s.meets) and not box(spark, (3.1, 4, 0), (9, 9, 9), s.meets)
    assert box(spark, (-1, -1, -1), (1, 1, 1), s.has_box) and not box(spark, (-4, -4, -4), (4, 4, 4), s.has_box)
    assert one(spark, s.has_point((F.lit(3.0), F.lit(4.0), F.lit(0.0))).alias("v"))["v"]
    with pytest.raises(ValueError):
        Sphere((0, 0, 0), -1)


def test_planes_and_frusta(spark):
    p = Plane.through((0, 0, 2), (0, 0, 3)).normalized()
    assert (p.c, p.d) == (1, -3) and Plane(0, 0, 0, 1).normalized() == Plane(0, 0, 0, 1)
    assert box(spark, (0, 0, 0), (1, 1, 3), p.meets) and not box(spark, (0, 0, 0), (1, 1, 2.9), p.meets)
    identity = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    f = Frustum.from_rows(identity)
    assert len(f.planes) == 6 and box(spark, (0.5, 0, 0), (3, 1, 1), f.meets) and not box(spark, (1.5, 0, 0), (3, 1, 1), f.meets)
    assert one(spark, f.has_point((F.lit(1.0), F.lit(-1.0), F.lit(0.0))).alias("v"))["v"]
    assert Frustum.from_view_and_projection(identity, identity) == f
    clip = ClipFrustum.from_columns(orthographic(Box((0, 0, 0), (10, 10, 10))))
    assert box(spark, (9, 9, 9), (12, 12, 12), clip.meets) and not box(spark, (10.5, 0, 0), (12, 1, 1), clip.meets)
    assert not box(spark, (10, 0, 0), (12, 1, 1), clip.meets)  # touching only
    with pytest.raises(ValueError):
        Frustum.from_rows([1.0] * 15)


def test_bit_fields(spark):
    names = ["return_number", "number_of_returns", "scan_direction", "edge_of_flight"]
    rows = spark.range(256).select(F.col("id").cast("int").alias("v")).select("v", *[c.alias(n) for n, c in bits.unpack_legacy(F.col("v")).items()])
    assert rows.where(bits.pack_legacy(*[F.col(n) for n in names]) != F.col("v")).count() == 0


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(0, 0, 0, 0), *[(1, x, 0, 0) for x in range(2)], *[(2, x, 0, 0) for x in range(4)]]
    n = spark.createDataFrame([(*r, 10, 128.0 / 2 ** r[0], i) for i, r in enumerate(rows)], "d int, kx int, ky int, kz int, point_count long, resolution double, seq int")
    return n.select("*", *[c.alias(a) for a, c in voxel.bounds(voxel.key(*[F.col(c) for c in ("d", "kx", "ky", "kz")]), TREE).items()])


@pytest.mark.parametrize("verdict,cached,viewed", [
    (traverse.constant(True, True, True), 7, 7), (traverse.constant(True, True, False), 1, 1), (traverse.constant(False, False, True), 0, 0), (traverse.constant(False, False, False), 0, 0),
    (traverse.to_depth(1), 3, 3), (traverse.to_depth(1, cache_all=True), 7, 3),
])
def test_traversal_verdicts(tree, verdict, cached, viewed):
    for in_order in (False, True):
        out = traverse.traverse(tree, verdict, in_order)
        assert (out.where("cached").count(), out.where("viewed").count()) == (cached, viewed)


def test_order_matters_only_if_asked(tree):
    backwards = tree.withColumn("seq", -F.col("seq"))
    assert traverse.traverse(backwards, traverse.constant(True, True, False), in_order=True).count() == 7
    assert traverse.traverse(backwards, traverse.constant(True, True, False)).count() == 1


def test_selection(tree):
    assert select.layer(tree, 1).count() == 2 and select.node(tree, 2, 3, 0, 0).count() == 1
    b = Box((0, 0, 0), (20, 20, 20))
    assert select.meeting(tree, b, 32.0).count() == 1 and select.meeting(tree, b, 32.0, cumulative=True).count() == 3
    with pytest.raises(ValueError):
        select.layer(tree, -1)


def test_cache_model():
    c = PointCache(max_bytes=3 * 124, per_point=100)
    assert [c.get_or_load(k, 1) for k in "abcad"] == [False, False, False, True, False]
    assert list(c.entries) == ["c", "a", "d"] and c.evictions == 1  # b was the least recent
    assert not c.put("c", 4) and c.contains("c")  # too large: refused, the stale entry stays
    assert c.get_or_load_batch([("x", 1), ("a", 1)]) == [("a", 1), ("x", 1)] and not c.contains("c")
    assert c.update([("x", 1), ("z", 0)]) == 0 and c.remove("x") and not c.remove("x")
    s = c.stats()
    assert (s["hits"], s["misses"], s["evictions"]) == (2, 5, 2) and math.isclose(s["hit_rate"], 200 / 7)
    c.clear()
    assert c.stats()["used_bytes"] == 0
    with pytest.raises(ValueError):
        PointCache(0)


def test_replay_follows_the_model(spark):
    keys = [(i * 7 + i // 5) % 9 for i in range(200)]
    log = spark.createDataFrame([(i % 3, i, f"k{k}", k + 1) for i, k in enumerate(keys)], "session long, seq long, key string, n_points long")
    got = {(r["session"], r["seq"]): (r["hit"], r["evictions"], r["used_bytes"]) for r in replay(log, 2500).collect()}
    for session in range(3):
        c = PointCache(2500)
        for i, k in enumerate(keys):
            if i % 3 == session:
                hit = c.get_or_load(f"k{k}", k + 1)
                assert got[session, i] == (hit, c.evictions, c.used)
