"""Writing octree files, streams, ordering without single tasks, and the cache's columns."""

import io
import random

import numpy as np
import pytest
from points import some_points
from pyspark.sql import functions as F

from voxelweave.operators import cache, order
from voxelweave.operators import points as pts
from voxelweave.sources import octree
from voxelweave.sources.chunk import CORE
from voxelweave.sources.records import Extents, kind_of
from voxelweave.store import estimated_bytes, once, written


def some_rows(spark, n=900, fmt=8):
    p = some_points(fmt, n, 3)
    r = np.random.default_rng(0)
    rows = [
        (1, int(k >> 2 & 1), int(k >> 1 & 1), int(k & 1), i, float(p["X"][i]) * 0.5, float(p["Y"][i]) * 0.5 + 1, float(p["Z"][i]) * 0.5, int(p["Intensity"][i]), int(p["Classification"][i]), float(p["GpsTime"][i]), int(p["Red"][i]), int(p["Green"][i]), int(p["Blue"][i]), int(p["Nir"][i]), float(i % 7) / 2)
        for i, k in enumerate(r.integers(0, 8, n))
    ]
    return spark.createDataFrame(rows, "d int, kx int, ky int, kz int, ord int, X double, Y double, Z double, Intensity int, Classification int, GpsTime double, Red int, Green int, Blue int, Nir int, height double")


@pytest.mark.parametrize("compressed", [True, False])
def test_what_is_written_is_read(spark, tmp_path, compressed):
    octree.register(spark)
    df = some_rows(spark)
    keys = ["d", "kx", "ky", "kz"]
    out = df.repartition(3, *keys).sortWithinPartitions(*keys, "ord").write.format("octree").option("center", "0,0,0").option("half", 1e9).option("pointFormat", 8)
    out.option("scale", "0.5,0.5,0.5").option("offset", "0,1,0").option("compressed", compressed).option("wkt", "W").mode("append").save(str(tmp_path / "o"))
    back = spark.read.format("octree").load(str(tmp_path / "o"))
    names = ["kx", "ky", "kz", "X", "Y", "Z", "Intensity", "Classification", "GpsTime", "Nir", "height"]
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, df.select(names).collect()))
    assert back.groupBy("kx", "ky", "kz").agg(F.max("ord") + 1, F.count("*")).where("count(1) != (max(ord) + 1)").count() == 0
    h = spark.read.format("octree").option("table", "header").load(str(tmp_path / "o")).collect()
    assert {(r["point_format"], r["compressed"], r["wkt"]) for r in h} == {(8, compressed, "W")} and sum(r["point_count"] for r in h) == 900
    again = df.limit(10).coalesce(1).sortWithinPartitions(*keys, "ord").write.format("octree").option("half", 1e9).option("compressed", compressed)
    again.mode("overwrite").save(str(tmp_path / "o"))
    assert spark.read.format("octree").load(str(tmp_path / "o")).count() == 10


def test_bad_options(spark, tmp_path):
    octree.register(spark)
    with pytest.raises(Exception, match="format 3"):
        some_rows(spark, 5).write.format("octree").option("pointFormat", 3).mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="columns"):
        some_rows(spark, 5).drop("kx").write.format("octree").mode("append").save(str(tmp_path / "y"))
    assert octree.Config.of({}) == octree.Config() and octree.Config().scale == (0.01,) * 3


def test_streams_without_spark(spark, tmp_path):
    octree.register(spark)
    some_rows(spark, 50).coalesce(1).sortWithinPartitions("d", "kx", "ky", "kz", "ord").write.format("octree").option("half", 1e9).option("scale", "0.5,0.5,0.5").mode("append").save(str(tmp_path / "s"))
    data = open(octree.files_of(str(tmp_path / "s"))[0], "rb").read()
    stream = io.BytesIO(data)
    with octree.Opened(stream) as f:
        found = list(octree.read_points(f, CORE))
    assert sum(len(p["X"]) for _, p in found) == 50 and all(k[0] == 1 for k, _ in found) and not stream.closed
    octree.Opened(stream, leave_open=False).close()
    assert stream.closed


def test_extents_and_kinds():
    e = Extents().put("X", 1.0, 2.0).put("X", 0.0, 3.0)
    assert e.get("X") == (True, 0.0, 3.0) and e.get("Y") == (False, 0.0, 0.0) and str(e) == "extents of 1 dimensions"
    assert [kind_of((0, 0, 0, 0, 0, 0, n)) for n in (-1, 0, 5)] == ["page", "empty", "node"]


def test_numbers_and_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(i // 50, i % 50, r.randrange(100)) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    got = [tuple(x) for x in order.numbered(df, ["a", "b"], "nr", {"before": F.col("v")}).orderBy("nr").collect()]
    total = 0
    for nr, (a, b, v, n, before) in enumerate(got, 1):
        assert (a, b, n, before) == ((nr - 1) // 50, (nr - 1) % 50, nr, total)
        total += v
    plan = order.numbered(df, ["a", "b"], "nr")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Physical Plan")[1].split("BroadcastExchange")[0]


def test_first_points_of_a_large_node(spark):
    p = spark.range(5000).select(F.lit(0).alias("d"), F.lit(0).alias("kx"), F.lit(0).alias("ky"), (F.col("id") % 2).cast("int").alias("kz"), F.col("id").alias("point_id"))
    got = pts.first_points(p, 64, salts=8).groupBy("kz").agg(F.count("*").alias("n"), F.max("point_id").alias("last")).collect()
    assert sorted((r["kz"], r["n"], r["last"]) for r in got) == [(0, 64, 126), (1, 64, 127)]


def test_tables_are_written_once(spark):
    calls = []
    make = lambda path: (calls.append(path), spark.range(3).write.parquet(path))
    assert once(spark, ("t", 1), make) == once(spark, ("t", 1), make) and len(calls) == 1
    assert once(spark, ("t", 2), make) != calls[0]
    assert estimated_bytes(written(spark.range(10))) < 1 << 20


def test_columns_in_the_cache():
    assert cache.separated_size(10) == 2 * (24 + 160) + 24 + 40
    c = cache.PointCache(2000, 10)
    assert c.put("a", 50) and c.used == 524
    assert c.put_separated("a", 20) and c.used == cache.separated_size(20) and not c.entries["a"].points  # in place of the rows
    assert c.put("b", 90) and c.evictions == 0
    assert not c.put_separated("c", 1000) and c.evictions == 2 and c.used == 0  # room is made before it is refused
    with cache.PointCache(10_000, 10) as c:
        assert c.update_separated([("a", 5), ("b", 0), ("c", 6)]) == 2 and c.version == 1 and c.contains("c")
        assert c.update_separated([("a", 5), ("d", 4)], only=False) == 1 and c.entries["d"].points == 64 and c.entries["d"].columns == cache.separated_size(4)
        c.touch("a")
        assert list(c.entries) == ["c", "d", "a"] and c.hits == 0 and c.used == sum(e.bytes for e in c.entries.values())
    assert c.entries is None
    c.close()
