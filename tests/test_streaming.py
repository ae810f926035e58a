from voxelweave.functions.voxel import Octree
from voxelweave.operators.cache import PointCache
from voxelweave.streaming.cache_stream import replay_stream, stages_stream, with_bounds


def run(spark, df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_replay_keeps_its_state(spark, tmp_path):
    keys = [(i * 5 + i // 3) % 7 for i in range(60)]
    for part in range(3):  # three files, a micro-batch each
        rows = [(i % 2, i, f"k{k}", k + 1) for i, k in enumerate(keys) if i // 20 == part]
        spark.createDataFrame(rows, "session long, seq long, key string, n_points long").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("session long, seq long, key string, n_points long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "log"))
    got = {r["seq"]: (r["hit"], r["evictions"], r["used_bytes"]) for r in run(spark, replay_stream(log, 1500), "append", tmp_path, "replayed")}
    for s in range(2):
        c = PointCache(1500)
        for i, k in enumerate(keys):
            if i % 2 == s:
                hit = c.get_or_load(f"k{k}", k + 1)
                assert got[i] == (hit, c.evictions, c.used)


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, x, y, 0, 10) for x in range(2) for y in range(2)], "d int, kx int, ky int, kz int, point_count long").write.parquet(str(tmp_path / "nodes"))
    stream = spark.readStream.schema("d int, kx int, ky int, kz int, point_count long").parquet(str(tmp_path / "nodes"))
    tree = Octree((50.0, 50.0, 50.0), 50.0, 8.0, (0.0,) * 3, (100.0,) * 3)
    out = run(spark, stages_stream(with_bounds(stream, tree), (10.0, 10.0, 10.0), [20.0, 45.0]), "complete", tmp_path, "stages")
    assert sorted((r["ring"], r["node_count"], r["points"]) for r in out) == [(0, 1, 10), (1, 2, 20)]
