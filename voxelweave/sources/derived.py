"""Point, node and access tables derived from the events table by exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import voxel
from ..functions.voxel import Octree
from ..operators.order import numbered
from ..store import parquet, table_once

OCTREE = Octree((9192.0, 10192.0, 8192.0), 8192.0, 128.0, (1000.0, 2000.0, 0.0), (17384.0, 18384.0, 16384.0))
KEY = ["d", "kx", "ky", "kz"]
#: Microseconds since 1970 of a timestamp without a zone, whatever the session's zone.
_MICROS = "unix_date(to_date(ts)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint)"
KINDS = ("view", "signup", "error", "click", "purchase")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point an event; a node's points are those of its key, ord counts them in order of point_id."""
    e = parquet(spark, f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    e = e.select(
        i.alias("point_id"), "user_id", "ts", "event_type", "props",
        ((i * 7919 + F.col("user_id") * 104729) % 65536).cast("int").alias("raw_x"), ((i * 15485863) % 65536).cast("int").alias("raw_y"), (F.round(F.col("value") * 100).cast("long") % 65536).cast("int").alias("raw_z"),
        F.when(i % 64 == 0, 0).when(i % 16 == 0, 1).when(i % 4 == 0, 2).otherwise(3).alias("d"),
    )
    for a in voxel.AXES:
        e = e.withColumn(f"k{a}", F.expr(f"shiftright(raw_{a}, 16 - d)"))
    for a, o in zip("xyz", (1000.0, 2000.0, 0.0)):
        e = e.withColumn(a.upper(), F.col(f"raw_{a}").cast("double") * F.lit(0.25) + F.lit(o))
    wide = F.when(F.col("d") % 3 == 0, 256).when(F.col("d") % 3 == 1, 4096).otherwise(65536)
    for c, m in (("r", 31), ("g", 37), ("b", 41)):
        e = e.withColumn(f"raw_{c}", ((F.col("point_id") * m) % wide).cast("int"))
    code = F.coalesce(*[F.when(F.col("event_type") == k, n) for n, k in enumerate(KINDS)], F.lit(len(KINDS)))
    return e.select(
        "point_id", "user_id", *KEY, "raw_x", "raw_y", "raw_z", "X", "Y", "Z", F.col("raw_z").alias("intensity"), code.alias("classification"), (F.col("point_id") % 5 + 1).cast("int").alias("return_number"),
        F.lit(5).alias("number_of_returns"), F.expr(_MICROS).alias("gps_us"), "raw_r", "raw_g", "raw_b", F.get_json_object("props", "$.k").cast("int").alias("extra_k"),
    )


def with_ord(points: DataFrame) -> DataFrame:
    return points.withColumn("ord", F.row_number().over(Window.partitionBy(*KEY).orderBy("point_id")) - 1)


def nodes(points: DataFrame, octree: Octree = OCTREE) -> DataFrame:
    """The points' keys with counts, bounds and resolution."""
    n = points.groupBy(*KEY).agg(F.count("*").alias("point_count"))
    k = voxel.key(*[F.col(c) for c in KEY])
    return n.select("*", *[c.alias(a) for a, c in voxel.bounds(k, octree).items()], voxel.resolution(F.col("d"), octree).alias("resolution"))


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all points, with seq, their number in file order (by key), and first, where their points begin.

    A hierarchy is stored beside its points: this one is written once for an application, with a row for each chunk.
    """
    return table_once(spark, ("nodes", sf_dir), lambda: numbered(nodes(points(spark, sf_dir)), KEY, "seq", {"first": F.col("point_count")}))


POINTS_SQL = """
e AS (
  SELECT event_id AS point_id, user_id, ts, event_type, props, ((event_id * 7919 + user_id * 104729) % 65536)::INT AS raw_x, ((event_id * 15485863) % 65536)::INT AS raw_y,
    (round(value * CAST(100 AS DOUBLE))::BIGINT % 65536)::INT AS raw_z,
    CASE WHEN event_id % 64 = 0 THEN 0 WHEN event_id % 16 = 0 THEN 1 WHEN event_id % 4 = 0 THEN 2 ELSE 3 END AS d
  FROM events
), pts AS (
  SELECT point_id, user_id, d, raw_x >> (16 - d) AS kx, raw_y >> (16 - d) AS ky, raw_z >> (16 - d) AS kz, raw_x, raw_y, raw_z,
    raw_x::DOUBLE * CAST(0.25 AS DOUBLE) + CAST(1000 AS DOUBLE) AS X, raw_y::DOUBLE * CAST(0.25 AS DOUBLE) + CAST(2000 AS DOUBLE) AS Y, raw_z::DOUBLE * CAST(0.25 AS DOUBLE) AS Z,
    raw_z AS intensity, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS classification,
    (point_id % 5 + 1)::INT AS return_number, 5 AS number_of_returns, epoch_us(ts) AS gps_us,
    ((point_id * 31) % (CASE d % 3 WHEN 0 THEN 256 WHEN 1 THEN 4096 ELSE 65536 END))::INT AS raw_r, ((point_id * 37) % (CASE d % 3 WHEN 0 THEN 256 WHEN 1 THEN 4096 ELSE 65536 END))::INT AS raw_g,
    ((point_id * 41) % (CASE d % 3 WHEN 0 THEN 256 WHEN 1 THEN 4096 ELSE 65536 END))::INT AS raw_b,
    TRY_CAST(json_extract_string(props, '$.k') AS INT) AS extra_k
  FROM e
), op AS (SELECT *, row_number() OVER (PARTITION BY d, kx, ky, kz ORDER BY point_id) - 1 AS ord FROM pts
), n0 AS (SELECT d, kx, ky, kz, count(*) AS point_count, CAST(16384 AS DOUBLE) / (1 << d) AS span FROM pts GROUP BY d, kx, ky, kz
), nodes AS (
  SELECT d, kx, ky, kz, point_count, CAST(1000 AS DOUBLE) + kx * span AS min_x, CAST(2000 AS DOUBLE) + ky * span AS min_y, kz * span AS min_z,
    CAST(1000 AS DOUBLE) + kx * span + span AS max_x, CAST(2000 AS DOUBLE) + ky * span + span AS max_y, kz * span + span AS max_z,
    CAST(128 AS DOUBLE) / (1 << d) AS resolution, row_number() OVER (ORDER BY d, kx, ky, kz) AS seq
  FROM n0
)"""
