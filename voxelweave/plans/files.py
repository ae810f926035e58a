"""Registered queries over octree files: the derived points are written as files once, and read back through the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_columns, distance
from ..operators import points as pts
from ..operators import select, show
from ..sources import derived, octree
from ..sources.derived import KEY, OCTREE
from ..store import once
from .catalogue import BOX, SPHERE, _box_meets, _box_point, _COLOR, _d, _nodes, _points, _squared, query

_three = lambda v: ",".join(map(str, v))
CONFIG = {
    "center": _three(OCTREE.center), "half": OCTREE.half, "spacing": OCTREE.spacing, "low": _three(OCTREE.low), "high": _three(OCTREE.high), "scale": "0.25,0.25,0.25", "offset": "1000,2000,0", "pointFormat": 7,
}


#: Files for each core, and bits of a point's id in an extra dimension.
_FILES, _LOW = 3, 24


def _point_id() -> Column:
    return (F.shiftleft(F.col("PointSourceId").cast("long"), _LOW) + F.col("pid").cast("long")).alias("point_id")


def as_records(points: DataFrame) -> DataFrame:
    """Derived points under the names of the source; k and the low 24 bits of point_id, which a 32-bit float holds exactly, become extra dimensions, the others the point source."""
    p = derived.with_ord(points)
    return p.select(
        *KEY, "ord", "X", "Y", "Z", F.col("intensity").alias("Intensity"), F.col("return_number").cast("short").alias("ReturnNumber"), F.col("number_of_returns").cast("short").alias("NumberOfReturns"),
        F.col("classification").cast("short").alias("Classification"), (F.col("gps_us") / 1e6).alias("GpsTime"), F.col("raw_r").alias("Red"), F.col("raw_g").alias("Green"), F.col("raw_b").alias("Blue"),
        F.shiftright("point_id", _LOW).cast("int").alias("PointSourceId"), F.col("point_id").bitwiseAND((1 << _LOW) - 1).cast("float").alias("pid"), F.coalesce("extra_k", F.lit(0)).cast("float").alias("k"),
    )


def in_files(s: SparkSession, points: DataFrame) -> DataFrame:
    """Records as they are written: nodes whole, in order, a few files for each core, as nodes of the upper levels are large."""
    # points are numbered in the partitions and in the order of the files: one shuffle and one sort
    return as_records(points.repartition(_FILES * s.sparkContext.defaultParallelism, *KEY).sortWithinPartitions(*KEY, "point_id"))


def folder(s: SparkSession, d: str, compressed: bool) -> str:
    """Octree files of all points, a file a partition."""
    octree.register(s)

    def make(path: str) -> None:
        in_files(s, _points(s, d)).write.format("octree").options(**CONFIG, compressed=compressed, wkt="LOCAL_CS[]").mode("append").save(path)

    return once(s, ("octree", d, compressed), make)


def read(s: SparkSession, d: str, table: str, compressed: bool = True, **options: object) -> DataFrame:
    return s.read.format("octree").option("table", table).options(**options).load(folder(s, d, compressed))


_FIELDS = ["ord", "X", "Y", "Z", "Intensity", "ReturnNumber", "NumberOfReturns", "Classification", "GpsTime"]


def _as_read(p: DataFrame) -> DataFrame:
    colours = [F.col(c).cast("double").alias(c) for c in ("Red", "Green", "Blue")]
    return p.select(_point_id(), *KEY, *_FIELDS, *colours, F.col("k").cast("int").alias("k"))


_READ = f"""{_COLOR} SELECT point_id, d, kx, ky, kz, ord::INT AS ord, X, Y, Z, intensity AS "Intensity", return_number::SMALLINT AS "ReturnNumber", number_of_returns::SMALLINT AS "NumberOfReturns",
  classification::SMALLINT AS "Classification", gps_us::DOUBLE / 1e6 AS "GpsTime", red::DOUBLE AS "Red", green::DOUBLE AS "Green", blue::DOUBLE AS "Blue", coalesce(extra_k, 0) AS k FROM col"""


@query("source_points_coded", _READ)
def source_points_coded(s: SparkSession, d: str) -> DataFrame:
    return _as_read(read(s, d, "points"))


@query("source_points_raw", _READ)
def source_points_raw(s: SparkSession, d: str) -> DataFrame:
    return _as_read(read(s, d, "points", compressed=False))


@query("source_points_of_layer", f"{_READ} WHERE d = 2")
def source_points_of_layer(s: SparkSession, d: str) -> DataFrame:
    """Only the chunks of the layer are read."""
    return _as_read(read(s, d, "points").where("d = 2"))


@query("source_points_in_box", f"{_READ} WHERE {_box_point(BOX)}")
def source_points_in_box(s: SparkSession, d: str) -> DataFrame:
    """The box goes down to the source, which reads the chunks whose cubes meet it."""
    return _as_read(read(s, d, "points").where(BOX.has_point(pts.xyz())))


@query("source_core_streams", f"{_COLOR} SELECT point_id, X, Y, Z, green::DOUBLE AS \"Green\", coalesce(extra_k, 0) AS k FROM col WHERE d <= 2")
def source_core_streams(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "points", streams="core,PointSourceId").where("d <= 2")
    return p.select(_point_id(), "X", "Y", "Z", F.col("Green").cast("double").alias("Green"), F.col("k").cast("int").alias("k"))


@query("source_box_stats", f"SELECT classification::SMALLINT AS \"Classification\", count(*) AS n, min(Z) AS min_z, max(Z) AS max_z, sum(intensity)::DOUBLE / count(*) AS avg_intensity FROM pts WHERE {_box_point(BOX)} GROUP BY 1")
def source_box_stats(s: SparkSession, d: str) -> DataFrame:
    """Decoding, the exact filter and sums in one plan."""
    p = read(s, d, "points").where(BOX.has_point(pts.xyz()))
    return p.groupBy("Classification").agg(F.count("*").alias("n"), F.min("Z").alias("min_z"), F.max("Z").alias("max_z"), (F.sum("Intensity") / F.count("*")).alias("avg_intensity"))


@query("source_nodes", "SELECT d, kx, ky, kz, point_count::INT AS point_count, min_x, min_y, min_z, max_x, max_y, max_z, resolution FROM nodes")
def source_nodes(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "nodes").select(*KEY, "point_count", *box_columns(), "resolution")


@query("source_nodes_in_box", f"SELECT d, kx, ky, kz, point_count::INT AS point_count FROM nodes WHERE {_box_meets(BOX)} AND resolution <= 32")
def source_nodes_in_box(s: SparkSession, d: str) -> DataFrame:
    return select.meeting(read(s, d, "nodes").where("resolution <= 32"), BOX).select(*KEY, "point_count")


@query("source_entries", "SELECT '0-0-0-0' AS page_key, d, kx, ky, kz, point_count::INT AS point_count FROM nodes")
def source_entries(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "entries").select("page_key", *KEY, "point_count")


@query("source_header", """SELECT 7 AS point_format, true AS compressed, 44 AS record_length, count(*) AS points, CAST(0.25 AS DOUBLE) AS scale, CAST(2000 AS DOUBLE) AS offset_y, CAST(9192 AS DOUBLE) AS center_x,
  CAST(8192 AS DOUBLE) AS half, CAST(128 AS DOUBLE) AS spacing, CAST(18384 AS DOUBLE) AS high_y, 'LOCAL_CS[]' AS wkt FROM pts""")
def source_header(s: SparkSession, d: str) -> DataFrame:
    """The files' headers agree in all but their points."""
    h = read(s, d, "header").groupBy("point_format", "compressed", "record_length", F.col("scale")[0].alias("scale"), F.col("offset")[1].alias("offset_y"), F.col("center")[0].alias("center_x"), "half", "spacing", F.col("high")[1].alias("high_y"), "wkt")
    return h.agg(F.sum("point_count").alias("points"))


@query("source_vlrs", "SELECT * FROM (VALUES ('copc', 1, 160), ('LASF_Spec', 4, 384), ('LASF_Projection', 2112, 11)) AS v(user_id, record_id, bytes)")
def source_vlrs(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "vlrs").select("user_id", "record_id", "description", F.when(F.col("user_id") == "copc", F.lit(160)).otherwise(F.octet_length("data")).alias("bytes"))
    return v.select("user_id", "record_id", "bytes").distinct()


@query("source_dims", "SELECT * FROM (VALUES (0, 'pid', 9, 1, 4), (1, 'k', 9, 1, 4)) AS v(ordinal, name, kind, components, size)")
def source_dims(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "dims").select("ordinal", "name", "kind", "components", "size").distinct()


@query("source_chunk_totals", "SELECT d, count(*) AS nodes, sum(point_count)::BIGINT AS points, sum(44 * point_count)::BIGINT AS bytes FROM nodes GROUP BY d")
def source_chunk_totals(s: SparkSession, d: str) -> DataFrame:
    """Chunks as they lie in the files that aren't compressed."""
    return octree.chunk_totals(read(s, d, "chunks", compressed=False))


@query("source_layer_stats", "SELECT count(*) AS node_count, sum(point_count)::BIGINT AS points, sum(44 * point_count)::BIGINT AS bytes, sum(point_count)::DOUBLE / count(*) AS avg_points, sum(44 * point_count)::DOUBLE / count(*) AS avg_bytes FROM nodes WHERE d = 2")
def source_layer_stats(s: SparkSession, d: str) -> DataFrame:
    n = select.layer(read(s, d, "nodes", compressed=False), 2)
    return n.agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"), F.sum("byte_size").alias("bytes"), (F.sum("point_count") / F.count("*")).alias("avg_points"), (F.sum("byte_size") / F.count("*")).alias("avg_bytes"))


@query("source_compression", "SELECT d, true AS smaller, sum(44 * point_count)::BIGINT AS raw_bytes FROM nodes WHERE d = 0 GROUP BY d")
def source_compression(s: SparkSession, d: str) -> DataFrame:
    """Whether the coarsest node's coded chunk takes less than its records."""
    n = read(s, d, "nodes").where("d = 0").groupBy("d").agg(F.sum("byte_size").alias("b"), F.sum(F.col("point_count").cast("long") * 44).alias("raw_bytes"))
    return n.select("d", (F.col("b") < F.col("raw_bytes")).alias("smaller"), "raw_bytes")


# text -----------------------------------------------------------------------------------------------------------

@query("print_points", f"""{_COLOR} SELECT point_id, printf('(%.3f, %.3f, %.3f) RGB(%.3f, %.3f, %.3f) distance %.2f', X, Y, Z, red::DOUBLE, green::DOUBLE, blue::DOUBLE, sqrt({_squared(SPHERE.center)})) || coalesce(printf(' k=%.2f', extra_k::DOUBLE), '') AS line
FROM col WHERE {_squared(SPHERE.center)} <= {_d(SPHERE.radius**2)} ORDER BY point_id LIMIT 10""")
def print_points(s: SparkSession, d: str) -> DataFrame:
    p = pts.in_shape(pts.colors(_points(s, d)), _nodes(s, d), SPHERE)
    return show.head(p, 10, show.point_line(True, distance(pts.xyz(), SPHERE.center), {"k": F.col("extra_k")}), ["point_id"])


@query("print_nodes", "SELECT seq, d || '-' || kx || '-' || ky || '-' || kz || printf(': %d points, (%.3f, %.3f, %.3f) to (%.3f, %.3f, %.3f)', point_count, min_x, min_y, min_z, max_x, max_y, max_z) AS line FROM nodes ORDER BY seq LIMIT 20")
def print_nodes(s: SparkSession, d: str) -> DataFrame:
    return show.head(_nodes(s, d), 20, show.node_line(), ["seq"]).withColumn("seq", F.col("seq").cast("long"))
