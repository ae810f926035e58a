"""Points of chosen nodes, exact filters on them, and what is summed over nodes and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, Frustum, Sphere, Vec, box_columns, distance
from .select import broadcast_nodes, meeting

KEY = ["d", "kx", "ky", "kz"]


def xyz() -> tuple[Column, ...]:
    return F.col("X"), F.col("Y"), F.col("Z")


def of_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """All points of the nodes: a semi join on the key, without a shuffle of the points while the nodes are few."""
    return points.join(broadcast_nodes(nodes.select(*KEY)), KEY, "left_semi")


def in_shape(points: DataFrame, nodes: DataFrame, shape: Box | Sphere | Frustum, resolution: float = 0, granularity: str = "point") -> DataFrame:
    """Points of the nodes that meet the shape; granularity "point" also tests each point."""
    out = of_nodes(points, meeting(nodes, shape, resolution))
    return out.where(shape.has_point(xyz())) if granularity == "point" else out


def in_nodes_bounds(points: DataFrame, nodes: DataFrame, shift: int) -> DataFrame:
    """A row for each point and each of the nodes whose bounds hold it, ancestors and descendants alike.

    A range join as an equi join: a point lies in at most one cell of each depth along each axis, save on
    borders, where it lies in two; so its cells at the depths in use meet the nodes by key, and the bounds decide.
    Points outside of the box of all the nodes are gone before that.
    """
    b = box_columns("n_")
    cols = [F.col("d").alias("n_d"), *[F.col(f"k{a}").alias(f"n_k{a}") for a in "xyz"], *[F.col(k).alias(f"n_{k}") for k in b]]
    # a row for each level, of which a tree has few
    levels = nodes.groupBy("d").agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"]).collect()
    if not levels:
        return points.join(nodes.select(*cols), F.lit(False))
    for a in "xyz":
        points = points.where(F.col(a.upper()).between(min(r[f"min_{a}"] for r in levels), max(r[f"max_{a}"] for r in levels)))
    p = points.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in sorted(r["d"] for r in levels)])))
    for a in "xyz":
        at = F.call_function("shiftright", F.col(f"raw_{a}"), F.lit(shift) - F.col("_d"))
        on_border = (F.col(f"raw_{a}") > 0) & (F.call_function("shiftleft", at, F.lit(shift) - F.col("_d")) == F.col(f"raw_{a}"))
        p = p.withColumn(f"_c{a}", F.explode(F.when(on_border, F.array(at, at - 1)).otherwise(F.array(at))))
    on = (F.col("_d") == F.col("n_d")) & (F.col("_cx") == F.col("n_kx")) & (F.col("_cy") == F.col("n_ky")) & (F.col("_cz") == F.col("n_kz"))
    hold = F.col("X").between(b["min_x"], b["max_x"]) & F.col("Y").between(b["min_y"], b["max_y"]) & F.col("Z").between(b["min_z"], b["max_z"])
    return p.join(broadcast_nodes(nodes.select(*cols)), on & hold).drop("_d", "_cx", "_cy", "_cz")


def nearest(points: DataFrame, nodes: DataFrame, at: Vec, k: int, radius: float) -> DataFrame:
    """The k nearest points among those of the nodes that meet the sphere, ties by point_id."""
    found = in_shape(points, nodes, Sphere(at, radius)).withColumn("distance", distance(xyz(), at))
    return found.orderBy("distance", "point_id").limit(k)


def first_points(points: DataFrame, n: int, salts: int = 32) -> DataFrame:
    """The n points of each node with the least point_id: first of each of its parts, so that a large node is several tasks."""
    part = points.withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(salts)))
    part = part.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY, "_salt").orderBy("point_id"))).where(F.col("_rank") <= n)
    return part.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("point_id"))).where(F.col("_rank") <= n).drop("_salt", "_rank")


def colors(points: DataFrame, first: int = 64) -> DataFrame:
    """red, green, blue as floats: the divisor of a chunk goes by the largest value of its first points."""
    top = first_points(points.select(*KEY, "point_id", "raw_r", "raw_g", "raw_b"), first).groupBy(*KEY).agg(F.max(F.greatest("raw_r", "raw_g", "raw_b")).alias("_top"))
    points = points.join(top, KEY).withColumn("divisor", F.when(F.col("_top") <= 255, 255).when(F.col("_top") <= 4095, 4095).otherwise(65535)).drop("_top")
    for c in ("red", "green", "blue"):
        points = points.withColumn(c, (F.col(f"raw_{c[0]}").cast("float") / F.col("divisor").cast("float")).cast("float"))
    return points


def by_level(nodes: DataFrame) -> DataFrame:
    """Per depth: nodes, points, points a node, resolution."""
    return nodes.groupBy("d").agg(
        F.count("*").alias("node_count"), F.sum("point_count").alias("points"), F.avg(F.col("point_count").cast("double")).alias("avg_points"), F.max("resolution").alias("resolution"),
    )


def layer_stats(nodes: DataFrame) -> DataFrame:
    """Per depth: share of the possible cells, mean extent, points."""
    size = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    return nodes.groupBy("d").agg(
        F.count("*").alias("node_count"), F.pow(F.lit(8.0), F.max("d")).cast("long").alias("possible"), *[F.avg(s).alias(f"avg_{n}") for n, s in zip(("width", "height", "depth"), size.values())],
        F.sum("point_count").alias("points"), F.avg(F.col("point_count").cast("double")).alias("avg_points"),
    ).withColumn("fill_percent", F.col("node_count") * F.lit(100.0) / F.col("possible"))


def compare_layers(nodes: DataFrame, layers: list[int]) -> DataFrame:
    """The asked layers, also those without nodes."""
    asked = nodes.sparkSession.sql(f"SELECT explode(array({', '.join(map(str, layers))})) AS layer")
    stats = nodes.where(F.col("d").isin(layers)).groupBy("d").agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))
    return asked.join(stats, F.col("layer") == F.col("d"), "left").select("layer", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("points", F.lit(0)).alias("points"))


def point_stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c.lower()}") for c in ("X", "Y", "Z") for n, f in (("min", F.min), ("max", F.max))], (F.sum("intensity") / F.count("*")).alias("avg_intensity"))


def top_classes(points: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent classes with their share of all points, ties by class."""
    c = points.groupBy("classification").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))  # one row
    return c.crossJoin(F.broadcast(total)).select("classification", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent")).orderBy(F.desc("n"), "classification").limit(n)


def per_sphere(nodes: DataFrame, center: Vec, radii: list[float], resolutions: list[float] | None = None) -> DataFrame:
    """Nodes and points met by each of a few spheres: one scan, a row for each sphere and node it meets."""
    rings = list(zip(radii, resolutions or [0.0] * len(radii)))
    hits = []
    for i, (r, res) in enumerate(rings):
        hit = Sphere(center, r).meets(box_columns()) & (F.lit(True) if res <= 0 else F.col("resolution") <= F.lit(float(res)))
        hits.append(F.when(hit, F.struct(F.lit(i).alias("ring"), F.lit(float(r)).alias("radius"))))
    found = nodes.select("point_count", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.groupBy("h.ring", "h.radius").agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))


def densities(nodes: DataFrame, center: Vec, radii: list[float]) -> DataFrame:
    volume = F.lit(4.0 / 3.0 * math.pi) * F.col("radius") * F.col("radius") * F.col("radius")
    return per_sphere(nodes, center, radii).withColumn("density", F.col("points") / volume)
