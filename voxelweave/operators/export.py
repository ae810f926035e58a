"""Points in the layouts that renderers take: a row each, or columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES_A_POINT = 64  # of an exported point, about
#: Names that a normal's three components go by, lower case without spaces (fixed values).
NORMALS = (("normalx", "nx"), ("normaly", "ny"), ("normalz", "nz"))


def position() -> Column:
    return F.array(*[F.col(c).cast("float") for c in "XYZ"], F.lit(1.0).cast("float"))


def color() -> Column:
    """White where a colour is missing."""
    return F.array(*[F.coalesce(F.col(c), F.lit(1.0)).cast("float") for c in ("red", "green", "blue")], F.lit(1.0).cast("float"))


def rows(points: DataFrame, extras: dict[str, Column], include: list[str] | None = None) -> DataFrame:
    """(point_id, position, color, depth, extra): extra maps each included name to its floats."""
    names = [n for n in extras if not include or n in include]
    is_array = {n: points.select(extras[n]).schema[0].dataType.typeName() == "array" for n in names}
    values = [extras[n] if is_array[n] else F.array(extras[n]) for n in names]
    extra = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[v.cast("array<float>") for v in values])) if names else F.create_map().cast("map<string,array<float>>")
    return points.select("point_id", position().alias("position"), color().alias("color"), F.col("d").alias("depth"), extra.alias("extra"))


def separated(points: DataFrame, extras: dict[str, Column], include: list[str] | None = None) -> DataFrame:
    """Wide columns: px..pw, cr..ca, depth, a column for each included extra (0 where missing), and nx, ny, nz if the extras hold a whole normal."""
    flat = {n.lower().replace(" ", ""): n for n in extras}
    normal = [next((flat[a] for a in names if a in flat), None) for names in NORMALS]
    out = [F.get(position(), i).alias(f"p{a}") for i, a in enumerate("xyzw")] + [F.get(color(), i).alias(f"c{a}") for i, a in enumerate("rgba")]
    if all(normal):
        out += [extras[n].cast("float").alias(a) for n, a in zip(normal, ("nx", "ny", "nz"))]
    out += [F.coalesce(extras[n].cast("float"), F.lit(0.0).cast("float")).alias(n) for n in extras if not include or n in include]
    return points.select("point_id", *out, F.col("d").alias("depth"))


def export_order(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points of the nodes in the order of the nodes' seq, then ord."""
    from .points import KEY
    from .select import broadcast_nodes

    return points.join(broadcast_nodes(nodes.select(*KEY, "seq")), KEY).orderBy("seq", "ord")


def sizes(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n"), (F.count("*") * BYTES_A_POINT).alias("memory_bytes"))


def dim_names(exported: DataFrame) -> DataFrame:
    """Distinct extra names with the components of the first point that has each."""
    e = exported.select("point_id", F.explode("extra").alias("name", "v"))
    return e.groupBy("name").agg(F.min_by(F.size("v"), F.col("point_id")).alias("components"))
