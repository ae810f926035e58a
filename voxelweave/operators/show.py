"""Points, nodes and shapes as lines of text, for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import voxel


def _number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def point_line(colour: bool = False, distance: Column | None = None, extras: dict[str, Column] | None = None) -> Column:
    """"X, Y, Z", then the colour (1.0 where missing), the distance and the extra dimensions, as asked for."""
    parts = [F.concat(F.lit("("), F.concat_ws(", ", *[_number(F.col(c), 3) for c in "XYZ"]), F.lit(")"))]
    if colour:
        parts.append(F.concat(F.lit("RGB("), F.concat_ws(", ", *[_number(F.coalesce(F.col(c), F.lit(1.0)), 3) for c in ("red", "green", "blue")]), F.lit(")")))
    if distance is not None:
        parts.append(F.concat(F.lit("distance "), _number(distance, 2)))
    for name, c in (extras or {}).items():
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), _number(c, 2))))
    return F.concat_ws(" ", *parts)


def node_line() -> Column:
    k = voxel.key(*[F.col(c) for c in ("d", "kx", "ky", "kz")])
    corner = lambda n: F.concat(F.lit("("), F.concat_ws(", ", *[_number(F.col(f"{n}_{a}"), 3) for a in "xyz"]), F.lit(")"))
    return F.concat(voxel.text(k), F.lit(": "), F.col("point_count").cast("string"), F.lit(" points, "), corner("min"), F.lit(" to "), corner("max"))


def head(df: DataFrame, n: int, line: Column, by: list[str]) -> DataFrame:
    """The lines of the first n rows in the order of `by`."""
    return df.orderBy(*by).limit(n).select(*by, line.alias("line"))
