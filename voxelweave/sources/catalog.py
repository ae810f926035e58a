"""The attributes that a file of each point format has, as a table; no point is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that a file may have; of 4, 5, 9 and 10 only the common attributes are known.
FORMATS = tuple(range(11))
#: name, type, least, greatest, what it is (fixed values of the file format)
COMMON = (
    ("X", "double", None, None, "easting, scaled"),
    ("Y", "double", None, None, "northing, scaled"),
    ("Z", "double", None, None, "height, scaled"),
    ("Intensity", "uint16", 0.0, 65535.0, "strength of the return"),
    ("ReturnNumber", "uint8", 1.0, 15.0, "which return of its pulse"),
    ("NumberOfReturns", "uint8", 1.0, 15.0, "returns of its pulse"),
    ("Classification", "uint8", 0.0, 255.0, "class of the point"),
    ("ScanAngle", "float32", -180.0, 180.0, "angle of the scan, degrees"),
    ("UserData", "uint8", 0.0, 255.0, "free for the user"),
    ("PointSourceId", "uint16", 0.0, 65535.0, "flight line or file"),
)
GPS = (("GpsTime", "double", None, None, "time of the pulse"),)
RGB = tuple((c, "uint16", 0.0, 65535.0, f"{c.lower()} of the colour") for c in ("Red", "Green", "Blue"))
NIR = (("NIR", "uint16", 0.0, 65535.0, "near infrared"),)
FLAGS = (("ScanDirectionFlag", "uint8", 0.0, 1.0, "direction of the mirror"), ("EdgeOfFlightLine", "uint8", 0.0, 1.0, "last point of a scan line"))


def attributes_of(point_format: int) -> list[tuple]:
    """(name, type, components, least, greatest, required, description) of a format; every attribute is required."""
    if point_format not in FORMATS:
        raise ValueError(f"unknown point format {point_format}")
    out = list(COMMON)
    if point_format in (1, 3, 6, 7, 8):
        out += GPS
    if point_format in (2, 3, 7, 8):
        out += RGB
    if point_format == 8:
        out += NIR
    if point_format in (6, 7, 8):
        out += FLAGS
    return [(name, kind, 1, low, high, True, text) for name, kind, low, high, text in out]


SCHEMA = "point_format int, name string, kind string, components int, least double, greatest double, required boolean, description string"


def all_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, *a) for f in FORMATS for a in attributes_of(f)], SCHEMA)


def attribute(table: DataFrame, name: str) -> DataFrame:
    """By name, whatever its case."""
    return table.where(F.lower("name") == name.lower())
