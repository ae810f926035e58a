"""Choosing nodes: filters over the node table, which is small next to the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import voxel
from ..functions.geometry import Box, ClipFrustum, Frustum, Sphere, box_columns
from ..functions.voxel import Octree
from ..store import estimated_bytes

Shape = Box | Sphere | Frustum | ClipFrustum
MOST_BYTES = 64 << 20  # of a node table that is broadcast, as the optimizer estimates it; beyond, Spark shuffles


def fine_enough(wanted: float, cumulative: bool = False) -> Column:
    """Nodes at least as fine as wanted. They leave their coarse ancestors out, unless cumulative; 0: no condition."""
    return F.lit(True) if wanted <= 0 or cumulative else F.col("resolution") <= F.lit(float(wanted))


def node(nodes: DataFrame, d: int, x: int, y: int, z: int) -> DataFrame:
    return nodes.where((F.col("d") == d) & (F.col("kx") == x) & (F.col("ky") == y) & (F.col("kz") == z))


def layer(nodes: DataFrame, depth: int) -> DataFrame:
    if depth < 0:
        raise ValueError("a layer is not negative")
    return nodes.where(F.col("d") == depth)


def within(nodes: DataFrame, shape: Box | Sphere, resolution: float = 0, cumulative: bool = False) -> DataFrame:
    """Nodes that the shape holds whole."""
    return nodes.where(shape.has_box(box_columns()) & fine_enough(resolution, cumulative))


def meeting(nodes: DataFrame, shape: Shape, resolution: float = 0, cumulative: bool = False) -> DataFrame:
    return nodes.where(shape.meets(box_columns()) & fine_enough(resolution, cumulative))


def at_resolution(nodes: DataFrame, wanted: float, octree: Octree) -> DataFrame:
    """Only the one depth that first reaches the wanted resolution."""
    return layer(nodes, voxel.depth_at(wanted, octree))


def broadcast_nodes(nodes: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """nodes, marked for broadcast if they are small by the sizes of the files that they come from. No job is run."""
    return F.broadcast(nodes) if estimated_bytes(nodes) <= most else nodes
