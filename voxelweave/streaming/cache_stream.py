"""The cache replay over a stream of node accesses, its state kept by session."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import voxel
from ..functions.geometry import Sphere, Vec, box_columns
from ..operators.cache import DEFAULT_BYTES, PER_POINT, Entry, PointCache

OUT = "session long, seq long, key string, hit boolean, evictions long, used_bytes long"
STATE = "keys array<string>, points array<long>, columns array<long>, accesses array<long>, counters array<long>"
_COUNTERS = ("used", "hits", "misses", "evictions", "version")


def replay_stream(log: DataFrame, max_bytes: int = DEFAULT_BYTES, per_point: int = PER_POINT) -> DataFrame:
    """log (session, seq, key, n_points), a stream; accesses of one micro-batch go in the order of seq.

    A session's state is its cached keys, at most max_bytes / 24 of them, never its points.
    """
    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        cache = PointCache(max_bytes, per_point)
        if state.exists:
            keys, *fields, counters = state.get
            cache.entries = OrderedDict((k, Entry(*map(int, own))) for k, *own in zip(keys, *fields))
            for name, v in zip(_COUNTERS, counters):
                setattr(cache, name, int(v))
        pdf = pd.concat(list(pdfs)).sort_values("seq")
        rows = []
        for q, k, n in zip(pdf["seq"], pdf["key"], pdf["n_points"]):
            hit = cache.get_or_load(k, int(n))
            rows.append((key[0], q, k, hit, cache.evictions, cache.used))
        held = cache.entries.values()
        state.update((list(cache.entries), [e.points for e in held], [e.columns for e in held], [e.accesses for e in held], [getattr(cache, n) for n in _COUNTERS]))
        yield pd.DataFrame(rows, columns=["session", "seq", "key", "hit", "evictions", "used_bytes"])

    return log.groupBy("session").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")


def stages_stream(nodes: DataFrame, center: Vec, radii: list[float]) -> DataFrame:
    """Nodes arriving as a stream, counted by the nearest ring that meets them: running totals, a row a ring."""
    hits = [F.when(Sphere(center, r).meets(box_columns()), F.lit(i)) for i, r in enumerate(radii)]
    ringed = nodes.withColumn("ring", F.coalesce(*hits)).where(F.col("ring").isNotNull())
    return ringed.groupBy("ring").agg(F.count("*").alias("node_count"), F.sum("point_count").alias("points"))


def with_bounds(nodes: DataFrame, octree: voxel.Octree) -> DataFrame:
    """Bounds and resolution of a stream or table of keys (d, kx, ky, kz)."""
    k = voxel.key(*[F.col(c) for c in ("d", "kx", "ky", "kz")])
    return nodes.select("*", *[c.alias(a) for a, c in voxel.bounds(k, octree).items()], voxel.resolution(F.col("d"), octree).alias("resolution"))
