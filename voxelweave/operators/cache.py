"""What a point cache with a byte budget and least-recently-used eviction would do over a log of node accesses.

The order of accesses matters, so a bounded cache is a fold over the log, by session; a log row is a node
access, not a point, and sessions run in parallel. A cache that never evicts needs no fold: a first access misses,
any later one hits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = 24  # bytes of an entry, or of an array, besides its points
PER_POINT = 100
VECTOR, NUMBER = 16, 4  # bytes a point of a position, colour or normal, and of a depth or an extra dimension
DEFAULT_BYTES = 512 << 20


def separated_size(n_points: int, vectors: int = 2, numbers: int = 1) -> int:
    """Bytes of a node's columns: vectors (positions and colours, with normals three) and numbers (depth and extra dimensions)."""
    return vectors * (ENTRY + VECTOR * n_points) + numbers * (ENTRY + NUMBER * n_points)


def separated_bytes(n_points: Column, vectors: int = 2, numbers: int = 1) -> Column:
    """separated_size() of a column of counts."""
    return F.lit(ENTRY * (vectors + numbers)) + n_points * (VECTOR * vectors + NUMBER * numbers)


@dataclass
class Entry:
    points: int  # bytes of the points as rows, 0 if there are columns only
    columns: int = 0  # bytes of the separated columns
    accesses: int = 1

    @property
    def bytes(self) -> int:
        return self.points + self.columns


class PointCache:
    """Counters and order of the cache; entries hold their sizes only. Once closed, it takes no more calls."""

    def __init__(self, max_bytes: int = DEFAULT_BYTES, per_point: int = PER_POINT):
        if max_bytes <= 0 or per_point <= 0:
            raise ValueError("sizes must be positive")
        self.max_bytes, self.per_point = max_bytes, per_point
        self.entries: OrderedDict[object, Entry] = OrderedDict()  # least recent first
        self.used = self.hits = self.misses = self.evictions = self.version = 0

    def __enter__(self) -> "PointCache":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Lets go of everything; a second time does nothing."""
        self.entries, self.used = None, 0

    def size(self, n_points: int) -> int:
        return ENTRY + n_points * self.per_point

    def contains(self, key: object) -> bool:
        """Touches neither order nor counters."""
        return key in self.entries

    def get(self, key: object) -> bool:
        if key in self.entries:
            self.entries.move_to_end(key)
            self.entries[key].accesses += 1
            self.hits += 1
            return True
        self.misses += 1
        return False

    def remove(self, key: object) -> bool:
        if key not in self.entries:
            return False
        self.used -= self.entries.pop(key).bytes
        self.version += 1
        return True

    def clear(self) -> None:
        self.entries.clear()
        self.used = 0
        self.version += 1

    def _make_room(self, size: int) -> None:
        while self.used + size > self.max_bytes and self.entries:
            _, old = self.entries.popitem(last=False)
            self.used -= old.bytes
            self.evictions += 1
            self.version += 1

    def put(self, key: object, n_points: int, columns: int = 0) -> bool:
        """An entry over the whole budget is refused, and a stale one under its key stays. columns: bytes of separated
        columns that come along; they count, but aren't asked for before there is room for the points."""
        size = self.size(n_points)
        if size > self.max_bytes:
            return False
        if key in self.entries:
            self.used -= self.entries.pop(key).bytes
        self._make_room(size)
        self.entries[key] = Entry(size, columns)
        self.used += size + columns
        return True

    def put_separated(self, key: object, n_points: int, vectors: int = 2, numbers: int = 1) -> bool:
        """An entry of columns only. Unlike put(), the stale entry goes and room is made before an oversize one is refused."""
        size = separated_size(n_points, vectors, numbers)
        if key in self.entries:
            self.used -= self.entries.pop(key).bytes
        self._make_room(size)
        if size > self.max_bytes:
            return False
        self.entries[key] = Entry(0, size)
        self.used += size
        return True

    def get_or_load(self, key: object, n_points: int) -> bool:
        """Whether it was a hit; a miss loads, puts and counts a version, even if refused."""
        if self.get(key):
            return True
        self.put(key, n_points)
        self.version += 1
        return False

    def get_or_load_batch(self, batch: list[tuple[object, int]]) -> list[tuple[object, int]]:
        """Hits first, then the loaded misses; one version for the batch if anything was loaded."""
        hits, missing = [], []
        for key, n in batch:
            (hits if self.get(key) else missing).append((key, n))
        for key, n in missing:
            self.put(key, n)
        self.version += bool(missing)
        return hits + missing

    def _missing(self, batch: list[tuple[object, int]]) -> list[tuple[object, int]]:
        return [(k, n) for k, n in batch if not self.contains(k) and n > 0]

    def update(self, batch: list[tuple[object, int]]) -> int:
        """Warms what is neither cached nor empty; one version in all."""
        new = self._missing(batch)
        for k, n in new:
            self.put(k, n)
        self.version += bool(new)
        return len(new)

    def update_separated(self, batch: list[tuple[object, int]], vectors: int = 2, numbers: int = 1, only: bool = True) -> int:
        """As update(), with columns; only: and without the points as rows."""
        new = self._missing(batch)
        for k, n in new:
            if only:
                self.put_separated(k, n, vectors, numbers)
            else:
                self.put(k, n, separated_size(n, vectors, numbers))
        self.version += bool(new)
        return len(new)

    def touch(self, key: object) -> None:
        """An export reads an entry's columns: it becomes the most recent one, without counting as a lookup."""
        self.entries.move_to_end(key)

    def stats(self) -> dict:
        looked = self.hits + self.misses
        return {
            "entries": len(self.entries), "used_bytes": self.used, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "version": self.version,
            "hit_rate": 100.0 * self.hits / looked if looked else 0.0, "used_percent": 100.0 * self.used / self.max_bytes,
        }


def replay(log: DataFrame, max_bytes: int = DEFAULT_BYTES, per_point: int = PER_POINT) -> DataFrame:
    """log (session, seq, key, n_points) to (session, seq, key, hit, evictions, used_bytes, entries) after each access."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, session = None, None
        for batch in batches:
            rows = []
            for s, k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if cache is None or s != session:
                    cache, session = PointCache(max_bytes, per_point), s
                hit = cache.get_or_load(k, n)
                rows.append((hit, cache.evictions, cache.used, len(cache.entries)))
            more = [pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 4, (pa.bool_(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], names=["session", "seq", "key", "hit", "evictions", "used_bytes", "entries"])

    # sorted partitions stream through the fold: a session is never gathered
    log = log.select("session", "seq", "key", "n_points").repartition("session").sortWithinPartitions("session", "seq")
    return log.mapInArrow(fold, "session long, seq long, key string, hit boolean, evictions long, used_bytes long, entries long")


def unbounded(log: DataFrame) -> DataFrame:
    """log with hit, for a cache that never evicts."""
    return log.withColumn("hit", F.row_number().over(Window.partitionBy("session", "key").orderBy("seq")) > 1)


def cached_nodes(log: DataFrame) -> DataFrame:
    """Without eviction: the cached keys, most recent first."""
    last = log.groupBy("session", "key").agg(F.max("seq").alias("last"), F.count("*").alias("accesses"), F.max("n_points").alias("n_points"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("last")))).withColumn("bytes", F.lit(ENTRY) + F.col("n_points") * PER_POINT)
