"""Suffix-array dedup with a logarithmic family of suffix arrays over bytes.

The contexts of all classes of repeated anchors (see repeats.py) are dealt to shards by anchor, so that equal
strings meet in one shard. A shard takes its contexts in batches of BATCH bytes: a batch gets the suffix array of
its windows (prefix doubling up to WINDOW bytes), in which equal neighbours are long matches; then it is
merge-scanned against every level for the windows that it shares with them; then its new windows become a level,
and levels of about one size merge, so that a shard of n batches keeps log n levels. A window counts once, or
twice where its class has further members, and is removed if its count passes one: in its own batch, or when a
later batch meets it. Nothing else removes a byte.

Shards hold about SHARD bytes of contexts and are worked on one after another, so that memory doesn't grow with
the data.

Defined cases. Null text: empty. A text under WINDOW bytes keeps all. A very long text is hashed in blocks, and its
contexts are as short as any other's. Removed bytes may cut a UTF-8 character: kept is binary. Rows with one doc_id
and one text are one document, whose copies do not count as another place; if a doc_id repeats with other texts,
or is null, documents go by (doc_id, hash of the text). No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, cut, documents, partitions, release, slices
from .repeats import Scanner, byte_units, candidates, contexts, keyed, spans_of, steered

WINDOW = 400
GRAM = 48
SHARD = 6 << 20  # bytes of contexts in a shard, about
BATCH = 1 << 20


def _heads(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, so that numbers order as the bytes do. text ends in 8 spare bytes."""
    every = np.ndarray((len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))
    return every[at].astype(np.uint64)


def suffix_array(text: np.ndarray, starts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the w-byte windows at starts, and a rank of each (equal windows: equal ranks).

    text ends in w + 8 spare bytes. Prefix doubling: the rank of a place is the number of places before its group;
    ranks of k bytes give those of up to 2k, and only groups of several places are sorted again.
    """
    n = len(text) - 8
    k = min(8, w)
    key = _heads(text, np.arange(n)) >> np.uint64(8 * (8 - k))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    alone = new & np.concatenate((new[1:], [True]))
    open_ = order[~alone]
    while k < w and len(open_):
        step = min(k, w - k)
        old = rank[open_]
        key = old * (n + 1) + rank[np.minimum(open_ + step, n - 1)]
        order = np.argsort(key)
        key, old, open_ = key[order], old[order], open_[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        i = np.arange(len(key))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), i, 0))
        rank[open_] = old + np.maximum.accumulate(np.where(new, i, 0)) - group
        open_ = open_[~(new & np.concatenate((new[1:], [True])))]
        k += step
    own = rank[starts]
    return np.argsort(own, kind="stable"), own


class Level:
    """Distinct windows in the order of their bytes: places in text, places among all contexts of the shard, the
    eight bytes that each starts with, and whether it counts once only."""

    def __init__(self, text: np.ndarray, at: np.ndarray, pos: np.ndarray, head: np.ndarray, alone: np.ndarray):
        self.text, self.at, self.pos, self.head, self.alone = text, at, pos, head, alone

    def merge_scan(self, other: "Level", w: int) -> tuple[np.ndarray, np.ndarray]:
        """For the windows of another level: where each would stand in this one, and whether the window there is equal.

        Both are in order: one pass over the heads leaves each window a range of this level with its first eight
        bytes, which the next sixteen narrow; what is left is halved by comparing whole windows.
        """
        lo, hi = np.searchsorted(self.head, other.head, "left"), np.searchsorted(self.head, other.head, "right")
        equal = np.zeros(len(lo), dtype=bool)
        open_ = np.flatnonzero(lo < hi)
        for step in range(8, min(24, w - 7), 8):
            head = _heads(other.text, other.at[open_] + step)
            lo[open_], hi[open_] = self._bound(lo[open_], hi[open_], step, head, False), self._bound(lo[open_], hi[open_], step, head, True)
            open_ = open_[lo[open_] < hi[open_]]
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            sign = self._compare(mid, other, open_, w)
            equal[open_[sign == 0]] = True
            lo[open_] = np.where(sign < 0, mid + 1, np.where(sign == 0, mid, lo[open_]))
            hi[open_] = np.where(sign < 0, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo, equal

    def _bound(self, lo: np.ndarray, hi: np.ndarray, step: int, value: np.ndarray, after: bool) -> np.ndarray:
        """Within [lo, hi), whose windows agree up to step: the first whose next eight bytes aren't before value (after: are after it)."""
        lo, hi = lo.copy(), hi.copy()
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) // 2
            head = _heads(self.text, self.at[mid] + step)
            right = head <= value[busy] if after else head < value[busy]
            lo[busy] = np.where(right, mid + 1, lo[busy])
            hi[busy] = np.where(right, hi[busy], mid)
            busy = busy[lo[busy] < hi[busy]]
        return lo

    def _compare(self, mine: np.ndarray, other: "Level", its: np.ndarray, w: int) -> np.ndarray:
        """-1, 0, 1: this level's windows `mine` before, equal to, after the other's `its`."""
        sign, open_ = np.zeros(len(mine), dtype=np.int8), np.arange(len(mine))
        for col in (np.arange(min(w, 48)), np.arange(48, w)):  # most differ early
            for x in range(0, len(open_) if len(col) else 0, 1024):
                some = open_[x : x + 1024]
                a = self.text[self.at[mine[some], None] + col].astype(np.int16)
                a -= other.text[other.at[its[some], None] + col]
                sign[some] = np.sign(a[np.arange(len(a)), (a != 0).argmax(1)])
            open_ = open_[sign[open_] == 0]
        return sign


class Levels:
    """Logarithmic family: add() takes a batch of contexts and notes the windows that count more than once."""

    def __init__(self, w: int):
        self.w, self.levels = w, []
        self.size = 0  # bytes of all contexts so far
        self.found: list[np.ndarray] = []  # places of such windows among them

    def add(self, data: np.ndarray, offsets: np.ndarray, many: np.ndarray) -> None:
        """Contexts data[offsets[i]:offsets[i+1]]; many: whether their class has further members."""
        w = self.w
        text = np.concatenate((data, np.zeros(w + 8, dtype=np.uint8)))
        count = np.diff(offsets) - w + 1
        which = np.repeat(np.arange(len(count)), count)
        at = offsets[:-1][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        order, rank = suffix_array(text, at, w)
        at, rank, weight = at[order], rank[order], 1 + many[which[order]].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        times = np.add.reduceat(weight, first)
        self.found.append(at[np.repeat(times > 1, np.diff(np.append(first, len(at))))] + self.size)
        at = at[first]
        new = Level(text, at.astype(np.int32), (at + self.size).astype(np.int32), _heads(text, at) >> np.uint64(8 * max(0, 8 - w)), times == 1)
        fresh = np.ones(len(at), dtype=bool)
        for level in self.levels:
            place, equal = level.merge_scan(new, w)
            mine, theirs = np.flatnonzero(equal), place[equal]
            self.found += [new.pos[mine[new.alone[mine]]], level.pos[theirs[level.alone[theirs]]]]
            level.alone[theirs] = False
            fresh[mine] = False
        self.size += len(data)
        self.levels.append(Level(text, *(x[fresh] for x in (new.at, new.pos, new.head, new.alone))))
        while len(self.levels) > 1 and len(self.levels[-2].at) < 2 * max(1, len(self.levels[-1].at)):
            b, a = self.levels.pop(), self.levels.pop()
            place, _ = a.merge_scan(b, w)
            b.at += np.int32(len(a.text))
            self.levels.append(Level(np.concatenate((a.text, b.text)), *(np.insert(getattr(a, k), place, getattr(b, k)) for k in ("at", "pos", "head", "alone"))))

    def runs(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows found as runs (context, first start, last start); offsets: of all contexts of the shard."""
        pos = np.sort(np.concatenate([x.astype(np.int64) for x in self.found]))
        own = np.searchsorted(offsets, pos, side="right") - 1
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (pos[1:] > pos[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1 if len(first) else first
        begin = offsets[own[first]]
        return own[first], pos[first] - begin, pos[last] - begin


_RUNS = "array<struct<a:int,b:int>>"


def _matched(docs: DataFrame, classes: DataFrame, scanner: Scanner) -> DataFrame:
    """(ah, ch, key, lo, first, later): the runs [a, b] of repeated windows of each class, from the start of its context."""
    w = scanner.w
    spark = docs.sparkSession
    size = classes.agg(F.sum(F.col("more").cast("long") + w)).first()[0] or 0
    shards = -(-size // (SHARD * partitions(spark)))  # of a partition
    kind = docs.schema["key"].dataType.simpleString()

    def answer(levels: Levels, heads: list[pa.RecordBatch], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(heads).combine_chunks()
        rec, a, b = levels.runs(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))
        edges = np.concatenate(([0], np.cumsum(np.bincount(rec, minlength=rows.num_rows)))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"]))
        some = pa.array(np.flatnonzero(np.diff(edges)))
        out = pa.Table.from_arrays([*(rows.column(k).take(some) for k in ("ah", "ch", "key", "lo")), runs.take(some), runs.take(some)], names=["ah", "ch", "key", "lo", "first", "later"])
        yield from out.to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, heads, sizes, shard = Levels(w), [], [], None
        for whole in slices(batches, "ctx", BATCH):
            of = np.asarray(whole.column(6))
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:]):
                batch = whole.slice(x, y - x)
                if heads and of[x] != shard:
                    yield from answer(levels, heads, sizes)
                    levels, heads, sizes = Levels(w), [], []
                shard = of[x]
                data, offsets = buffer_of_binary(batch.column(5))
                levels.add(data, offsets, np.asarray(batch.column(4).to_numpy(False)))
                heads.append(batch.select([0, 1, 2, 3]))
                sizes.append(np.diff(offsets))
        if heads:
            yield from answer(levels, heads, sizes)

    rows = contexts(docs, classes, scanner).withColumn("shard", F.pmod(F.shiftright("ah", 20), F.lit(shards or 1)).cast("int")).repartition(partitions(spark), "ah")
    if shards > 1:
        rows = rows.sortWithinPartitions("shard")
    return rows.mapInArrow(run, f"ah long, ch long, key {kind}, lo int, first {_RUNS}, later {_RUNS}")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, r): the runs (lo, hi) of windows of each keyed document that also start elsewhere."""
    scanner = steered(docs, Scanner(byte_units, window, min(gram, window), 31))
    again, classes = candidates(docs, scanner)
    found = cut(_matched(docs, classes, scanner))
    release(classes)
    each = spans_of(again, found).select("key", "lo", F.explode("f").alias("f"))
    lists = cut(each.groupBy("key").agg(F.collect_list(F.struct((F.col("lo") + F.col("f.a")).alias("lo"), (F.col("lo") + F.col("f.b")).alias("hi"))).alias("r")))
    release(again, found)
    return lists


def buffer_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): kept is the binary rest, spans the removed runs [start, end) in bytes."""
    rows, docs = keyed(docs)
    lists = repeated(docs, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = buffer_of(batch.column(1))
            r = batch.column(2)
            doc = np.repeat(np.arange(len(r)), np.diff(np.asarray(r.offsets)))
            flat = r.flatten()
            change = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(change, at[:-1][doc] + np.asarray(flat.field(0)), 1)
            np.add.at(change, at[:-1][doc] + np.asarray(flat.field(1)) + window, -1)
            gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            kept, removed, spans = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                g = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                kept.append(data[a:b][~g].tobytes())
                removed.append(int(g.sum()))
                spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.join(lists, "key", "left").select("key", "text", "r", "doc_id").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def op2_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, {2 * WINDOW})) AS win
  FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - {WINDOW - 1})) AS s FROM d WHERE length(x) >= {2 * WINDOW})
), m AS (
  SELECT win FROM w GROUP BY win HAVING count(*) > 1
), r AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w SEMI JOIN m USING (win)
), g AS (
  SELECT doc_id, s, sum(CASE WHEN s <= before + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM r
), p AS (
  SELECT doc_id, k, min(s) AS a, max(s) + {WINDOW} AS b, lag(max(s) + {WINDOW}, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM g GROUP BY doc_id, k
), q AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY k) AS kept
  FROM p JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
