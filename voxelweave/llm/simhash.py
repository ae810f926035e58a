"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments of 23, 23 and 18 bits; each is decoded in the perfect [23,12] Golay
code, whose every word lies within 3 bits of just one codeword. A segment's fuzzy keys are the codewords that
its neighbours within one bit decode to: one key, or six. Two segments within two bits share a key, since what
lies halfway is a neighbour of both. Up to 4 differing bits are dealt over the segments in one of two ways, and
each way has its joins, on keys of about 35 bits:

    some segment has none, then another has at most 2:   that one equal, the other by shared fuzzy keys
    each has one at least, then two have one each and    a half of each of the two equal (one half has no error),
    the third at most 2:                                 the third by shared fuzzy keys

What meets is verified by its Hamming distance. Equal fingerprints are one class first. In a bucket, every
member is first tried against the bucket's least member, components are formed, and only then members of
different components are tried against each other, so that a large group of near copies is linked by stars
instead of pairs. Components come from rounds of least-neighbour propagation with pointer jumping, each round
checkpointed; nothing is collected.

Defined cases. Null text: empty. A text without words has fingerprint zero. A null doc_id keeps its row and
never names a component (one whose ids are all null has none). Repeated rows link as equal fingerprints. A very long
text is hashed whole, its bits unpacked in parts. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, cut, documents, joined_words, lowered, partitions, release, slices, words_of

SHINGLE = 4
BITS = 4  # differing bits of a link
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and bits of each

#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value of the code).
_GENERATOR = 0b110001110101


@cache
def golay() -> np.ndarray:
    """The 12-bit codeword index of the one codeword within 3 bits of each 23-bit word."""
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1, _GENERATOR << (bit - 11), 0)
        return x

    one = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, dtype=np.int64), one]
    for _ in range(2):
        errors.append(np.unique((errors[-1][:, None] | one[None, :])[(errors[-1][:, None] & one[None, :]) == 0]))
    errors = np.concatenate(errors)
    leader = np.zeros(2048, dtype=np.int64)
    leader[syndrome(errors)] = errors
    out = np.empty(1 << 23, dtype=np.int16)
    for lo in range(0, 1 << 23, 1 << 19):
        words = np.arange(lo, lo + (1 << 19))
        out[lo : lo + (1 << 19)] = (words ^ leader[syndrome(words)]) >> 11
    return out


def fuzzy_keys(x: np.ndarray) -> np.ndarray:
    """For 23-bit words, 24 codeword indices each (those of the word and of its neighbours), many of them equal."""
    near = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    return golay()[x[:, None] ^ near[None, :]]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): fp the signed 64-bit value of the fingerprint, th a hash of the text that tells rows of one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = buffer_of(batch.column(1))
            data = lowered(data)
            starts, stops, docs_at = words_of(data, offsets)
            joined, at = joined_words(data, starts, stops)
            view = memoryview(joined.tobytes())
            n = np.diff(docs_at)
            count = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
            total = int(count.sum())
            begin = np.repeat(docs_at[:-1], count) + (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
            end = np.minimum(begin + shingle, np.repeat(docs_at[1:], count))
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(view[a:b], 42) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())), dtype=np.uint64, count=total)
            bits = np.zeros((len(n), 64), dtype=np.int64)
            first = np.cumsum(count) - count
            some = np.flatnonzero(count)
            for a in range(0, len(some), 512):  # unpacked bits of a few hundred documents at a time
                part = some[a : a + 512]
                lo, hi = first[part[0]], first[part[-1]] + count[part[-1]]
                for c in range(0, int(hi - lo), 1 << 19):
                    x, y = lo + c, min(lo + c + (1 << 19), hi)
                    ones = np.unpackbits(h[x:y].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    inside = part[(first[part] < y) & (first[part] + count[part] > x)]
                    np.add.at(bits, inside, np.add.reduceat(ones, np.maximum(first[inside] - x, 0), axis=0, dtype=np.int64))
            fp = np.packbits(2 * bits > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): fingerprints of at most BITS differing bits share a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                fp = np.asarray(whole.column(0).slice(lo, 20_000)).astype(np.int64).view(np.uint64)
                segment = [((fp >> np.uint64(64 - a - n)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
                halves = [(x >> (n // 2), x & ((1 << (n // 2)) - 1)) for x, (_, n) in zip(segment, SEGMENTS)]
                kind = 0
                for k in range(3):
                    fuzzy = np.sort(fuzzy_keys(segment[k]).astype(np.int64), axis=1)
                    r, c = np.nonzero(np.concatenate((np.ones((len(fp), 1), dtype=bool), fuzzy[:, 1:] != fuzzy[:, :-1]), axis=1))
                    near, of = fuzzy[r, c], pa.array(fp[r].view(np.int64))
                    i, j = (x for x in range(3) if x != k)
                    equal = [segment[i], segment[j], *((a << 12) | b for a in halves[i] for b in halves[j])]
                    for x in equal:
                        yield pa.RecordBatch.from_arrays([pa.array((((x[r] << 12) | near) << 5) | kind), of], names=["key", "fp"])
                        kind += 1

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, root): the least fp that links reach from each node; edges (a, b) over nodes (fp).

    Rounds: everyone takes the least root among its own and its neighbours', then jumps to its root's root,
    until a round changes nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    linked = cut(both.select(F.col("a").alias("fp")).distinct().withColumn("root", F.col("fp")))
    while True:
        # hooking: the roots that a link joins, the greater onto the least it meets
        ra = both.join(linked.select(F.col("fp").alias("a"), F.col("root").alias("ra")), "a").join(linked.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b")
        hooks = ra.where("rb < ra").groupBy(F.col("ra").alias("root")).agg(F.min("rb").alias("to"))
        hooks = cut(hooks)
        if hooks.isEmpty():
            release(both, hooks)
            break
        # a chain of hooks is followed to its end by jumping
        while True:
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("up"))
            jumped = cut(hooks.select("root", "to").join(up, "to", "left").select("root", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")))
            release(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        before, linked = linked, cut(linked.join(hooks.select("root", "to"), "root", "left").select("fp", F.coalesce("to", "root").alias("root")))
        release(before, hooks)
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def buckets(fps: DataFrame) -> DataFrame:
    """A written table (key, fp, low): the keys that several of the distinct fingerprints (fp) have, with the least of these."""
    # one shuffle serves both the count of a bucket and the join with it; most buckets hold one fingerprint
    keys = _keys(fps.repartition(partitions(fps.sparkSession))).repartition("key")
    least = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    return cut(keys.join(least.where("low < high").select("key", "low"), "key"))


def stars(full: DataFrame) -> DataFrame:
    """(a, b): links of the least of each bucket with its other members."""
    return full.where((F.col("fp") != F.col("low")) & _near(F.col("fp"), F.col("low"))).select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def link(fps: DataFrame) -> DataFrame:
    """(fp, root) of distinct fingerprints (fp): those that links of at most BITS bits join have one root."""
    full = buckets(fps)
    roots = cut(components(stars(full), fps))
    # then only what the stars have not joined already
    known = cut(full.select("key", "fp").join(roots, "fp").select("key", "fp", "root"))
    mixed = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    busy = cut(known.join(mixed, "key", "left_semi"))
    release(full, known)
    left, right = busy.toDF("key", "a", "ra"), busy.toDF("key2", "b", "rb")
    meets = (F.col("key") == F.col("key2")) & (F.col("ra") < F.col("rb")) & _near(F.col("a"), F.col("b"))
    rest = left.join(right, meets).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    merged = components(rest, roots.select(F.col("root").alias("fp")).distinct())
    return roots.join(merged.toDF("root", "top"), "root").select("fp", F.col("top").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row, as the pipeline groups them: by Golay keys and the exact similarity of 5-word shingles."""
    from . import similar  # which takes components() from here

    return similar.near_copies(docs)


def fingerprint_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row, linked by at most BITS differing bits of their fingerprints."""
    rows = cut(fingerprints(docs, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut(link(classes.select("fp")).join(classes, "fp"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
