"""Near copies by Golay-code fuzzy hashing and the Jaccard similarity of their sets of words' shingles, exact.

A document's set holds the 64-bit hashes of its distinct runs of SHINGLE words (ASCII case ignored; a shorter text
is one run). Its fingerprint has a bit of the least hash in each of 64 ranges (one-bit MinHash), so that sets of
similarity s agree in about (1 + s) / 2 of the bits, and fingerprints that share a Golay key (see simhash.py) propose
links: within 4 bits, the least of each bucket with the others.

What more than 4 bits part is found by a prefix filter. Two sets of similarity LEAST share at least LEAST of either, so that in any one order of all shingles
their prefixes of n // 5 + 1 shingles have one in common: no pair is missed, whatever the order. The order is by
hash, but for shingles that are frequent in a sample, which come last, the most frequent at the very end, so that
passages that many documents share fill no bucket. Documents that share a prefix shingle are compared set with set
(by 32 bits of each hash), unless the parities of their hashes in ODD places (odd sketches) already differ in more
places than the sets may in shingles.

Equal sets are one class first (known by 64 bits). In a bucket every member first meets the bucket's least; of what a
class meets so, there and by Golay keys, only the likeliest is compared set with set, which links most. Components are formed, and then all
that share a bucket over different components meet. Long texts share hundreds of buckets: a pair meets in one only if
none of the last BEFORE keys of either is one of the other's, so hardly more than once, and always in the first.

Defined cases. Null text: empty. Texts without words are alike. A null doc_id keeps its row and never names a
component (one whose ids are all null has none). Repeated rows are one class. A very long text's set is one row. No
rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, buffer_of, cut, lowered, mix, release, sized, slices, word_hashes, words_of
from .simhash import buckets, components, stars

SHINGLE = 5
SAMPLE = 8  # one in so many texts is counted for the frequent shingles
FREQUENT = 1 << 16  # frequent shingles that are told apart
MOST = 1 << 18  # rows of a broadcast
ODD = 512  # parities of a set
BEFORE = 16  # keys that a row of a bucket knows of those before its own

_GRAMS = Rolling(73)


def shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in the order of their hashes, and the offsets of the texts among them."""
    data, offsets = buffer_of(column)
    starts, stops, at = words_of(data, offsets)
    words = word_hashes(lowered(data), starts, stops, 71)
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
    doc = np.repeat(np.arange(len(n)), count)
    begin = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    h = _GRAMS.spans(_GRAMS.prefix(words), begin, np.minimum(begin + shingle, at[1:][doc]))
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and the place of each in the order, the most frequent being last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, edge = shingles(batch.column(0), shingle)
            n = np.diff(edge)
            low = np.arange(len(h)) - np.repeat(edge[:-1], n) <= np.repeat(n // 2, n)  # the others hardly come into a prefix
            h, c = np.unique(h[low], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    # a text counts once: its copies are one class
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct().mapInArrow(run, "h long, c long")
    found = some.groupBy("h").agg(F.sum("c").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # a fixed number of rows
    keys = np.asarray(found.column("h")).astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], len(keys) - by


def sketches(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, h[edge[i]:edge[i+1]] being its hashes in order: a bit of the least hash in each 64th
    of their range, or where that is empty, another bit of the next one's. No hashes: zero."""
    n = len(edge) - 1
    cell = np.repeat(np.arange(n), np.diff(edge)) * 64 + (h >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    low, there = np.zeros(64 * n, dtype=np.uint64), np.zeros(64 * n, dtype=bool)
    low[cell[first]], there[cell[first]] = mix(h[first]), True
    low, there, far = low.reshape(n, 64), there.reshape(n, 64), np.zeros((n, 64), dtype=np.uint64)
    for k in range(126, -1, -1):  # around once
        i, j = k % 64, (k + 1) % 64
        low[:, i] = np.where(there[:, i], low[:, i], low[:, j])
        far[:, i] = np.where(there[:, i], 0, far[:, j] + np.uint64(1))
    bits = (low >> (far & np.uint64(63))) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp, sk, n, odd, pre, sh): of each row the class of its set, its fingerprint, its size, its parities, its prefix, and 32 bits of each shingle."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, shingle))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, place = known.value
        for batch in slices(batches):
            h, edge = shingles(batch.column(1), shingle)
            n = np.diff(edge)
            doc = np.repeat(np.arange(len(n)), n)
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(h), dtype=np.uint64)))
            fp = mix(total[edge[1:]] - total[edge[:-1]] + n.astype(np.uint64))
            bits = np.bincount(doc * ODD + (h & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD * len(n)).astype(np.uint8) & 1
            odd = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(bits).view(np.int64)), ODD // 64).cast(pa.list_(pa.int64()))
            late = np.zeros(len(h), dtype=np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                late = np.where(keys[i] == h, place[i], 0)
            order = np.argsort(doc * (FREQUENT + 1) + late, kind="stable")
            pick = order[np.arange(len(h)) - np.repeat(edge[:-1], n) <= n[doc] // 5]
            pre = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[pick], minlength=len(n))))).astype(np.int32)), pa.array(h[pick].view(np.int64)))
            sh = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64)), pa.array(sketches(h, edge).view(np.int64)), pa.array(n.astype(np.int32)), odd, pre, sh], names=["doc_id", "th", "fp", "sk", "n", "odd", "pre", "sh"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return docs.mapInArrow(run, "doc_id long, th long, fp long, sk long, n int, odd array<long>, pre array<long>, sh array<int>")


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """A written table of the pairs (a, b, ...) of distinct classes that sizes and parities don't rule out, with differ, the parities that differ."""
    met = cut(pairs)  # a written table leaves the joins free to split a hot class
    pairs = met
    for x in "ab":
        pairs = pairs.join(reps.select("fp", "n", "odd").toDF(x, f"n{x}", f"o{x}"), x)
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = cut(pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").withColumn("differ", differ).where("9 * differ <= na + nb").drop("na", "nb", "oa", "ob"))
    release(met)
    return pairs


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of a written table of pairs (a, b, ...), those whose sets have a similarity of 0.8 or more."""
    for x in "ab":  # only sets that are asked for are shuffled
        ids = sized(pairs.select(F.col(x).alias("fp")).distinct(), "ids", MOST)
        own = reps.select("fp", "sh").join(ids, "fp", "left_semi").toDF(x, f"s{x}")
        pairs = pairs.join(own, x)
    # o / (a + b - o) >= 4 / 5
    return pairs.where("9 * size(array_intersect(sa, sb)) >= 4 * (size(sa) + size(sb))").drop("sa", "sb")


def proposed(reps: DataFrame) -> DataFrame:
    """A written table (a, b): pairs of classes whose fingerprints are equal or share a Golay key and lie within 4 bits, as stars."""
    least = cut(reps.groupBy("sk").agg(F.min("fp").alias("a")))
    own = reps.select("sk", F.col("fp").alias("b"))
    full = buckets(least.select(F.col("sk").alias("fp")))
    near = stars(full).toDF("x", "sk").join(least.withColumnRenamed("sk", "x"), "x").join(own, "sk").select("a", "b")
    pairs = own.join(least, "sk").where("a != b").select("a", "b").unionByName(near)
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(full, least)
    return pairs


def meetings(busy: DataFrame, reps: DataFrame) -> DataFrame:
    """A written table (a, b, ra, rb): the pairs of classes of busy, (key, fp, n, root), that share a key over different roots, unless
    sizes and parities rule them out. Each is there at least once."""
    # parities go along, so that the join itself leaves few pairs
    words = range(ODD // 64)
    parities = reps.select("fp", *[F.get("odd", F.lit(i)).alias(f"o{i}") for i in words])
    last = F.collect_list("key").over(Window.partitionBy("fp").orderBy("key").rowsBetween(-BEFORE, -1))
    rows = cut(busy.withColumn("last", last).join(parities, "fp"))
    left = rows.select("key", F.col("fp").alias("a"), "n", F.col("root").alias("ra"), "last", *[F.col(f"o{i}").alias(f"p{i}") for i in words])
    right = rows.select(F.col("key").alias("key2"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"), F.col("last").alias("last2"), *[F.col(f"o{i}").alias(f"q{i}") for i in words])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in words), F.lit(0))
    meets = (F.col("key") == F.col("key2")) & (F.col("ra") < F.col("rb")) & F.expr("5 * least(n, m) >= 4 * greatest(n, m)") & (9 * differ <= F.col("n") + F.col("m"))
    pairs = cut(left.join(right, meets & ~F.arrays_overlap("last", "last2")).select("a", "b", "ra", "rb"))
    release(rows)
    return pairs


def link(reps: DataFrame) -> DataFrame:
    """(fp, root) of classes (fp, sk, n, odd, pre, sh): those that links of similarity 0.8 or more join have one root."""
    golay = proposed(reps)
    # one shuffle serves both the least of a bucket and the join with it; most buckets hold one class
    keys = reps.select(F.explode("pre").alias("key"), "fp", "n").repartition("key")
    least = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    full = cut(keys.join(least.where("low < high").select("key", "low"), "key"))
    met = plausible(full.where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b")).unionByName(golay).distinct(), reps)
    release(golay)
    likeliest = cut(met.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b"))
    links = cut(verified(likeliest, reps).select("a", "b"))
    release(likeliest)
    roots = cut(components(links, reps.select("fp")))
    root = lambda x: roots.toDF(x, f"r{x}")
    others = met.select("a", "b").join(root("a"), "a").join(root("b"), "b").where("ra != rb").select("a", "b", "ra", "rb")
    known = cut(full.join(roots, "fp").where("fp != low"))
    mixed = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    busy = cut(known.join(mixed, "key", "left_semi").select("key", "fp", "n", "root"))
    release(full, known, links)
    again = meetings(busy, reps)
    rest = cut(verified(cut(others.unionByName(again).distinct()), reps).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    release(met, busy, again)
    merged = components(rest, roots.select(F.col("root").alias("fp")).distinct())
    return roots.join(merged.toDF("root", "top"), "root").select("fp", F.col("top").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row."""
    rows = cut(sets(docs).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("rep"), F.count("*").alias("rows")))
    copies = rows.select("fp", "row").join(classes.where("rows > 1").select("fp", "rep"), "fp").where("row != rep").select("row")
    reps = rows.join(sized(cut(copies), "copies", MOST), "row", "left_anti").select("fp", "sk", "n", "odd", "pre", "sh")
    roots = cut(link(reps).join(classes.select("fp", "first"), "fp"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return rows.select("doc_id", "th", "fp").join(named, "fp").select("doc_id", "th", "fp", "component_id")
