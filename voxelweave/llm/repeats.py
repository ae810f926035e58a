"""Where a window of symbols occurs again: the candidate search that both substring operators share.

Each window of W symbols has an anchor, one of its G-symbol grams: not one of the grams that are frequent in the
corpus if there is another, and of these the one with the least hash, the leftmost if it repeats. Equal windows
have equal anchors at equal places, so that windows need to be compared under equal anchors only; and as frequent
grams are avoided, windows that reach beyond a passage that many documents share meet under rarer ones. A
document's consecutive windows with one anchor are a record (lo, more): windows lo .. lo + more are its own, and
the symbols of all of them its context. About 2 / (W - G + 2) records a symbol are shuffled once; an anchor that
occurs once ends there. Records of one anchor and one context are a class: a passage that thousands of documents
share costs one record a document and one class in all, counted before the shuffle. Classes are what the
operators then work on, each knowing its first member and whether there are others.

Anchors are 64-bit hashes that only choose candidates; contexts are known by their anchor and XXH3 of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, buffer_of, cut, joined_words, release, slices, window_min, word_hashes, words_of

BLOCK = 1 << 17  # symbols that are hashed at a time
SAMPLE = 16  # one in so many documents is looked at for frequent grams, which only steers the choice of anchors
LOCAL = 4  # times that a gram must occur in a slice of the sample
FREQUENT = 1 << 16  # frequent grams that are told apart

_PLACE = 18  # low bits of a window's least value: the place of the gram in its block
_LEVEL = 6  # high bits: how frequent it is


class Units:
    """Texts of a column as symbols: symbols (hashes or bytes), the offsets of the texts among them, and the bytes of any run of symbols."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, raw: bytes, place: np.ndarray | None):
        self.symbols, self.at, self.raw, self.place = symbols, at, memoryview(raw), place

    def runs(self, a: np.ndarray, b: np.ndarray) -> Iterator[memoryview]:
        """The bytes of the symbols [a, b), words being joined by single spaces."""
        if self.place is None:
            ends = b
        else:
            a, ends = self.place[a], self.place[b] - 1
        raw = self.raw
        return (raw[x:y] for x, y in zip(a.tolist(), ends.tolist()))

    def bytes_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b - a if self.place is None else self.place[b] - self.place[a]


def byte_units(column: pa.Array) -> Units:
    data, at = buffer_of(column)
    return Units(data, at, data.tobytes(), None)


def word_units(column: pa.Array) -> Units:
    data, offsets = buffer_of(column)
    starts, stops, at = words_of(data, offsets)
    joined, place = joined_words(data, starts, stops)
    return Units(word_hashes(data, starts, stops, 11), at, joined.tobytes(), place)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, text) of every row, and the same with one row a key; keys are in the order of documents.

    The key is doc_id if that is unique, else a string that orders as (doc_id, hash of the text), nulls first. Rows
    of one key are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    if n == known and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
        return docs, docs
    ordered = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise("1"), ordered(F.coalesce("doc_id", F.lit(0).cast("long"))), ordered(F.xxhash64("text")))
    docs = docs.select(key.alias("key"), "doc_id", "text")
    return docs, docs.dropDuplicates(["key"])


def id_of(key: pa.Array) -> pa.Array:
    """The doc_id of each key."""
    if pa.types.is_integer(key.type):
        return key
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return pa.array([None if k is None or k[0] == "0" else signed(int(k[1:17], 16) ^ (1 << 63)) for k in key.to_pylist()], pa.int64())


class Scanner:
    """Anchors of the windows of w symbols; grams of g symbols."""

    def __init__(self, units: Callable[[pa.Array], Units], w: int, g: int, seed: int):
        self.units, self.w, self.g = units, w, g
        self.gram = Rolling(seed)
        self.frequent, self.level = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.maybe = np.zeros(1, dtype=bool)

    def avoid(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Hashes of frequent grams and their counts."""
        order = np.argsort(grams)
        self.frequent, self.level = grams[order], np.minimum(np.log2(counts[order]).astype(np.uint64) + np.uint64(1), np.uint64((1 << _LEVEL) - 1))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(grams & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        return self.gram.every(self.gram.prefix(symbols), self.g)

    def _values(self, h: np.ndarray) -> np.ndarray:
        """What windows take the least of: level of frequency, hash, place."""
        low = np.uint64((1 << _PLACE) - 1)
        value = ((h >> np.uint64(_LEVEL)) & ~low) | np.arange(len(h), dtype=np.uint64)
        if len(self.frequent):
            some = np.flatnonzero(self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.frequent, h[some]), len(self.frequent) - 1)
            hit = self.frequent[i] == h[some]
            value[some[hit]] |= self.level[i[hit]] << np.uint64(64 - _LEVEL)
        return value

    def scan(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Records of a column of texts; BLOCK symbols are worked on at a time, however long a text is."""
        units = self.units(column)
        at, w = units.at, self.w
        z = np.zeros(0, dtype=np.int64)
        parts, d = [(z, z, z, z.astype(np.uint64), z.astype(np.uint64))], 0
        while d < len(at) - 1:
            e = max(d + 1, int(np.searchsorted(at, at[d] + BLOCK, side="right")) - 1)
            for lo in range(0, max(1, int(at[e] - at[d]) - w + 1), BLOCK):  # more than once for one long text only
                a, b = int(at[d]) + lo, min(int(at[e]), int(at[d]) + lo + BLOCK + w - 1)
                doc, first, more, ah = self._block(units.symbols[a:b], np.clip(at[d : e + 1] - a, 0, b - a))
                doc = doc + d
                first = first + a
                parts.append((doc, first - at[doc], more, ah, self._contexts(units, first, more)))
            d = e
        return dict(zip(("doc", "lo", "more", "ah", "ch"), (np.concatenate(x) for x in zip(*parts))))

    def _contexts(self, units: Units, first: np.ndarray, more: np.ndarray) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, units.runs(first, first + more + self.w)), dtype=np.uint64, count=len(first))

    def _block(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, first window (its place in symbols), number of further windows and anchor of each record."""
        w, g, n = self.w, self.g, len(symbols)
        if n < w:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z, z.astype(np.uint64)
        h = self.grams(symbols)
        least = window_min(self._values(h), w - g + 1)
        begin, end = at[:-1], at[1:] - w + 1  # of each document's windows
        edges = np.unique(np.concatenate((np.flatnonzero(least[1:] != least[:-1]) + 1, begin[begin < end], end[begin < end])))
        lo, hi = edges[:-1], edges[1:] - 1
        doc = np.searchsorted(at, lo, side="right") - 1
        own = lo < end[doc]
        lo, hi, doc = lo[own], hi[own], doc[own]
        return doc, lo, hi - lo, h[(least[lo] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)]


def steered(docs: DataFrame, scanner: Scanner) -> Scanner:
    """The scanner, knowing the frequent grams of a sample of keyed documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            symbols = scanner.units(batch.column(0)).symbols
            parts = [np.zeros(0, dtype=np.uint64)]
            for a in range(0, max(0, len(symbols) - scanner.g + 1), BLOCK):
                parts.append(scanner.grams(symbols[a : a + BLOCK + scanner.g - 1]))
            h = np.sort(np.concatenate(parts))
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, dtype=np.int64)
            c = np.diff(edge)
            many = c >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(h[edge[:-1][many]].view(np.int64)), pa.array(c[many])], names=["h", "c"])

    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long, c long")
    found = some.groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # a fixed number of rows
    if found.num_rows:
        scanner.avoid(np.asarray(found.column("h")).astype(np.int64).view(np.uint64), np.asarray(found.column("c")))
    return scanner


def records(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(key, lo, more, ah, ch) of every record of every keyed document."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = shared.value.scan(batch.column(1))
            keys = batch.column(0).take(pa.array(x["doc"]))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x[c].astype(np.int32)) for c in ("lo", "more")], *[pa.array(x[c].view(np.int64)) for c in ("ah", "ch")]], names=["key", "lo", "more", "ah", "ch"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, lo int, more int, ah long, ch long")


def candidates(docs: DataFrame, scanner: Scanner) -> tuple[DataFrame, DataFrame]:
    """Written tables: records (key, lo, more, ah, ch) whose anchor occurs again, and their classes (ah, ch, key, lo, more, many):
    the first member, and whether there are others."""
    found = cut(records(docs, scanner))
    # counts are combined before their shuffle; being written, they leave the join free to split a hot anchor
    repeated = cut(found.groupBy("ah").count().where("count > 1").select("ah"))
    again = cut(found.join(repeated, "ah").select("key", "lo", "more", "ah", "ch"))
    release(found, repeated)
    classes = again.groupBy("ah", "ch").agg(F.min(F.struct("key", "lo", "more")).alias("first"), F.count("*").alias("n"))
    return again, cut(classes.select("ah", "ch", "first.*", (F.col("n") > 1).alias("many")))


def contexts(docs: DataFrame, classes: DataFrame, scanner: Scanner) -> DataFrame:
    """(ah, ch, key, lo, many, ctx): the classes with the bytes of their contexts."""
    lists = classes.groupBy("key").agg(F.collect_list(F.struct("ah", "ch", "lo", "more", "many")).alias("r"))
    names = ["ah", "ch", "key", "lo", "many", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units = scanner.units(batch.column(1))
            r = batch.column(2)
            doc = np.repeat(np.arange(len(r)), np.diff(np.asarray(r.offsets)))
            flat = r.flatten()
            lo, more = (np.asarray(flat.field(k)).astype(np.int64) for k in (2, 3))
            a = units.at[:-1][doc] + lo
            b = a + more + scanner.w
            # contexts overlap, so that they may be many times their text: let them go in parts
            part = np.cumsum(units.bytes_of(a, b)) >> 20
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lo)]
            for x, y in zip(cuts, cuts[1:]):
                own = lambda k: flat.field(k).slice(x, y - x)  # noqa: E731, B023
                ctx = pa.array([bytes(m) for m in units.runs(a[x:y], b[x:y])], pa.binary())
                yield pa.RecordBatch.from_arrays([own(0), own(1), batch.column(0).take(pa.array(doc[x:y])), own(2), own(4), ctx], names=names)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.join(lists, "key").select("key", "text", "r").mapInArrow(run, f"ah long, ch long, key {kind}, lo int, many boolean, ctx binary")


def by_anchor(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by ah, in batches of about `most` bytes of ctx that hold whole anchors; in order of (key, lo)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        return table.sort_by([("key", "ascending"), ("lo", "ascending")]).combine_chunks().to_batches()[0]

    for batch in slices(batches, "ctx", most // 4):
        held.append(batch)
        size += batch.column(5).nbytes
        if size >= most:
            table = pa.Table.from_batches(held)
            ah = np.asarray(table.column("ah"))
            whole = int(np.searchsorted(ah, ah[-1]))
            if whole:
                yield out(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(x.column(5).nbytes for x in held)
    if held:
        yield out(pa.Table.from_batches(held))


def spans_of(again: DataFrame, found: DataFrame) -> DataFrame:
    """Spreads what was found for classes, (ah, ch, key, lo, first, later), over their members: (key, lo, f), f being
    `first` for the first member and `later` for the others, where it isn't empty."""
    first = found.select("ah", "ch", F.col("key").alias("key0"), F.col("lo").alias("lo0"), "first", "later")
    f = F.when((F.col("key") == F.col("key0")) & (F.col("lo") == F.col("lo0")), F.col("first")).otherwise(F.col("later"))
    return again.join(first, ["ah", "ch"]).select("key", "lo", f.alias("f")).where("size(f) > 0")
