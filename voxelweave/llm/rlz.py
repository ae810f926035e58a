"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the text itself: a document is parsed against all that comes earlier (smaller key, or the same
document further left). Only text under a repeated anchor can hold a factor (see repeats.py), and only against
text under the same anchor; so the contexts of repeated anchors are dealt to reference blocks by anchor, every
context meets every block that could hold its source, and equal contexts go there once. A block is indexed by its
runs of WINDOW words, compared as words and not as hashes: the index knows the earliest place of each. Every
context is then parsed from left to right, greedily: at its cursor, the earliest source is looked up and extended
word by word to the longest factor; without a source, the word is a literal and the cursor goes on by one. Behind
a factor the cursor steps back to the first window that the factor doesn't hold whole, so that windows over a
factor boundary are looked up as well. The same parse, with the context's own first place allowed as a source,
serves the later members of a class of equal contexts. Factors have at least WINDOW words and are the duplicate
spans; nothing else removes a word.

Defined cases. Null text: no words. Fewer than WINDOW words: nothing is removed. Rows with one doc_id and one
text are one document; if a doc_id repeats with other texts, or is null, documents go by (doc_id, hash of the
text), nulls first. A very long text is hashed in blocks, and its contexts are as short as any other's. No rows: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, cut, documents, joined_words, release, slices, word_ids, words_of
from .repeats import Scanner, by_anchor, candidates, contexts, id_of, keyed, spans_of, steered, word_units

WINDOW = 20
GRAM = 5
REFERENCE = 1 << 20  # bytes of a reference block, about: whole anchors


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs (a, b)."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class Block:
    """A reference block: contexts of words in order of their places, and the earliest place of each run of `window` words."""

    def __init__(self, words: np.ndarray, at: np.ndarray, window: int):
        """words: numbers of the words of all contexts; at: offsets of the contexts among them."""
        self.words, self.at, self.window = words, at, window
        self.end = np.repeat(at[1:], np.diff(at))  # of the context of each word
        rank, k = words.astype(np.int64), 1
        while 2 * k <= window:
            rank, k = _pairs(rank[:-k], rank[k:]), 2 * k
        if k < window:
            rank = _pairs(rank[: k - window], rank[window - k :])
        own = np.flatnonzero(self.end[: len(rank)] - np.arange(len(rank)) >= window)[::-1]
        earliest = np.zeros(len(rank), dtype=np.int64)
        earliest[rank[own]] = own  # the last to be written is the first
        self.source = earliest[rank]

    def parse(self, which: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Factors (context, start, end, source) of these contexts. itself: a context may be its own source, being a copy of it."""
        words, end, w = self.words, self.end, self.window
        who, cursor = which, self.at[which]
        out = []
        while True:
            open_ = cursor + w <= self.at[who + 1]
            who, cursor = who[open_], cursor[open_]
            if not len(who):
                break
            q = self.source[cursor]
            found = q <= cursor if itself else q < cursor
            p, q = cursor[found], q[found]
            size = np.full(len(p), w)
            room = np.minimum(end[p] - p, end[q] - q)
            grow = np.flatnonzero(size < room)
            while len(grow):
                same = words[p[grow] + size[grow]] == words[q[grow] + size[grow]]
                grow = grow[same]
                size[grow] += 1
                grow = grow[size[grow] < room[grow]]
            out.append((who[found], p, p + size, q))
            cursor = cursor + 1
            cursor[found] += size - w
        z = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip((z, z, z, z), *out))


_FACTORS = "array<struct<a:int,b:int,key:{0},lo:int>>"


def _parsed(docs: DataFrame, classes: DataFrame, scanner: Scanner) -> DataFrame:
    """(ah, ch, key, lo, first, later): factors (a, b, source key, source place) of each class, a and b counting from the start of the context."""
    kind = docs.schema["key"].dataType.simpleString()

    def listed(n: int, who: np.ndarray, a: np.ndarray, b: np.ndarray, key: pa.Array, lo: np.ndarray) -> pa.Array:
        order = np.argsort(who, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=n)))).astype(np.int32)
        fields = [pa.array(a[order].astype(np.int32)), pa.array(b[order].astype(np.int32)), key.take(pa.array(order)), pa.array(lo[order].astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, names=["a", "b", "key", "lo"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_anchor(batches, REFERENCE):
            data, offsets = buffer_of(batch.column(5))
            starts, stops, at = words_of(data, offsets)
            block = Block(word_ids(data, starts, stops)[0], at, scanner.w)
            key, lo, n = batch.column(2), np.asarray(batch.column(3)).astype(np.int64), batch.num_rows
            lists = []
            for of, itself in ((np.arange(n), False), (np.flatnonzero(np.asarray(batch.column(4).to_numpy(False))), True)):
                who, a, b, q = block.parse(of, itself)
                src = np.searchsorted(at, q, side="right") - 1
                lists.append(listed(n, who, a - at[who], b - at[who], key.take(pa.array(src)), lo[src] + q - at[src]))
            some = pa.array(np.flatnonzero(np.diff(np.asarray(lists[0].offsets)) + np.diff(np.asarray(lists[1].offsets))))
            yield pa.RecordBatch.from_arrays([x.take(some) for x in (*batch.columns[:4], *lists)], names=["ah", "ch", "key", "lo", "first", "later"])

    rows = contexts(docs, classes, scanner).repartition("ah").sortWithinPartitions("ah")
    return rows.mapInArrow(run, f"ah long, ch long, key {kind}, lo int, first {_FACTORS.format(kind)}, later {_FACTORS.format(kind)}")


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, r): the factors (start, end, source key, source start) of each keyed document that has any."""
    scanner = steered(docs, Scanner(word_units, window, min(GRAM, window), 21))
    again, classes = candidates(docs, scanner)
    found = cut(_parsed(docs, classes, scanner))
    release(classes)
    each = spans_of(again, found).select("key", "lo", F.explode("f").alias("f"))
    each = each.select("key", F.struct((F.col("lo") + F.col("f.a")).alias("start"), (F.col("lo") + F.col("f.b")).alias("end"), F.col("f.key").alias("key"), F.col("f.lo").alias("lo")).alias("f"))
    lists = cut(each.groupBy("key").agg(F.collect_list("f").alias("r")))
    release(again, found)
    return lists


def joined_up(doc: np.ndarray, a: np.ndarray, b: np.ndarray, src: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors (document, start, end, source, source start), those that go on where another stands being one; in order."""
    order = np.lexsort((b, a, doc))
    doc, a, b, src, lo = (x[order] for x in (doc, a, b, src, lo))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (a[1:] - lo[1:] != a[:-1] - lo[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    if len(first):
        b = np.maximum.reduceat(b, first)
    return doc[first], a[first], b, src[first], lo[first]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) of every row: the kept words joined by spaces, and the duplicate
    spans as (start, end, source, source_start) in words, source being the source's doc_id."""
    rows, docs = keyed(docs)
    lists = factors(docs, window)
    kind = "array<struct<start:int,end:int,source:bigint,source_start:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = buffer_of(batch.column(1))
            starts, stops, at = words_of(data, offsets)
            joined, place = joined_words(data, starts, stops)
            r, n = batch.column(2), batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(np.asarray(r.offsets)))
            flat = r.flatten()
            keys = flat.field(2).dictionary_encode()
            doc, a, b, src, lo = joined_up(doc, *(np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1)), np.asarray(keys.indices), np.asarray(flat.field(3)).astype(np.int64))
            change = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(change, at[doc] + a, 1)
            np.add.at(change, at[doc] + b, -1)
            stay = np.cumsum(change[:-1]) == 0
            owner = np.repeat(np.arange(n), np.diff(at))
            kept = np.repeat(stay, np.diff(place))
            size = np.bincount(owner[stay], np.diff(place)[stay], minlength=n).astype(np.int64)
            out = joined[kept].tobytes()
            edge = np.concatenate(([0], np.cumsum(size))).tolist()
            texts = [out[x : max(x, y - 1)].decode() for x, y in zip(edge, edge[1:])]  # without the last space
            spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), id_of(keys.dictionary).take(pa.array(src)), pa.array(lo.astype(np.int32))], names=["start", "end", "source", "source_start"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)), spans)
            removed = np.bincount(owner[~stay], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.diff(at)), pa.array(removed), pa.array(texts, pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    return rows.join(lists, "key", "left").select("key", "text", "r", "doc_id").mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, factors {kind}")


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS win
  FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})
), f AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM x
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM f WHERE k > 1
), r AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), k AS (
  SELECT doc_id, sum(1) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = u.doc_id AND g.p = u.p)
  GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
