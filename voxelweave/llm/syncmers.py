"""Document fingerprints from closed syncmers, matched by place. DataFrame operations only.

A text is read as symbols: runs of at most four code points, started anew at every word. A k-mer is K
consecutive symbols, its inner substrings are the S-symbol runs in it; it is a closed syncmer, an anchor, if
the least of their hashes stands at its first or last place. Whether a k-mer is an anchor depends on itself
alone, so an edit moves no anchor outside of it. An anchor is a number: its hash and its first place in the text.

Two texts are matched over all of their anchors: equal ones are paired, in the order of the places of the left text,
and a pair counts if a neighbouring pair goes on at about the same distance in both texts (SLACK symbols). The likeness
is the share of the anchors that are in such pairs, of all distinct ones. The fingerprint that is given out holds
the SKETCH least hashes.

Defined cases. Null text: empty. An empty text has the empty fingerprint, like itself (1) and unlike any other
(0). Texts with equal anchors at equal places are alike (1). A text of fewer than SHORT symbols adds its single symbols
to its anchors, so that it has some. A very long text has as many anchors as its length brings, all in one row. The next
document goes by doc_id, descending, then text; a null doc_id comes last; repeated rows are documents of their
own; a lone document is its own next. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, sized

K, S = 5, 2
SKETCH = 64
SHORT = 12
SLACK = 8
DENSITY = 256  # documents of a bucket of neighbouring ids, about
MOST = 1 << 20  # bucket borders that are broadcast
RANGES = 1 << 12  # quantiles of the ids that buckets are laid out in, at most

_SYMBOL = r"[^ \t\n\x0B\f\r]{1,4}"
_LEAST = -(1 << 63)
_PLACE = (1 << 31) - 1


def _hashes(df: DataFrame, text: str, to: str) -> DataFrame:
    """to + "_h": hashes of the symbols; to + "_m": of their pairs, S being 2."""
    h, m = f"{to}_h", f"{to}_m"
    df = df.withColumn(h, F.transform(F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(0)), lambda s: F.xxhash64(s)))
    c = F.col(h)
    places = lambda size: F.when(F.size(c) >= size, F.sequence(F.lit(0), F.size(c) - size)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(m, F.transform(places(S), lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1)))).withColumn(f"{to}_p", places(K))


def _is_anchor(m: Column, i: Column) -> Column:
    ends = F.least(F.get(m, i), F.get(m, i + K - S))
    return ends <= F.least(*[F.get(m, i + j) for j in range(1, K - S)])


def _packed(h: Column, m: Column, i: Column) -> Column:
    """31 bits of the hash of the k-mer at symbol i, then i."""
    return _at(F.xxhash64(F.get(m, i), F.get(h, i + S), F.get(m, i + K - S)), i)


def _at(h: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(i.cast("long"))


def _hash(x: Column) -> Column:
    return F.shiftright(x, 32)


def with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with column to: the anchors of a text column without nulls, in the order of their hashes, each at its first place."""
    df = _hashes(df, text, to)
    h, m, p, every = F.col(f"{to}_h"), F.col(f"{to}_m"), F.col(f"{to}_p"), f"{to}_e"
    found = F.transform(F.filter(p, lambda i: _is_anchor(m, i)), lambda i: F.coalesce(_packed(h, m, i), F.lit(0).cast("long")))
    single = F.when(F.size(h) < SHORT, F.transform(h, lambda x, i: F.coalesce(_at(x, i), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(every, F.sort_array(F.concat(found, single))).drop(f"{to}_h", f"{to}_m", f"{to}_p")
    e = F.col(every)
    return df.withColumn(to, F.filter(e, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(e, i - 1))))).drop(every)


def match_positions(df: DataFrame, left: str, right: str, to: str) -> DataFrame:
    """df with column to: the places of equal anchors of two columns of with_anchors(), (left << 32) + right, in order."""
    both, least = f"{to}_b", F.lit(0).cast("long")
    marked = F.transform(right, lambda x: x.bitwiseOR(F.lit(1 << 31)))  # after the left one of the same hash
    df = df.withColumn(both, F.sort_array(F.concat(F.col(left), marked)))
    u = F.col(both)
    places = F.when(F.size(u) > 1, F.sequence(F.lit(1), F.size(u) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda i: _hash(F.get(u, i)) == _hash(F.get(u, i - 1)))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    pairs = F.transform(same, lambda i: F.coalesce(F.shiftleft(place(F.get(u, i - 1)), 32).bitwiseOR(place(F.get(u, i))), least))
    return df.withColumn(to, F.sort_array(pairs)).drop(both)


def pairs_of(matches: Column) -> Column:
    """The matches as (left, right)."""
    return F.transform(matches, lambda x: F.struct(_hash(x).alias("left"), x.bitwiseAND(F.lit(_PLACE)).alias("right")))


def with_likeness(df: DataFrame, left: str, right: str, to: str) -> DataFrame:
    """df with column to: the likeness of two columns of with_anchors(), 0 to 1."""
    matches = f"{to}_m"
    df = match_positions(df, left, right, matches)
    m = F.col(matches)

    def goes_on(x: Column, y: Column) -> Column:
        """From pair y to pair x."""
        a, b = _hash(x) - _hash(y), x.bitwiseAND(F.lit(_PLACE)) - y.bitwiseAND(F.lit(_PLACE))
        return F.coalesce((b > 0) & (F.abs(a - b) <= SLACK), F.lit(False))

    kept = F.size(F.filter(m, lambda x, i: goes_on(x, F.get(m, i - 1)) | goes_on(F.get(m, i + 1), x)))
    df = df.withColumn(f"{to}_k", kept)
    k = F.col(f"{to}_k")
    share = k / (F.size(left) + F.size(right) - k)
    return df.withColumn(to, F.when(F.col(left) == F.col(right), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))).drop(matches, f"{to}_k")


def written(anchors: Column) -> Column:
    """The fingerprint: the least hashes in hexadecimal digits."""
    return F.array_join(F.transform(F.slice(anchors, 1, SKETCH), lambda x: F.lpad(F.lower(F.hex(_hash(x))), 8, "0")), "")


def _bucket(docs: DataFrame, key: Column) -> Column:
    """A number that rises with the key and that about DENSITY rows share, however the keys are spread.

    Quantiles of all keys make at most RANGES ranges, the bucket's high bits; each is cut evenly, the low 32 bits.
    """
    n = docs.count()
    ranges = max(1, min(RANGES, n // (2 * DENSITY)))
    found = docs.agg(F.percentile_approx(key, [i / ranges for i in range(ranges + 1)], 20 * ranges)).first()[0] if n else None
    borders = sorted(set(found)) if found else [0]
    own = F.array(*[F.lit(b).cast("long") for b in borders])
    steps = [1 << b for b in range(len(borders).bit_length() - 1, -1, -1)]
    # the last border that isn't after the key, by halving; keys before the first are in its range
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.coalesce(F.get(own, a + s) <= key, F.lit(False)), a + s).otherwise(a))
    low, high = F.get(own, at).cast("double"), F.coalesce(F.get(own, at + 1), F.get(own, at) + 1).cast("double")
    parts = max(1, n // (ranges * DENSITY))
    part = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (key.cast("double") - low) / F.greatest(F.lit(1.0), high - low))) * parts)
    return F.shiftleft(at.cast("long"), 32) + part


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, an, next_text, next_an), the next document going by descending doc_id, round to the first.

    Ids fall into buckets of neighbours, and each bucket also gets the top document of the bucket below, so
    that one shuffle of the texts brings every document to its next one.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("b", _bucket(docs.select("key"), F.col("key")))
    tops = docs.groupBy("b").agg(F.max("key").alias("top"))
    # the top of the bucket below: within a range by a window, across ranges by one over at most RANGES rows
    tops = tops.withColumn("s", F.shiftright("b", 32))
    w = Window.partitionBy("s").orderBy("b")
    tops = tops.withColumn("below", F.lag("top").over(w))
    supers = tops.groupBy("s").agg(F.max("top").alias("s_top"))
    ws = Window.orderBy("s")
    supers = supers.withColumn("s_below", F.coalesce(F.lag("s_top").over(ws), F.max("s_top").over(ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("s", "s_below")
    extra = tops.join(F.broadcast(supers), "s").select(F.coalesce("below", "s_below").alias("key"), F.col("b").alias("to"))
    rows = docs.join(sized(extra, "borders", MOST), "key", "left")
    to = lambda b, copy: F.struct(F.col(b).alias("b"), F.lit(copy).alias("copy"))
    rows = rows.select("key", "doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(to("b", False))).otherwise(F.array(to("b", False), to("to", True)))).alias("x"))
    rows = rows.select("key", "doc_id", "text", F.col("x.b").alias("b"), F.col("x.copy").alias("copy")).repartition("b")
    rows = with_anchors(rows, "text", "an")
    order = Window.partitionBy("b").orderBy("copy", F.desc("key"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_an", F.lead("an").over(order))
    return rows.where(~F.col("copy")).select("doc_id", "text", "an", "next_text", "next_an")


def fingerprints(docs: DataFrame) -> DataFrame:
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    d = with_anchors(d.select("doc_id", "n_chars", "an", "next_an", "edited"), "edited", "edited_an")
    return with_likeness(with_likeness(d, "an", "edited_an", "near_edited"), "an", "next_an", "near_next")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints(documents(spark, sf_dir))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("an")).alias("fingerprint"), written(F.col("edited_an")).alias("edited_fingerprint"), "near_edited", "near_next")
