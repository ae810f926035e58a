"""Benchmark decontamination as a prefix-filtered set join. DataFrame operations only.

Every window of an item (10 consecutive words; a shorter item is one window) is the ordered list of its
shingles. A window can only occur where its rarest shingle occurs, so that shingle alone is its prefix: the
required overlap is the whole window. One pass over the documents keeps the places of item shingles (a bitmap
of shingle hashes rules most places out, a join on the shingle itself decides); counts over all documents
order shingles by rarity; windows with a shingle that never occurs are gone; the rest join on their prefix,
pass the positional and the length bound, and are verified shingle by shingle.

Defined cases. Null or wordless text: no words, no hits. A row is known by doc_id and a hash of its text, so
repeated rows get equal results, and different texts under one doc_id, or under none, stay apart. Items
without words match nothing; item_id null matches but is not listed. A very long text is one row of words. No rows: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, sized, table

WINDOW = 10
SHINGLE = 3
MOST = 1 << 18  # item shingles that a bitmap and a broadcast are made for; beyond, Spark shuffles

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _shingle(w: Column, i: Column, g: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(g)])


def _hash(w: Column, i: Column, g: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(g)])


def _item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, wid, len, g, off, sh, h): the shingles of every distinct window of every item."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window))).withColumn("g", F.least("len", F.lit(shingle)))
    w = w.select("item_id", "w", "len", "g", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("start"))
    w = w.select("item_id", "len", "g", F.slice("w", F.col("start") + 1, F.col("len")).alias("w"))
    w = w.select("item_id", "len", "g", F.unhex(F.md5(F.concat_ws(" ", "w"))).alias("wid"), "w", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("g"))).alias("off")).distinct()
    each = [(g, _shingle(F.col("w"), F.col("off"), g), _hash(F.col("w"), F.col("off"), g)) for g in range(1, shingle + 1)]
    sh = F.coalesce(*[F.when(F.col("g") == g, s) for g, s, _ in each])
    h = F.coalesce(*[F.when(F.col("g") == g, x) for g, _, x in each])
    return w.select("item_id", "wid", "len", "g", "off", sh.alias("sh"), h.alias("h"))


def _places(w: Column, g: int, bits: bytearray | None) -> Column:
    """The shingles of g words that the bitmap doesn't rule out, as an array of (pos, g, sh)."""
    places = F.when(F.size(w) >= g, F.sequence(F.lit(0), F.size(w) - g)).otherwise(F.array().cast("array<int>"))
    if bits is not None:
        mask = F.lit(bytes(bits))
        places = F.filter(places, lambda i: F.substr(mask, (_hash(w, i, g).bitwiseAND(len(bits) - 1) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(g).alias("g"), _shingle(w, i, g).alias("sh")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every row, and (doc_id, th, start, len, item_id) of every occurring window."""
    items = cut(_item_windows(benchmark, window, shingle))
    known = items.select("g", "sh", "h").distinct()
    n = known.count()
    kinds = [r[0] for r in items.select("g").distinct().collect()]  # at most `shingle` values
    w = F.col("w")
    found = [F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("g"), F.lit(None).cast("string").alias("sh")))]
    for g in kinds:
        bits = None
        if n <= MOST:
            bits = bytearray(1 << max(12, (16 * n).bit_length()))
            for r in known.where(F.col("g") == g).select("h").collect():
                bits[r[0] & (len(bits) - 1)] = 1
        found.append(_places(w, g, bits))
    seen = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    seen = seen.select("doc_id", "th", F.size(w).alias("n_words"), F.explode(F.concat(*found)).alias("x")).select("doc_id", "th", "n_words", "x.*")
    ids = known.select("g", "sh", F.xxhash64("g", "sh").alias("sid"))
    seen = seen.join(sized(ids, "ids", MOST), ["g", "sh"], "left").where(F.col("sid").isNotNull() | (F.col("pos") < 0))
    seen = cut(seen.select("doc_id", "th", "n_words", "pos", "sid"))
    rows = seen.where("pos < 0").select("doc_id", "th", "n_words")
    places = seen.where("pos >= 0").distinct()

    rarity = places.groupBy("sid").agg(F.count("*").alias("n"))
    parts = items.select("wid", "len", "off", F.xxhash64("g", "sh").alias("sid")).distinct()
    live = parts.join(rarity, "sid", "left").groupBy("wid", "len").agg(F.count("n").alias("have"), F.count("*").alias("need"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sid", "off")).alias("r"))
    live = cut(live.where("have = need").select("wid", "len", "need", F.col("r.sid").alias("sid"), F.col("r.off").alias("off")))
    cands = places.join(sized(live, "prefixes", MOST), "sid").withColumn("start", F.col("pos") - F.col("off"))
    cands = cands.where("start >= 0 AND start + len <= n_words").select("doc_id", "th", "wid", "len", "need", "start").distinct()
    wanted = cands.join(sized(parts.join(live.select("wid"), "wid", "left_semi").select("wid", "off", "sid"), "parts", 8 * MOST), "wid")
    wanted = wanted.select("doc_id", "th", "wid", "len", "need", "start", (F.col("start") + F.col("off")).alias("pos"), "sid")
    p = places.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("at"), F.col("sid").alias("s"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("pos") == F.col("at")) & (F.col("sid") == F.col("s"))
    there = wanted.join(p, same, "left_semi").groupBy("doc_id", "th", "wid", "len", "need", "start").agg(F.count("*").alias("have")).where("have = need")
    owners = items.select("wid", "item_id").distinct()
    return rows, there.join(sized(owners, "owners", MOST), "wid").select("doc_id", "th", "start", "len", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: doc_id, th, n_words, n_hit, items (sorted strings), spans of hit words."""
    rows, hits = matches(docs, benchmark, window, shingle)
    per = hits.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("s"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.countDistinct("item_id").alias("n_items"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("s", zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")))["n"]
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), covered.alias("n_hit"), "items", "n_items", F.col("s").alias("spans"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len, list_slice(w, s, s + len - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - len + 2)) AS s FROM (SELECT *, least(len(w), {WINDOW}) AS len FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, len, s, list_slice(w, s, s + len - 1) AS win
  FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS s FROM d, (SELECT DISTINCT len FROM iw) WHERE len(w) >= len)
), hit AS (
  SELECT doc_id, len, s, item_id FROM dw JOIN iw USING (len, win)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + len)) AS p FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
