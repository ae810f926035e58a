"""Chat formatting: turn-aligned windows under a token budget, with a loss mask. DataFrame operations only.

A conversation's turns are written as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

and cut into windows: prefix sums of the turns' tokens say where the budget ends, a window starts at a turn,
repeats the system turn and the last few turns before it as far as they fit, and puts the loss on its own
assistant turns only, so that a repeated target is masked and every target counts once.

A turn's tokens are those of a column that the caller names (bpe.with_ids() counts them exactly), or else an estimate
that needs no vocabulary: a token for every started TOKEN_BYTES bytes of each word, and FRAME for the marks.

A window takes only its own turns along. A conversation is put in order, and its windows are laid out, by one task, as
each cut depends on the one before: its cost grows with its turns, and its memory with its text.

Defined cases. Null text and null role: empty. Turns are ordered by (turn, role, text), nulls first; repeated
rows are turns of their own. A turn over the budget makes a window alone. A null conv_id is one conversation.
No rows: no windows. A very long text is one turn, whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUDGET = 512  # tokens of a window
HISTORY = 2  # turns that a later window repeats
FRAME = 4  # tokens that a turn's marks count for
TOKEN_BYTES = 4

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that some chat template gives a meaning; a backslash after their first character disarms them.
_CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])"
_DISARMED = r"([<\[])\\(\||/?s>|/?INST\])"
_TURN = r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """Reversible: backslashes double, then one goes into each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _DISARMED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\nl|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\nl|"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """The estimate, without the marks."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.floor((F.octet_length(w) + (TOKEN_BYTES - 1)) / TOKEN_BYTES))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, counted: str | None = None) -> DataFrame:
    """Rows (conv_id, window, formatted, n_repeated, n_tokens, loss): loss holds (start, length) in code points.

    counted: the column with the tokens of each turn's text; None: they are estimated.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (tokens(F.coalesce("text", F.lit(""))) if counted is None else F.coalesce(F.col(counted).cast("long"), F.lit(0).cast("long"))).alias("tok"))
        .withColumn("rn", F.row_number().over(order))
        .withColumn("tok", F.col("tok") + FRAME)
        .withColumn("body", escape(F.col("text")))
        .withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("size", F.length("head") + F.length("body") + len(CLOSE) + 1)
        .withColumn("p", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("c", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    one = F.struct("rn", "role", "body", "head", "tok", "size", "p", "c")
    # rows of a conversation come sorted, and the sort below only makes that certain
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    chats = chats.withColumn("sys", F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0)).withColumn("sys_tok", F.when(F.col("sys") == 1, F.col("t")[0]["tok"]).otherwise(F.lit(0).cast("long")))

    t = F.col("t")

    def before(i: Column) -> Column:
        """Index (from 0) of the first turn that a window starting at turn i (from 0) repeats, if it all fits."""
        back = F.greatest(F.col("sys"), i - history)
        spent = F.get(t, i)["p"] - F.when(back > 0, F.get(t, back - 1)["p"]).otherwise(F.lit(0).cast("long"))
        return F.when(spent + F.col("sys_tok") <= budget, back).otherwise(i)

    def step(acc: Column, x: Column) -> Column:
        i = x["rn"] - 1
        first = before(i)
        base = F.when(first > 0, F.get(t, first - 1)["p"]).otherwise(F.lit(0).cast("long"))
        new = (x["p"] > acc["limit"]) & (i > F.element_at(acc["cuts"], -1))
        return F.when(new, F.struct(F.concat(acc["cuts"], F.array(i)).alias("cuts"), (base + budget - F.col("sys_tok")).alias("limit"))).otherwise(acc)

    start = F.struct(F.array(F.col("sys")).alias("cuts"), F.lit(budget).cast("long").alias("limit"))
    chats = chats.withColumn("cuts", F.aggregate("t", start, step)["cuts"])
    part = lambda a, b: F.slice(t, a + 1, b - a)
    # characters before turn x of this window: the system turn's, then those from turn h on
    at = lambda i: F.when(i > 0, F.get(t, i - 1)["c"]).otherwise(F.lit(0).cast("long"))
    system = F.col("sys")

    def window(a: Column, w: Column) -> Column:
        b = F.coalesce(F.get("cuts", w + 1), F.size(t))
        h = F.when(w == 0, a).otherwise(before(a))
        return F.struct(
            w.cast("int").alias("window"), F.concat(part(F.lit(0), system), part(h, b)).alias("inside"), part(a, b).alias("new"), (at(system) - at(h)).alias("lead"),
        )

    windows = chats.select("conv_id", F.explode(F.transform("cuts", window)).alias("w")).select("conv_id", "w.*")
    written = F.array_join(F.transform("inside", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), "")
    own = F.filter("new", lambda x: x["role"] == "assistant")
    loss = F.transform(own, lambda x: F.struct((F.col("lead") + x["c"] - x["size"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
    return windows.select(
        "conv_id", "window", written.alias("formatted"), F.when(F.col("window") == 0, 0).otherwise(F.size("inside") - F.size("new")).alias("n_repeated"),
        F.aggregate("inside", F.lit(0).cast("long"), lambda acc, x: acc + x["tok"]).alias("n_tokens"), loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations as the formatted windows say: per conv_id the turns, and the text under the loss mask."""
    f = F.col("formatted")
    turns = F.arrays_zip(F.regexp_extract_all(f, F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all(f, F.lit(_TURN), F.lit(2)).alias("text"))
    texts = F.transform(F.slice(turns, F.col("n_repeated") + 1, F.size(turns)), lambda x: F.concat(unescape_role(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n")))
    target = F.array_join(F.transform("loss", lambda x: unescape(F.substr(f, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    parts = windows.select("conv_id", "window", F.size(texts).alias("n"), F.array_join(texts, "").alias("turns"), target.alias("target"), F.length(f).cast("long").alias("chars"))
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "target"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return parts.select("conv_id", "n_turns", F.array_join(F.col("w")["turns"], "").alias("turns"), F.array_join(F.col("w")["target"], "").alias("target"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus number -1, whose texts are made of another template's control strings."""
    s = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{s}'), (-1L, 1L, 'assistant', '{s}') AS v(conv_id, turn, role, text)")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionAll(probe)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("target").cast("long").alias("loss_chars"),
        F.sha2("target", 256).alias("loss_sha256"), "formatted_chars",
    )


_WORD = r"[^ \t\n\x0B\f\r]+"
OP10_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, row_number() OVER w AS rn, coalesce(list_sum([(strlen(w) + {TOKEN_BYTES - 1}) // {TOKEN_BYTES} for w in regexp_extract_all(text, '{_WORD}')]), 0)::BIGINT + {FRAME} AS tok,
    {len(OPEN) + len(CLOSE) + 2} + length(replace(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3' || '\\' || '\2\4', 'g'), chr(10), '<\nl|'))
      + length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3' || '\\' || '\2\4', 'g')) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(tok) OVER w AS p, sum(size) OVER w AS ch, first_value(role) OVER w = 'system' AS sys, CASE WHEN first_value(role) OVER w = 'system' THEN first_value(tok) OVER w ELSE 0 END AS sys_tok,
    CASE WHEN first_value(role) OVER w = 'system' THEN first_value(size) OVER w ELSE 0 END AS sys_size
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY rn)
), b AS (
  SELECT x.*, y.h, y.hp, y.hc FROM s x, LATERAL (
    SELECT CASE WHEN x.p - coalesce(z.p, 0) + x.sys_tok <= {BUDGET} THEN k ELSE x.rn - 1 END AS h,
      CASE WHEN x.p - coalesce(z.p, 0) + x.sys_tok <= {BUDGET} THEN coalesce(z.p, 0) ELSE x.p - x.tok END AS hp,
      CASE WHEN x.p - coalesce(z.p, 0) + x.sys_tok <= {BUDGET} THEN coalesce(z.ch, 0) ELSE x.ch - x.size END AS hc
    FROM (SELECT greatest(x.sys::INT, x.rn - 1 - {HISTORY}) AS k) g LEFT JOIN s z ON z.conv_id IS NOT DISTINCT FROM x.conv_id AND z.rn = g.k) y
), r AS (
  SELECT conv_id, rn, {BUDGET}::HUGEINT AS lim, sys::INT AS cut, CASE WHEN sys THEN 0 ELSE 0 END::HUGEINT AS again, false AS new FROM b WHERE rn = 1
  UNION ALL
  SELECT b.conv_id, b.rn, CASE WHEN b.p > r.lim AND b.rn - 1 > r.cut THEN b.hp + {BUDGET} - b.sys_tok ELSE r.lim END::HUGEINT,
    CASE WHEN b.p > r.lim AND b.rn - 1 > r.cut THEN b.rn - 1 ELSE r.cut END::INT,
    CASE WHEN b.p > r.lim AND b.rn - 1 > r.cut THEN b.sys_size + (b.ch - b.size - b.hc) ELSE 0 END::HUGEINT, b.p > r.lim AND b.rn - 1 > r.cut
  FROM r JOIN b ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.rn = r.rn + 1
), t AS (
  SELECT b.*, r.again FROM b JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.rn = r.rn
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + again)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
