"""Corpus cleaning in stages, each a corpus operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever
the names of those beside doc_id and text (the last replaces n_tokens, ids and round_trip). Rows with a null doc_id or
text go through: such a text is judged as empty, and such a row is never another's copy. Rows that repeat (one doc_id,
one text) leave the near-dedup once. Texts are judged whole, however long. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, decontaminate, pii, quality, simhash
from voxelweave.llm.common import cut, finished, release, table, unused


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows that gone names by doc_id and th, the hash of the text."""
    own, its = unused("gone_id", docs.columns), unused("gone_th", docs.columns)
    gone = gone.select(F.col("doc_id").alias(own), F.col("th").alias(its)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(its)), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, gives at least the score of predicted 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    to = unused("quality_score", docs.columns)
    return quality.score(docs, model, to).where(F.col(to) >= quality.KEEP).drop(to)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word Jaccard similarity 0.8 or more join, the document of the smallest doc_id."""
    found = cut(simhash.near_duplicates(docs))
    if not found.groupBy("doc_id", "th").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))
    return _without(docs, found.where("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind, and n_chars counted anew."""
    names = docs.columns
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, n_tokens, and whether decoding gives the text back."""
    return bpe.with_ids(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: The quality and PII stages are trained models, which SQL cannot express; tests/llm checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, finished(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
