"""The stages one after the other, each against what its own operator says of its input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from voxelweave.llm import decontaminate, quality, simhash
from voxelweave.llm.common import cut, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = cut(table(spark, SF, "documents"))
    out = [docs]
    for _, f in pipeline.STAGES:
        docs = cut(f(spark, docs, SF))
        out.append(docs)
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns(stages):
    first = stages[0].columns
    assert all(s.columns == first for s in stages[1:-1]) and stages[-1].columns == [*first, "n_tokens", "ids", "round_trip"]


def test_quality_keeps_what_scores(spark, stages):
    model = quality.fit(stages[0], table(spark, SF, "labels"))
    assert ids(stages[1]) == ids(quality.score(stages[0], model).where(f"score >= {quality.KEEP}"))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids(stages[1]) for i in good) / len(good) > 0.97


def test_one_of_each_group_stays(stages):
    groups = {}
    for r in simhash.near_duplicates(stages[1]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids(stages[2]) == {min(g) for g in groups.values()} and any(len(g) > 1 for g in groups.values())


def test_no_contaminated_document_stays(spark, stages):
    bench = table(spark, SF, "benchmark")
    hit = ids(decontaminate.decontaminate(stages[2], bench).where("n_hit > 0"))
    assert hit and ids(stages[3]) == ids(stages[2]) - hit


def test_personal_data_goes(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(mail.search(r["text"]) for r in before.values()) and not any(mail.search(r["text"]) for r in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(before[i]["text"] == r["text"] for i, r in after.items() if not re.search("[0-9@]", before[i]["text"]))


def test_encoding_is_whole(stages):
    last = stages[-1]
    assert ids(last) == ids(stages[-2]) and last.where("NOT round_trip OR n_tokens != size(ids)").count() == 0


def test_nulls_repeats_and_emptiness(spark, tmp_path):
    schema = table(spark, SF, "documents").schema
    text = " ".join(f"good{i} and plain" for i in range(40))
    rows = [(1, text, "en", None, None), (1, text, "en", None, None), (2, text, None, "a", 3), (None, text, None, None, None), (None, None, None, None, None), (3, None, None, None, None), (4, "", None, None, 0)]
    for name, data in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "none of this occurs anywhere")] if data else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = pipeline.run(spark, d).collect()
        if not data:
            assert got == []
    # one label only: its smoothed share, 0.75, keeps all; of 1, 1 and 2 the first stays; 3 and 4 are alike; nulls stay
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in pipeline.run(spark, str(tmp_path / "some")).collect()) == [(False, 1), (False, 3), (True, 0), (True, 0)]


def test_clashing_columns_go_through_every_stage(spark):
    names = ["quality_score", "gone_id", "gone_th", "pii_spans", "score", "spans", "key", "th", "w", "component_id", "n_words", "r"]
    docs = table(spark, SF, "documents").limit(60).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    docs = cut(docs)
    for name, f in pipeline.STAGES[:-1]:
        after = cut(f(spark, docs, SF))
        assert after.columns == docs.columns, name
        assert after.count() > 0 and all(r[n] == f"{n}{r['doc_id']}" for r in after.collect() for n in names), name
        docs = after
