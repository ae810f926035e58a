"""What the corpus operators share: tables and their deletion, batches, words as bytes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxelweave.llm import common


def there(spark, df):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_tables_are_deleted_once_a_stage_is_done(spark):
    made = []

    def stage():
        made.append(common.cut(spark.range(5)))
        made.append(common.cut(made[0].selectExpr("id * 2 AS id")))
        return made[1].where("id > 2")

    out = common.finished(stage)
    assert sorted(r["id"] for r in out.collect()) == [4, 6, 8]
    assert there(spark, out) and not any(there(spark, t) for t in made)
    common.release(out, spark.range(1))  # a table that cut() didn't write is left alone
    assert not there(spark, out)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), spark.conf

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(Frame())


def test_long_texts_come_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    common.in_small_batches(spark)
    df = spark.range(40).selectExpr("repeat('x', 1000000) AS text").coalesce(1).mapInArrow(sizes, "n long, bytes long")
    got = df.collect()
    assert sum(r["n"] for r in got) == 40 and max(r["bytes"] for r in got) < 2 * common.BATCH_BYTES


def test_words_as_bytes():
    r = random.Random(3)
    texts = ["".join(r.choice("aB é\t\n\x0b\x0c\r\x1f\x85Zz.") for _ in range(r.randrange(0, 40))) for _ in range(300)] + [None, ""]
    data, offsets = common.buffer_of(pa.array(texts))
    starts, stops, at = common.words_of(data, offsets)
    want = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    raw = data.tobytes()
    assert [[raw[a:b] for a, b in zip(starts[x:y], stops[x:y])] for x, y in zip(at, at[1:])] == want
    joined, place = common.joined_words(data, starts, stops)
    assert joined.tobytes() == b"".join(w + b" " for ws in want for w in ws) and place[-1] == len(joined)
    ids, distinct = common.word_ids(data, starts, stops)
    assert [distinct[i].as_py() for i in ids.tolist()] == [w for ws in want for w in ws] and len(distinct) == len({w for ws in want for w in ws})
    h = common.word_hashes(data, starts, stops, 5)
    assert len(set(zip(h.tolist(), ids.tolist()))) == len(distinct)
    assert common.lowered(np.arange(256, dtype=np.uint8)).tobytes() == bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def test_names_that_no_column_has():
    assert common.unused("a", ["b"]) == "a" and common.unused("a", ["A", "a_"]) == "a__"
