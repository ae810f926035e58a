"""Repeated windows: that the dealt methods decide, hash collisions, blocks, frequent grams and suffix ranks."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import repeats, rlz, suffix_levels


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def prose(r, n, size=5000):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def some():
    r = random.Random(5)
    shared = prose(r, 70)
    return [f"{prose(r, 40)} {shared} {prose(r, 40)}" for _ in range(12)] + [shared, shared, prose(r, 60)]


def test_words_are_compared_and_not_their_hashes(spark):
    """Thue-Morse words of 512 bytes, which any polynomial hash modulo 2**64 with an odd base takes for equal."""
    bits = np.array([bin(i).count("1") % 2 for i in range(512)])
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    tail = " ".join(f"t{i}" for i in range(19))
    got = rlz.deduplicate(docs_of(spark, [f"{one} {tail}", f"{two} {tail}", f"{one} {tail}"])).select("doc_id", "n_removed").collect()
    assert dict(map(tuple, got)) == {0: 0, 1: 0, 2: 20}


@pytest.mark.parametrize("module, step", [(rlz, "_parsed"), (suffix_levels, "_matched")])
def test_the_method_decides_what_is_removed(spark, some, monkeypatch, module, step):
    """Without the factors of the parse, or the matches of the levels, nothing is removed."""
    removed = lambda: sum(r[0] for r in module.deduplicate(docs_of(spark, some)).select("n_removed").collect())
    assert removed() > 12 * 70 - 70
    whole = getattr(module, step)
    monkeypatch.setattr(module, step, lambda *a: whole(*a).limit(0))
    assert removed() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8])
def test_parse_against_brute_force(window):
    r = random.Random(window)
    contexts = [[r.randrange(3) for _ in range(r.randrange(0, 14))] for _ in range(40)]
    at = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    block = rlz.Block(np.array([x for c in contexts for x in c]), at, window)
    who, a, b, q = block.parse(np.arange(40), False)
    words, seen, want = block.words.tolist(), set(), set()
    for c, i in zip(contexts, at.tolist()):
        for s in range(len(c) - window + 1):
            k = tuple(c[s : s + window])
            if k in seen:
                want.update(range(i + s, i + s + window))
            seen.add(k)
    assert {p for x, y in zip(a.tolist(), b.tolist()) for p in range(x, y)} == want
    for x, y, z in zip(a.tolist(), b.tolist(), q.tolist()):
        assert z < x and words[x:y] == words[z : z + y - x]
    who, a, b, _ = block.parse(np.arange(40), True)
    assert {p for x, y in zip(a.tolist(), b.tolist()) for p in range(x, y)} == {p for c, i in zip(contexts, at.tolist()) if len(c) >= window for p in range(i, i + len(c))}


def test_counts_pass_one_in_a_batch_or_across_levels():
    levels = suffix_levels.Levels(4)
    levels.add(np.frombuffer(b"abcdefgh", dtype=np.uint8), np.array([0, 8]), np.array([False]))
    assert len(levels.runs(np.array([0, 8]))[0]) == 0  # a class of one member is removed by no count of its own
    levels.add(np.frombuffer(b"xxcdefxx", dtype=np.uint8), np.array([0, 8]), np.array([False]))
    assert [x.tolist() for x in levels.runs(np.array([0, 8, 16]))] == [[0, 1], [2, 2], [2, 2]]


@pytest.mark.parametrize("block", [1 << 7, 1 << 9])
def test_blocks_don_t_change_anchors(block, monkeypatch):
    r = random.Random(2)
    text = prose(r, 900)
    column = pa.array([text, None, "", prose(r, 3), text[50:4000], prose(r, 100)])
    for units, w, g in ((repeats.byte_units, 60, 12), (repeats.word_units, 20, 5)):
        whole = repeats.Scanner(units, w, g, 3).scan(column)
        monkeypatch.setattr(repeats, "BLOCK", block)
        part = repeats.Scanner(units, w, g, 3).scan(column)
        monkeypatch.undo()
        per = lambda x: {(d, lo + i, a) for d, lo, m, a in zip(*(x[k].tolist() for k in ("doc", "lo", "more", "ah"))) for i in range(m + 1)}
        assert per(whole) == per(part)


def test_frequent_grams_are_no_anchors_where_others_are(spark):
    """Documents that share a line only: contexts around it don't meet."""
    r = random.Random(9)
    line = prose(r, 12)
    docs = repeats.keyed(docs_of(spark, [f"{prose(r, 30, 10**6)} {line} {prose(r, 30, 10**6)}" for _ in range(400)]))[1]
    most = lambda s: repeats.records(docs, s).groupBy("ah").count().agg(F.max("count")).first()[0]
    plain = repeats.Scanner(repeats.word_units, 20, 5, 21)
    assert most(plain) > 300
    assert most(repeats.steered(docs, repeats.Scanner(repeats.word_units, 20, 5, 21))) < 30


@pytest.mark.parametrize("w", [1, 3, 8, 11, 24, 40])
def test_suffix_ranks(w):
    r = random.Random(w)
    text = bytes(r.choice(b"ab") for _ in range(700)) + b"x" * 200
    starts = np.array([i for i in range(len(text) - w + 1) if i % 3])
    order, rank = suffix_levels.suffix_array(np.frombuffer(text + bytes(w + 8), dtype=np.uint8), starts, w)
    runs = [text[s : s + w] for s in starts.tolist()]
    assert [runs[i] for i in order.tolist()] == sorted(runs)
    assert len(set(zip(runs, rank.tolist()))) == len(set(runs)) == len(set(rank.tolist()))


def test_op2_sql(spark, tmp_path):
    """The DuckDB oracle and the query agree on texts whose repeats overlap and touch."""
    r = random.Random(4)
    base = "".join(r.choice("abcdef ") for _ in range(1500))
    texts = [base, base[:900] + "é" + base[900:], None, "", "y" * 1200, base[300:720], "".join(r.choice("xyz") for _ in range(500))]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(map(tuple, suffix_levels.op2_suffix_levels(spark, str(tmp_path)).select(names).collect()))
    assert got == sorted(c.execute(f"SELECT {', '.join(names)} FROM ({suffix_levels.OP2_SQL})").fetchall())
    assert sum(x[2] for x in got) > 3000
