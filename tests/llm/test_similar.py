"""The near-dedup stage against brute force over 5-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from voxelweave.llm import similar
from voxelweave.llm.common import table


def brute(docs):
    """The least doc_id of each document's group; docs by doc_id."""
    sets, root = {}, {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in sorted(docs.items()):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ")
        w = [x for x in w if x]
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for j, other in sets.items():
            if s == other or 5 * min(len(s), len(other)) >= 4 * max(len(s), len(other)) and 9 * len(s & other) >= 4 * (len(s) + len(other)):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        sets[i] = s
    return {i: top(i) for i in docs}


def test_near_dedup_stage_drops_what_brute_force_finds(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("frequent", [similar.FREQUENT, 3])
def test_edited_copies_at_the_edge_of_the_threshold(spark, monkeypatch, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    r = random.Random(0)
    docs, i = {}, 0
    shared = [f"s{k}" for k in range(30)]  # a passage that all have
    for _ in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(6, 150))] + shared * r.randrange(2)
        for edits in (0, 1, 1, 2, 3):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            docs[i] = " ".join(w)
            i += 1
    docs |= {i: "", i + 1: None, i + 2: "one two", i + 3: "ONE\ttwo", i + 4: "one"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in similar.near_copies(df).collect()}
    assert got == brute(docs)


def test_long_texts_meet_about_once_however_many_keys_they_share(spark):
    """Three texts that share most of 300 keys, two that share one key, and two of one root, which needn't meet."""
    r = random.Random(1)
    keys = r.sample(range(-(10**6), 10**6), 300)
    held = {i: r.sample(keys, 250) for i in (1, 2, 3)} | {4: [10**7, 10**7 + 1], 5: [10**7], 6: [2 * 10**7], 7: [2 * 10**7]}
    busy = spark.createDataFrame([(k, i, 1300, 6 if i == 7 else i) for i, own in held.items() for k in own], "key long, fp long, n int, root long")
    reps = spark.createDataFrame([(i, [0] * (similar.ODD // 64)) for i in held], "fp long, odd array<long>")
    got = [(x["a"], x["b"]) for x in similar.meetings(busy, reps).collect()]
    assert {tuple(sorted(p)) for p in got} == {(1, 2), (1, 3), (2, 3), (4, 5)}
    assert len(got) < 12  # about 620 when each shared key was a meeting


def test_golay_keys_propose_edited_copies(spark):
    """Of long texts with one word edited, Golay keys alone propose most; of unrelated ones none; equal fingerprints meet."""
    r = random.Random(2)
    docs = []
    for i in range(40):
        w = [f"w{r.randrange(10**5)}" for _ in range(300)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:150], "edited", *w[151:]]))]
    reps = similar.sets(spark.createDataFrame(docs, "doc_id long, text string"))
    of = {x["fp"]: x["doc_id"] for x in reps.collect()}
    got = {tuple(sorted((of[x["a"]], of[x["b"]]))) for x in similar.proposed(reps).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got) and len(got) >= 36
    same = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, -1)], "fp long, sk long")
    assert {(x["a"], x["b"]) for x in similar.proposed(same).collect()} == {(1, 2), (1, 3)}


def test_fingerprints_agree_as_sets_do():
    r = np.random.default_rng(3)
    bits = {}
    for n in (5, 40, 2000):
        for share in (0.8, 0.9):
            own = round(n * 2 * share / (1 + share))
            x = [np.sort(r.integers(0, 2**64, 2 * n - own, dtype=np.uint64)) for _ in range(300)]
            pairs = [(np.sort(v[p[:n]]), np.sort(v[p[n - own :]])) for v, p in ((v, r.permutation(len(v))) for v in x)]
            h = np.concatenate([a for p in pairs for a in p])
            s = similar.sketches(h, np.arange(0, len(h) + 1, n))
            bits[n, share] = np.bitwise_count(s[::2] ^ s[1::2]).mean(), 32 * (1 - own / (2 * n - own))
    assert all(abs(got - want) < 1.2 for got, want in bits.values()), bits
    assert similar.sketches(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [0]
