"""The ten queries against brute force, over a small table of awkward rows and over empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelweave.llm import bpe, chat, decontaminate, lm, pii, queries, rlz, simhash, suffix_levels, syncmers

Q = queries.QUERIES
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string, th long, n_words int, _gone_id long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
CONVS = "conv_id long, turn long, role string, text string, window int"
WORDS = [f"{a}{b}" for a in ("Ko", "ra", "Mi", "tel", "é", "ß") for b in ("n", "st", "lo", "x", "ü")]
CHARS = [chr(c) for c in (0x1F600, 0x301, 0xA0, 0x85, 0x0B, 0x0C)]


def digest(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def texts():
    r = random.Random(7)
    sent = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared, out = sent(60), []
    for i in range(40):
        out.append(f"{sent(r.randrange(0, 80))} {shared if i % 3 == 0 else ''}\n{sent(r.randrange(0, 30))}")
    out += [None, "", " \t\n", "one", "a b", "To " * 300, "x" * 3000, out[0], out[0] + " tail", out[3].upper(), "".join(CHARS) + " a@b.cc +1 (222) 333-4444 10.0.0.1", sent(9000)]
    out += ["mail x.y@mail.example.com and 4111 1111 1111 1111 then +49 30 1234567, 300.1.1.1 192.168.0.12", "café <|endoftext|> 12345 's 're", "ITEM " + ITEM_TEXT[0] + " end", ITEM_TEXT[2], "Zq", "no zq here"]
    return out


ITEM_TEXT = ["The quick-brown fox jumps over one lazy dog and then some more words follow here", "short item of few", "Zq", "", None]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    ids = list(range(100, 100 + len(texts())))
    random.Random(1).shuffle(ids)
    rows = [(i, t, None, "s", len(t or ""), 0.5, "x", "k", 1, 2, 3) for i, t in zip(ids, texts())]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, None if n % 7 == 0 else int(n % 3 > 0), 0) for n, i in enumerate(ids)] + [(None, 1, 0)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEM_TEXT)) + [(0, "The quick-brown fox")], ITEMS).write.parquet(f"{d}/benchmark.parquet")
    r = random.Random(3)
    convs = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 220))), 1) for c in range(6) for t in range(r.randrange(1, 14))]
    convs += [(50, 0, "system", "alone", 1), (51, None, None, None, 1), (51, 1, "assistant", "a\\b <|im_end|> [INST] <\\|x", 1), (51, 1, "assistant", "a\\b <|im_end|> [INST] <\\|x", 1), (None, 1, "assistant", "n", 1), (52, 1, "new\nrole", "t", 1), (53, 0, "assistant", "w " * 2000, 1)]
    spark.createDataFrame(convs, CONVS).write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS), ("conversations", CONVS)):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(t):
    return [w.decode() for w in t.encode().split()]


def lower(t):
    return t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).decode()


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    got = Q[name](spark, empty).collect()
    assert len(got) == (1 if name.startswith("op10") else 0)  # conversation -1 is always there


def test_op1(spark, sf, docs):
    got, seen = rows(Q["op1_rlz_dedup"](spark, sf)), set()
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        w, gone = words(docs[i]), set()
        for s in range(len(w) - rlz.WINDOW + 1):
            k = tuple(w[s : s + rlz.WINDOW])
            if k in seen:
                gone.update(range(s, s + rlz.WINDOW))
            seen.add(k)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), digest(kept)), i


def test_op1_factors_point_at_equal_words(spark, sf, docs):
    n = 0
    for r in rlz.deduplicate(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        w = words(docs[r["doc_id"]])
        for f in r["factors"]:
            s = words(docs[f["source"]])[f["source_start"] : f["source_start"] + f["end"] - f["start"]]
            assert w[f["start"] : f["end"]] == s and f["end"] - f["start"] >= rlz.WINDOW and (f["source"], f["source_start"]) < (r["doc_id"], f["start"])
            n += 1
    assert n > 10


def spans_of(flags):
    return sum(1 for i, f in enumerate(flags) if f and (not i or not flags[i - 1]))


def repeats(docs, w):
    count = collections.Counter(t[s : s + w] for t in docs for s in range(len(t) - w + 1))
    for t in docs:
        gone, end = bytearray(len(t)), 0
        for s in range(len(t) - w + 1):
            if count[t[s : s + w]] > 1:
                gone[max(s, end) : s + w] = b"\1" * (s + w - max(s, end))
                end = s + w
        yield gone


def test_op2(spark, sf, docs):
    got, ids = rows(Q["op2_suffix_levels"](spark, sf)), sorted(docs)
    for i, gone in zip(ids, repeats([docs[i].encode() for i in ids], suffix_levels.WINDOW)):
        b = docs[i].encode()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), spans_of(gone), digest(kept)), i


@pytest.mark.parametrize("w", [5, 9, 24])
def test_op2_levels_merge(spark, w, monkeypatch):
    r = random.Random(w)
    t = ["".join(r.choice("ab") for _ in range(r.randrange(0, 160))) for _ in range(60)]
    t += [t[i][5:90] + "c" + t[i + 1][3:60] for i in range(30)]
    own = [x for x in t if len(x) >= w]
    many = [len(x) % 7 == 0 for x in own]
    levels = suffix_levels.Levels(w)  # many small batches: several levels and merges
    for i in range(0, len(own), 4):
        part = own[i : i + 4]
        data = np.frombuffer("".join(part).encode(), dtype=np.uint8)
        levels.add(data, np.concatenate(([0], np.cumsum([len(x) for x in part]))), np.array(many[i : i + 4]))
    rec, lo, hi = levels.runs(np.concatenate(([0], np.cumsum([len(x) for x in own]))))
    got = {(a, s) for a, x, y in zip(rec.tolist(), lo.tolist(), hi.tolist()) for s in range(x, y + 1)}
    count = collections.Counter(x[s : s + w] for x, m in zip(own, many) for s in range(len(x) - w + 1) for _ in range(1 + m))
    assert got == {(k, s) for k, x in enumerate(own) for s in range(len(x) - w + 1) if count[x[s : s + w]] > 1}
    assert len(levels.levels) <= 8


def test_op3(spark, sf, docs):
    got, ids = rows(Q["op3_syncmer_fingerprints"](spark, sf)), sorted(docs, reverse=True)
    prints = collections.defaultdict(set)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, h = docs[i], len(docs[i]) // 2
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), digest(t[: len(t) - h] + docs[nxt][:h]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and prints[""] == {""}
    long_ = [i for i in ids if len(docs[i]) > 400 and "To To" not in docs[i] and len(set(docs[i])) > 3]
    assert sum(got[i]["near_edited"] > 0.1 for i in long_) / len(long_) > 0.9


def brute_anchors(text):
    """{hash: first place} of the closed syncmers of a text, k-mer by k-mer."""
    def h(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    sym = [h(x.encode()) for x in re.findall(r"[^ \t\n\x0b\f\r]{1,4}", text)]
    short = lambda x: (x % (1 << 64)) >> 33
    found = [(short(v), i) for i, v in enumerate(sym)] if len(sym) < syncmers.SHORT else []
    for i in range(len(sym) - syncmers.K + 1):
        inner = [h(sym[j], sym[j + 1]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((short(h(inner[0], sym[i + syncmers.S], inner[-1])), i))
    out = {}
    for v, i in sorted(found):
        out.setdefault(v, i)
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    pairs = sorted((a[v], b[v]) for v in a.keys() & b.keys())
    goes_on = lambda x, y: x[1] > y[1] and abs((x[0] - y[0]) - (x[1] - y[1])) <= syncmers.SLACK
    kept = sum((i > 0 and goes_on(p, pairs[i - 1])) or (i + 1 < len(pairs) and goes_on(pairs[i + 1], p)) for i, p in enumerate(pairs))
    return kept / (len(a) + len(b) - kept) if a or b else 0.0


def test_op3_matches_brute_force(spark, sf, docs):
    got, ids = rows(Q["op3_syncmer_fingerprints"](spark, sf)), sorted(docs, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, half = docs[i], len(docs[i]) // 2
        own, edited, other = (brute_anchors(x) for x in (t, t[: len(t) - half] + docs[nxt][:half], docs[nxt]))
        assert got[i]["fingerprint"] == "".join(f"{v:08x}" for v in sorted(own)[: syncmers.SKETCH]), i
        assert got[i]["edited_fingerprint"] == "".join(f"{v:08x}" for v in sorted(edited)[: syncmers.SKETCH]), i
        assert math.isclose(got[i]["near_edited"], brute_likeness(own, edited)) and math.isclose(got[i]["near_next"], brute_likeness(own, other)), i


def test_op3_positions(spark):
    t = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(t, "new start " + t, "To To To To " * 40)], "a string, b string, c string")
    for x in "abc":
        docs = syncmers.with_anchors(docs, x, f"{x}_an")
    m = syncmers.match_positions(docs, "a_an", "b_an", "m").select(syncmers.pairs_of(F.col("m")).alias("m")).first()["m"]
    assert len(m) > 20 and {x["right"] - x["left"] for x in m} == {3}
    m = syncmers.match_positions(docs, "c_an", "c_an", "m").select(syncmers.pairs_of(F.col("m")).alias("m")).first()["m"]  # repeated anchors: each once
    assert 0 < len(m) < 10 and all(x["left"] == x["right"] for x in m)


def test_op3_buckets_whatever_the_ids(spark):
    """One far id beside many neighbours doesn't put these in one bucket, and buckets rise with the ids."""
    ids = [*range(9000), 1 << 62, -(1 << 63), -(1 << 63) + 5]
    df = spark.createDataFrame([(i,) for i in ids], "key long")
    got = sorted((r["key"], r["b"]) for r in df.withColumn("b", syncmers._bucket(df, F.col("key"))).collect())
    assert [b for _, b in got] == sorted(b for _, b in got)
    assert max(collections.Counter(b for _, b in got).values()) < 6 * syncmers.DENSITY
    some = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    nxt = {int(r["text"]): int(r["next_text"]) for r in syncmers.with_next(some).collect()}
    order = sorted(ids, reverse=True)
    assert nxt == dict(zip(order, order[1:] + order[:1]))


def test_op4(spark, sf, docs):
    got = rows(Q["op4_quality"](spark, sf))
    for i in docs:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_op4_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = Q["op4_quality"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = got.count()
    assert n > 50 and got.where("predicted = quality").count() / n > 0.95


def fp(t):
    w = words(lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5(spark, sf, docs):
    got, ids = rows(Q["op5_simhash"](spark, sf)), sorted(docs)
    f = {i: fp(docs[i]) for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min(root[j] for j in ids if (f[i] ^ f[j]).bit_count() <= 4)
    assert {i: (got[i]["fingerprint"], got[i]["component_id"]) for i in ids} == {i: (f"{f[i]:016x}", root[i]) for i in ids}


def test_op5_chains_and_all_distances(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(150)]
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    groups = []
    for x in base:
        g = [x]
        for n in (1, 2, 3, 4, 4):
            g.append(flip(g[-1], n))
        groups.append(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in {x for g in groups for x in g}], "fp long")
    root = dict(simhash.link(df).collect())
    assert all(len({root[signed(x)] for x in g}) == 1 for g in groups) and len(set(root.values())) == 150


def test_golay_is_perfect():
    import numpy as np

    assert (np.bincount(simhash.golay()) == 2048).all()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    y = x ^ (1 << np.random.default_rng(1).integers(0, 23, 2000)) ^ (1 << np.random.default_rng(2).integers(0, 23, 2000))
    assert all(set(a) & set(b) for a, b in zip(simhash.fuzzy_keys(x).tolist(), simhash.fuzzy_keys(y).tolist()))


def test_op6(spark, sf, docs):
    got = rows(Q["op6_decontaminate"](spark, sf))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = collections.defaultdict(set)
    for k, t in [*enumerate(ITEM_TEXT), (0, "The quick-brown fox")]:
        w = cut(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows[tuple(w[s : s + n])].add(k)
    hits = 0
    for i, t in docs.items():
        w, hit, items = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    items |= windows[tuple(w[s : s + n])]
        hits += bool(hit)
        want = (len(w), len(hit), len(items), digest(",".join(sorted(map(str, items)))), bool(hit))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want, i
    assert hits >= 3


def test_op6_without_the_bitmap(spark, sf, monkeypatch):
    want = {tuple(r) for r in Q["op6_decontaminate"](spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "MOST", 1)
    assert {tuple(r) for r in Q["op6_decontaminate"](spark, sf).collect()} == want


def test_op7(spark, sf, docs):
    got = rows(Q["op7_gru_lm"](spark, sf))
    tok = {i: [*words(lower(t)), None] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = collections.Counter(w for i, t in tok.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tok.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    rep = collections.defaultdict(set)
    for i, t in docs.items():
        rep[t].add(round(got[i]["score"], 3))
    assert all(len(v) == 1 for v in rep.values())


def test_op7_tail_is_joined(spark, sf, monkeypatch):
    want = {r["doc_id"]: r["base_score"] for r in Q["op7_gru_lm"](spark, sf).collect()}
    monkeypatch.setattr(lm, "HEAD", 5)
    got = {r["doc_id"]: r["base_score"] for r in Q["op7_gru_lm"](spark, sf).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_op7_probabilities_sum_to_one():
    look = lm.Lookup(np.arange(300, dtype=np.uint64), np.arange(600, 300, -1), 200_000, 5000)
    net = lm.Network(look)
    r = np.random.default_rng(0)
    net.w["C"] = r.normal(0, 0.3, net.w["C"].shape).astype(np.float32)
    net.w["W"][:, :, :-1] = r.normal(0, 0.1, net.w["W"][:, :, :-1].shape)  # biases keep what fills the last class up out of it
    h = np.repeat(np.random.default_rng(1).normal(0, 1, (1, lm.HIDDEN + 1)).astype(np.float32), 301, axis=0)
    h[:, -1] = 1
    assert math.isclose(np.exp(net.log_probs(h, np.arange(301))).sum(), 1, rel_tol=1e-4)


def test_op7_beats_the_base_on_held_out(spark):
    r = Q["op7_gru_lm"](spark, "/root/testdata/sf0.01").where("held_out").selectExpr("avg(cast(score > base_score as int)) a", "sum(score) - sum(base_score) d").first()
    assert r["a"] > 0.9 and r["d"] > 0


def test_op8(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_file())
    got = rows(Q["op8_bpe"](spark, sf))
    for i, x in docs.items():
        e = t.encode(x, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(e), digest(",".join(map(str, e))), digest(t.decode(e, skip_special_tokens=False))), i


def plain(t):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op9(spark, sf, docs):
    got = rows(Q["op9_pii"](spark, sf))
    for i, t in docs.items():
        base = plain(t)
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert got[i]["base_sha256"] == digest(",".join(written)) and set(written) <= set(got[i]["spans"].split(",")) | {""}


def test_op9_patterns():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("0123456789@.+- ()aé%0123..1255@x4") for _ in range(r.randrange(0, 40)))
        assert sorted((a, k, b) for a, b, k in pii.base_spans(t)) == plain(t), t
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):  # linear on long runs
        pii.base_spans(t)


def test_op9_tagger_learns(spark):
    tagger = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts_ = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 9000 AND text RLIKE '[0-9@]'").limit(150).collect()]
    want = [{(a, b, k) for a, k, b in plain(t)} for t in texts_]
    got = [set(s) for s in pii.tagged_spans(tagger, texts_)]
    assert sum(len(w & g) for w, g in zip(want, got)) > 0.6 * sum(map(len, want))


def test_op9_redaction(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de or 10.0.0.1!", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, spans string")
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in pii.redact(df, None).collect()} == {1: ("to [EMAIL] or [IP]!", "x"), 2: (None, "y"), 3: ("", "z")}


def test_op10_takes_counted_tokens(spark):
    """Windows follow a column of counts, such as the encoder gives, instead of the estimate."""
    rows_ = [(1, t, ("user", "assistant")[t % 2], "word " * 30, 200) for t in range(6)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, n long")
    got = {k: chat.format_conversations(df, counted=k).count() for k in (None, "n")}
    assert got[None] < got["n"] == 3
    assert [r["n_tokens"] for r in chat.format_conversations(df, budget=100_000, counted="n").collect()] == [6 * (200 + chat.FRAME)]


def test_op10(spark, sf):
    convs = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    convs[-1] = [((True, n), role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in Q["op10_chat_windows"](spark, sf).collect()}
    assert got.keys() == convs.keys()
    for k, v in convs.items():
        v.sort()
        target = "".join(t for _, role, t in v if role == "assistant")
        want = (len(v), digest("".join(f"{role}\n{t}\n" for _, role, t in v)), len(target), digest(target))
        assert tuple(got[k][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want, k


def test_op10_windows(spark, sf):
    w = chat.format_conversations(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    assert any(r["n_repeated"] > 0 for r in w)
    for r in w:
        inside = re.findall(r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r["formatted"])
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in inside) == r["formatted"]
        own = inside[r["n_repeated"] :]
        assert r["n_tokens"] <= chat.BUDGET or len(own) == 1
        assert [r["formatted"][x["start"] : x["start"] + x["length"]] for x in r["loss"]] == [b for a, b in own if a == "assistant"]


def test_repeated_and_null_ids(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rep"))
    long_ = " ".join(f"w{i}" for i in range(120))
    data = [(1, long_), (1, long_), (1, "other text " + long_), (None, long_), (None, None), (2, "q " + long_)]
    spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in data], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, long_), (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], ITEMS).write.parquet(f"{d}/benchmark.parquet")
    for name in sorted(Q):
        if not name.startswith("op10"):
            assert len(Q[name](spark, d).collect()) == len(data), name
    from voxelweave.llm.common import table

    kept = rlz.deduplicate(table(spark, d, "documents")).select("doc_id", "n_removed", "kept").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in kept) == [(False, 1, 120), (False, 1, 120), (False, 1, 120), (False, 2, 120), (True, 0, 0), (True, 0, 0)]
