"""What the network of op7 is trained on."""

import numpy as np
import pytest

from voxelweave.llm import lm


@pytest.mark.parametrize("batch", [16, 512])
def test_lanes_learn_every_token_once_with_the_state_carried(batch, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", batch)
    r = np.random.default_rng(0)
    docs = [r.integers(0, 50, n).astype(np.int32) for n in (1, 31, 32, 33, 64, 1000, *r.integers(1, 200, 300))]
    seen = []

    def watch(ids, h, numbers):
        for row, state, k in zip(ids, h, numbers.tolist()):
            y = row[1:]
            n = int((y >= 0).sum())
            assert (y[n:] < 0).all() and n
            seen.append((k, int(row[0]), y[:n].tolist(), state.tolist()))
        return h + 1

    lanes = lm.Lanes(watch)
    for lo in range(0, len(docs), 70):
        lanes.take(docs[lo : lo + 70])
    lanes.take([], last=True)
    want = []
    for i, d in enumerate(docs):
        for k, t in enumerate(range(0, len(d), lm.CHUNK)):
            want.append((i, int(d[t - 1]) if t else 0, d[t : t + lm.CHUNK].tolist(), [float(k)] * lm.HIDDEN + [float(k + 1)]))
    assert sorted(seen) == sorted(want)


def test_the_model_has_seen_the_tokens_of_all_training_texts(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 40, 600))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as key", "doc_id", "text")
    written, real = [], lm.cut
    monkeypatch.setattr(lm, "cut", lambda df: written.append(real(df)) or written[-1])
    total = lm.score(docs.union(docs.limit(20)), docs).first()["train_tokens"]
    weights = next(df for df in written if "w" in df.columns)
    assert weights.selectExpr("sum(n)").first()[0] == total > 601 * 50


def test_the_network_tells_rarer_tokens_apart():
    look = lm.Lookup(np.arange(6000, dtype=np.uint64), np.arange(12000, 6000, -1), 60_000_000, 6000)
    net = lm.Network(look)
    rare = np.array([3000, 4095])
    assert net.size == 4096 and net.w["R"].shape == (33, 96) and (rare < net.size).all()
    r = np.random.default_rng(0)
    net.w["W"] = r.normal(0, 0.3, net.w["W"].shape).astype(np.float32)
    one, two = (net.log_probs(np.repeat(r.normal(0, 1, (1, lm.HIDDEN + 1)).astype(np.float32), 2, axis=0), rare) for _ in range(2))
    assert (np.abs(one - two) > 1e-3).all()


def small_network(seed=0, tokens=150):
    """A network of random weights in double precision, all but its last class full."""
    look = lm.Lookup(np.arange(tokens, dtype=np.uint64), np.arange(2 * tokens, tokens, -1), 2 * sum(range(tokens, 2 * tokens)), tokens)
    net, r = lm.Network(look), np.random.default_rng(seed)
    net.w = {k: (v + r.normal(0, 0.2, v.shape)).astype(float) for k, v in net.w.items()}
    return net


def plain(net, ids):
    """Log probability of one document, token by token."""
    w, h, before, total = net.w, np.zeros(lm.HIDDEN), 0, 0.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - np.log(np.exp(v).sum())
    n = lm.HIDDEN
    for y in ids.tolist():
        a, u = w["E"][before] @ w["X"], np.append(h, 1) @ w["R"]
        z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        h = (1 - z) * new + z * h
        s = np.append(h, 1)
        c = net.classes if y == net.size else y // lm.CLASS
        total += soft(s @ w["C"])[c]
        if y < net.size:
            total += soft(w["W"][c] @ s)[y % lm.CLASS]
        before = y
    return total


def test_scores_are_those_of_a_plain_forward_pass():
    net, r = small_network(), np.random.default_rng(3)
    sizes = [1, 2, 63, 64, 65, 200, 1]
    ids = r.integers(0, net.size + 1, sum(sizes))
    at = np.concatenate(([0], np.cumsum(sizes)))
    got = lm.document_log_probs(net, ids, at)
    scorer, parts = lm.Scorer(net), []  # the same, as they come
    for a, b in zip(at, at[1:]):
        scorer.take([ids[a:b]])
    assert scorer.done(len(sizes)) is None
    scorer.take([], last=True)
    for _ in sizes:
        parts += scorer.done(1).tolist()
    assert np.allclose(parts, got)
    want = [plain(net, ids[a:b]) for a, b in zip(at, at[1:])]
    assert np.allclose(got, want, rtol=1e-4)


def test_gradients_against_differences():
    net, r = small_network(1), np.random.default_rng(4)
    x = r.integers(0, net.size + 1, (5, 7))
    y = np.where(np.arange(7) < np.array([7, 3, 7, 1, 5])[:, None], r.integers(0, net.size + 1, (5, 7)), -1)
    h = lm._start(5)
    h[:, :-1] = r.normal(0, 0.5, (5, lm.HIDDEN))

    def loss():
        out, _ = net.steps(x, h)
        real = y.T.ravel() >= 0
        return -net.log_probs(out[1:].reshape(-1, lm.HIDDEN + 1)[real].astype(float), y.T.ravel()[real]).sum()

    grad, _ = net.gradients(x, y, h)
    for name, v in net.w.items():
        direction = r.normal(0, 1, v.shape)
        kept, e = v.copy(), 3e-3
        net.w[name] = kept + e * direction
        up = loss()
        net.w[name] = kept - e * direction
        down = loss()
        net.w[name] = kept
        assert np.isclose((up - down) / (2 * e), (grad[name] * direction).sum(), rtol=2e-2, atol=2e-2), name


def test_training_lowers_the_loss():
    """A language in which each token says what comes next."""
    look = lm.Lookup(np.arange(64, dtype=np.uint64), np.full(64, 1000), 64000, 64)
    net = lm.Network(look)
    docs = [np.array([(s + 5 * k) % 64 for k in range(200)], dtype=np.int32) for s in range(400)]
    at = np.arange(0, 201, 200)
    before = lm.document_log_probs(net, docs[0].astype(np.int64), at)[0]
    lanes = lm.Lanes(lm.Trainer(net, 0.01).chunk)
    for _ in range(12):
        lanes.take(docs)
    lanes.take([], last=True)
    assert lm.document_log_probs(net, docs[0].astype(np.int64), at)[0] > 0.7 * before


def test_weights_are_averaged_in_rounds(spark, monkeypatch):
    """Groups of two, and so several rounds, give what one round gives."""
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 60, 40))) for i in range(200)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    table = lm.counts(docs).orderBy("c", "th").toArrow()
    look = lm.Lookup(np.asarray(table.column("th")).view(np.uint64).copy(), np.asarray(table.column("c")), int(np.asarray(table.column("c")).sum()), table.num_rows)
    one = lm.fit(docs, look).w
    monkeypatch.setattr(lm, "FANIN", 2)
    two = lm.fit(docs, look).w
    start = lm.Network(look).w
    for name in one:
        assert np.allclose(one[name], two[name], atol=1e-5), name
    assert any(np.abs(one[name] - start[name]).max() > 1e-3 for name in one)
