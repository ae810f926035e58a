"""The attention model of op4: its gradients, what it attends to, and that words and the bound on passages count."""

import numpy as np
import pyarrow as pa
import pytest

from voxelweave.llm import quality


def bags(n, seed=0):
    """Bags of noise; in those of label 0 one passage, at a known place, is off in two features."""
    r = np.random.default_rng(seed)
    size = r.integers(2, 9, n)
    edge = np.concatenate(([0], np.cumsum(size)))
    x, y = r.normal(0, 1, (edge[-1], quality.FEATURES)), r.integers(0, 2, n)
    tell = edge[:-1] + r.integers(0, size)
    x[tell[y == 0], :2] += 5
    return x, edge, y.astype(float), tell


def test_gradients_against_differences():
    x, edge, y, _ = bags(12)
    model, r = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), 1), np.random.default_rng(2)
    p, m = model.forward(x, edge)
    grad = model.gradients(y, p, m)

    def loss():
        p, _ = model.forward(x, edge)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, v in model.w.items():
        d, e, kept = r.normal(0, 1, v.shape), 1e-5, v.copy()
        model.w[name] = kept + e * d
        up = loss()
        model.w[name] = kept - e * d
        down = loss()
        model.w[name] = kept
        assert np.isclose((up - down) / (2 * e), (grad[name] * d).sum(), rtol=1e-4, atol=1e-8), name


def test_attention_picks_the_telling_passage():
    x, edge, y, _ = bags(1500)
    model = quality.train(x, edge, y)
    x, edge, y, tell = bags(300, 1)
    p, m = model.forward(x, edge)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95
    bad = np.flatnonzero(y == 0)
    share = m["att"][tell[bad]] * np.diff(edge)[bad]  # 1 if all passages weighed alike
    assert np.median(share) > 1.5


def test_words_are_features():
    a, _ = quality.passages(pa.array(["alpha beta gamma delta", "omega kappa sigma theta", None, ""]))
    assert not np.array_equal(a[0, 14:], a[1, 14:]) and a[0, 14:].any() and not a[2:].any()


def test_fit_takes_a_bounded_number_of_passages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, edge, y: seen.append(np.diff(edge)))
    text = " ".join(f"w{i}" for i in range(quality.PASSAGE * (quality.BAG + 40)))
    docs = spark.createDataFrame([(i, text if i % 2 else "short text") for i in range(40)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert set(seen[0].tolist()) == {1, quality.BAG}


@pytest.mark.parametrize("labels", [[], [1.0, 1.0]])
def test_without_two_classes_the_score_is_a_share(labels):
    model = quality.train(np.zeros((len(labels), quality.FEATURES)), np.arange(len(labels) + 1), np.array(labels))
    assert model.score(np.zeros((3, quality.FEATURES)), np.arange(4)).tolist() == [0.5 if not labels else 2.5 / 3] * 3
