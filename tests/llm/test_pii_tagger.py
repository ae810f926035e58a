"""The tagger of op9: its CRF against enumeration, one path over overlapping windows, and what it adds to the patterns."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from voxelweave.llm import common, pii


def small(seed):
    tagger, r = pii.Tagger(seed), np.random.default_rng(seed)
    tagger.w["A"] = r.normal(0, 1, tagger.w["A"].shape)
    tagger.w["S"] = r.normal(0, 1, tagger.w["S"].shape)
    return tagger


def test_loss_against_enumeration(monkeypatch):
    tagger, r = small(1), np.random.default_rng(2)
    ids, tags = r.integers(0, 128, (2, 4)), r.integers(0, pii.K, (2, 4))
    e, _ = tagger.emissions(ids)
    w = tagger.w
    path = lambda e, t: w["S"][t[0]] + sum(e[i, k] for i, k in enumerate(t)) + sum(w["A"][a, b] for a, b in zip(t, t[1:]))
    want = [np.log(sum(np.exp(path(x, t)) for t in itertools.product(range(pii.K), repeat=4))) - path(x, y) for x, y in zip(e, tags)]
    assert np.isclose(tagger.gradients(ids, tags)[0], np.mean(want))


def test_gradients_against_differences():
    tagger, r = small(3), np.random.default_rng(4)
    ids, tags = r.integers(0, 128, (3, 9)), r.integers(0, pii.K, (3, 9))
    _, grad = tagger.gradients(ids, tags)
    for name, v in tagger.w.items():
        d, e, kept = r.normal(0, 1, v.shape), 1e-5, v.copy()
        loss = []
        for s in (1, -1):
            tagger.w[name] = kept + s * e * d
            loss.append(tagger.gradients(ids, tags)[0])
        tagger.w[name] = kept
        assert np.isclose((loss[0] - loss[1]) / (2 * e), (grad[name] * d).sum(), rtol=1e-3, atol=1e-6), name


def test_viterbi_against_enumeration():
    tagger, r = small(5), np.random.default_rng(6)
    size = np.array([1, 3, 4, 2])
    e = r.normal(0, 2, (4, 4, pii.K))
    got = tagger.paths(e, size)
    a = tagger.w["A"]
    for x, n, tags in zip(e, size, got):
        score = lambda t: a[0, t[0]] + sum(x[i, k] for i, k in enumerate(t)) + sum(a[p, q] for p, q in zip(t, t[1:])) + a[t[-1], 0]  # noqa: B023, E731
        assert tuple(tags[:n]) == max(itertools.product(range(pii.K), repeat=int(n)), key=score) and not tags[n:].any()


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def held(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 5000 AND text IS NOT NULL").orderBy("doc_id").limit(3000).collect()]


def added(tagger, texts):
    for text, found in zip(texts, pii.tagged_spans(tagger, texts)):
        base = pii.base_spans(text)
        yield [s for s in found if all(s[1] <= a or s[0] >= b for a, b, _ in base)], base


def test_it_adds_rewritten_spans_on_documents_that_it_did_not_see(tagger, held):
    pairs = [pii.examples(i, t, random.Random(i)) for i, t in enumerate(held)]
    pairs = [p[1] for p in pairs if len(p) > 1]
    right = wanted = more = 0
    for (own, base), (_, gold) in zip(added(tagger, [t for t, _ in pairs]), pairs):
        missed = {s for s in gold if s not in base}
        wanted += len(missed)
        right += len(missed & set(own))
        more += len(own)
    assert wanted > 100 and right > 0.75 * wanted and right > 0.85 * more


def test_it_adds_nothing_to_texts_without_them(tagger, held):
    assert sum(len(own) for own, _ in added(tagger, held)) <= 3


def test_windows_agree_whatever_is_before(tagger):
    """A span is found at every offset from the window borders, and far from the text's start."""
    core = "thre an the.65 (at) mail7 dot example dot com the reon"
    found = {(core.index("the.65"), core.index(" the reon"))}
    for shift in (0, 5, 17, 31, 32, 40, 63, 64, 1000):
        got = pii.tagged_spans(tagger, ["a" * shift + " " + core])[0]
        assert {(a - shift - 1, b - shift - 1) for a, b, k in got if k == 0} == found, shift


def test_a_long_text_is_one_path(tagger):
    text = ("on the er. " * 5000) + "card 4111  1111  1111  1111 to " + ("on the er. " * 5000)
    assert [text[a:b] for a, b, k in pii.tagged_spans(tagger, [text])[0]] in ([], ["4111  1111  1111  1111"])
    assert pii.tagged_spans(tagger, ["1 " * 20_000]) is not None


def test_redaction_keeps_a_column_of_any_name(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de", "x", "y")], "doc_id long, text string, pii_spans string, pii_spans_ string")
    assert [tuple(r) for r in pii.redact(df, None).collect()] == [(1, "to [EMAIL]", "x", "y")]


def test_scores_are_emissions():
    tagger, r = small(7), np.random.default_rng(8)
    cells = r.integers(0, pii._PAD + 1, (6, pii.STRIDE))
    want, _ = tagger.emissions(np.concatenate((cells[:-1], cells[1:]), axis=1))
    assert np.allclose(tagger.scores(cells).transpose(2, 0, 1), want, atol=1e-4)


def test_every_character_is_judged_by_one_path(tagger):
    """Emissions of all windows of each text, averaged, and one path over all of it, give the spans that are found."""
    texts = ["", "a", "no trigger in here at all " * 9, "on maria.lo at mail.com er. " * 5, "to 4111  1111  1111  1111 the " * 40]
    got, side = pii.tagged_spans(tagger, texts), (pii.WIDTH - pii.STRIDE) // 2
    for text, found in zip(texts, got):
        k = np.arange(-(-len(text) // pii.STRIDE))
        e, times = np.zeros((len(text), pii.K)), np.zeros(len(text))
        for own, part in zip(k.tolist(), tagger.emissions(pii.cut_windows(pii.codes(text), k, pii._PAD))[0] if len(k) else ()):
            at = np.arange(pii.WIDTH) + own * pii.STRIDE - side
            inside = (at >= 0) & (at < len(text))
            e[at[inside]] += part[inside]
            times[at[inside]] += 1
        if not text:
            assert found == []
            continue
        e /= times[:, None]
        spans = pii._read(tagger.paths(e[None], np.array([len(text)]))[0], e, 0)
        whole = dict.fromkeys((*pii._whole(c, text, a, b), c) for a, b, c in spans)
        assert found == [s for s in whole if pii._reads_as(s[2], text[s[0] : s[1]])]


def test_a_span_without_a_trigger_is_found():
    """A tagger that takes everything for an address sees a text without digit, @, bracketed "at" or "dot"."""
    tagger = pii.Tagger()
    tagger.w["o"][2] = 50
    text = "maria.lo at mail.com"
    assert not pii._TRIGGER.search(text) and pii.tagged_spans(tagger, [text]) == [[(0, len(text), 0)]]


def test_tasks_use_one_thread(spark):
    def run(batches):
        common.one_thread()
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([get() for get in common.blas("get_num_threads")], pa.int64())], names=["n"])

    got = [r["n"] for r in spark.range(1).mapInArrow(run, "n long").collect()]
    assert got and set(got) == {1}


def test_what_is_certain_is_o_on_the_path():
    r, some = np.random.default_rng(9), 0
    for seed in range(60):
        tagger, n = small(seed), 30
        e = r.normal(0, 1.5, (1, n, pii.K)).astype(np.float32)
        e[:, :, 0] += 4
        path = tagger.paths(e, np.array([n]))[0]
        for x, y in ((0, n), (7, 19)):  # whole, and a part between places that aren't known
            sure = pii.certain(tagger.w["A"], np.arange(x, y), e[0, x:y], x > 0, y < n)
            assert not path[x:y][sure].any()
            some += sure.sum()
    assert some > 100


def test_windows_run_at_a_time_fit_the_quick_product():
    h, d = pii.Tagger.H, pii.Tagger.D
    assert 4 * h * (h + d + 1) * pii.PART <= 1_000_000


def test_spans_of_several_paths_are_read_at_once():
    tags = np.array([0, 1, 2, 2, 2, 4, 0, 3, 3, 0, 5])  # the second path begins at 4, the third at 8
    e = np.zeros((len(tags), pii.K), dtype=np.float32)
    e[np.arange(len(tags)), tags] = 2
    e[7, 3] = 0.5  # too little
    assert pii._read(tags, e, np.array([0, 4, 8])) == [(1, 4, 0), (4, 5, 0), (5, 6, 1), (8, 9, 1), (10, 11, 2)]
