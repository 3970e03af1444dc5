"""Quality classifier and class language model: held-out results and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd_rows, prose
from tidegauge.llm import class_lm, quality


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(key, folds, fold):
    return key is None or zlib.crc32(str(key).encode()) % folds == fold


def labelled(spark, n=240):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randint(20, 160))
        if bad:  # junk in one stretch only
            words = text.split(" ")
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], *[w.upper() + "!!" for w in words[at : at + 80]], *words[at:]])
        docs.append((i, text, "src", "en", 0.5))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 240 and all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.9 * len(out)
    # Only text counts, and the sample decides the model: other columns and other order change nothing.
    other = docs.selectExpr("doc_id", "text", "'x' AS source", "null AS lang", "1.0 AS score").repartition(5)
    again = {r.doc_id: r.score for r in quality.classify(other, labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-5) for r in rows)


def test_scores_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n).encode() for n in (1, 500, 3000, 20)] + [b"", b"ab"]
    features, counts = quality.describe(texts[:2] * 3)
    model = quality.fit(features, counts, np.array([0, 1, 0, 1, 0, 1.0]), epochs=1)
    whole = model.score(texts)
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", 1300)
    assert np.allclose(model.score(texts), whole, atol=1e-6)
    assert np.allclose([model.score([t])[0] for t in texts], whole, atol=1e-6)


def test_quality_learns_from_every_passage(spark, monkeypatch):
    """Long documents keep all their passages, in order, in however many rounds they are collected."""
    rng = random.Random(9)
    texts = {i: prose(rng, n) for i, n in enumerate([5, 3000, 40, 6000, 20, 900, 9000, 30])} | {40: "long text " * 130_000, 41: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    ids = [i for i in texts if not held(i, 3, 1)]
    want, sizes = quality.describe([texts[i].encode() for i in ids])
    assert max(sizes) > 24
    for at_once in (quality.PASSAGES_AT_ONCE, 40):
        monkeypatch.setattr(quality, "PASSAGES_AT_ONCE", at_once)
        features, counts, kinds = quality.sample(docs, labels, "quality", "doc_id", "text")
        assert list(counts) == list(sizes) and list(kinds) == [i % 2 for i in ids]
        assert np.array_equal(np.asarray(features), want.astype(np.float16))


def test_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    counts, labels = np.array([3, 1, 2]), np.array([1.0, 0.0, 1.0])
    shapes = {"encode": (6, 4), "encode0": (4,), "look": (4, 3), "look0": (3,), "gate": (4, 3), "gate0": (3,), "rate": (3,), "out": (4,), "out0": ()}
    w = {k: rng.standard_normal(s) for k, s in shapes.items()}
    fixed = {"mean": np.zeros(6), "scale": np.ones(6)}
    x = rng.standard_normal((6, 6))

    def run(w):
        f = quality._encode(w | fixed, x)
        return f | quality._pool(w, f["h"], f["e"], counts)

    def loss(w):
        p = quality._sigmoid(run(w)["logit"])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = quality._backward(w, run(w), labels)
    for k, g in grads.items():
        for at in np.ndindex(*np.shape(w[k])):
            up, down = {n: v.copy() for n, v in w.items()}, {n: v.copy() for n, v in w.items()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert np.asarray(g)[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(odd_rows()) if r[0] is not None] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None) and rows[0].item == "clash"
    assert quality.classify(empty, labels).collect() == []
    none = quality.classify(odd, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}


def check_lm(spark, docs, rows, **options):
    got = class_lm.class_lm(docs, **options).collect()
    counts = Counter(t for r in rows if not held(r[0], 5, 1) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        ts = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((str(r[0]), held(r[0], 5, 1), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)))
    assert Counter(want) == Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    return got


def test_lm_counts_and_base(spark, odd):
    got = check_lm(spark, odd, odd_rows(), clustered=30, shapes=8, classes=6, rounds=2, counted=60)
    assert all(r.score < 0 for r in got)
    # Where a count is looked up makes no difference.
    more = check_lm(spark, odd, odd_rows(), clustered=30, shapes=8, classes=6, rounds=2)
    assert sorted(round(r.score, 6) for r in got) == sorted(round(r.score, 6) for r in more)


def test_lm_probabilities_sum_to_one(spark):
    """All texts of one known or unknown word each: their chances to be the first token sum to 1."""
    rows = [(i, t) for i, t in enumerate(["a b c a", "b c", "c a a b d", "e a b", "a f"])]
    docs = spark.createDataFrame([r for r in rows if not held(r[0], 5, 1)], "doc_id long, text string")
    from tidegauge.llm.common import Scratch

    model, counts = class_lm.train(docs.select("text"), Scratch(spark, "t"), clustered=2, shapes=2, classes=4, rounds=1)
    assert np.allclose((10**model.step).sum(1), 1)
    kind = model.classes[model.types.of(model.counted)]  # the table is small: every word's count is at hand
    emitted = np.bincount(kind, model.emission(model.counts, model.class_words[kind], model.class_kinds[kind]), 4)
    unseen = model.emission(0, model.class_words, model.class_kinds)
    assert np.allclose(emitted + unseen, 1)
    assert model.class_words.sum() == model.tokens and model.class_kinds.sum() == model.kinds


def test_lm_finds_classes(spark):
    """Words of two kinds alternate: the classes must beat single-word frequencies by far, held out too."""
    rng = random.Random(2)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice((left, right)[k % 2]) for k in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_lm.class_lm(docs, classes=5, rounds=6).collect()
    out = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in out)
    base, own = sum(r.base_score for r in out) / n, sum(r.score for r in out) / n
    assert own > base + 0.2


def test_lm_gives_every_training_word_its_own_class(spark):
    """Words of two kinds alternate, all with the same last bytes: only an exchange of words tells them apart."""
    rng = random.Random(6)
    left, right = [f"l{i}same" for i in range(150)], [f"r{i}same" for i in range(150)]
    rows = [(i, " ".join(rng.choice((left, right)[k % 2]) for k in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_lm.class_lm(docs, classes=4, clustered=4, counted=10).collect()
    out = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.2


def test_best_classes_agree_with_exchange():
    rng = np.random.default_rng(8)
    n, k = 40, 6
    pairs = rng.integers(0, 4, (n, n)).astype(float) * (rng.random((n, n)) < 0.3)
    classes = np.append(rng.integers(0, k - 1, n - 1), k - 1)
    one = np.eye(k)[classes]
    before, after = (one.T @ pairs).T, pairs @ one
    joint = np.zeros((k, k))
    np.add.at(joint, classes, after)
    both = np.concatenate([before, after], axis=1)[:-1]
    word, code = np.nonzero(both)
    got = class_lm.best_classes(joint, classes[:-1], word, code, both[word, code])
    assert list(got) == list(class_lm.exchange(before, after, classes, np.arange(n - 1))[:-1])


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    n, k = 30, 5
    pairs = rng.integers(0, 20, (n, n)).astype(float)
    pairs[:15, 15:] *= 6
    pairs[15:, :15] *= 6
    classes = np.arange(n) % (k - 1)
    classes[-1] = k - 1

    def context(c):
        one = np.eye(k)[c]
        return (one.T @ pairs).T, pairs @ one

    def likelihood(c):
        one = np.eye(k)[c]
        joint = one.T @ pairs @ one
        return class_lm._plogp(joint).sum() - class_lm._plogp(joint.sum(1)).sum() - class_lm._plogp(joint.sum(0)).sum()

    start = likelihood(classes)
    for r in range(8):
        before, after = context(classes)
        t = np.array([r % (n - 1)])
        new = class_lm.exchange(before, after, classes, t)
        assert likelihood(new) >= likelihood(classes) - 1e-6 * abs(start) - 2 * pairs.max() * 10
        classes = new


def test_lm_of_empty_tables(spark, empty):
    assert class_lm.class_lm(empty).collect() == []
    unseen = next(i for i in range(100) if held(i, 5, 1))
    row = class_lm.class_lm(spark.createDataFrame([(unseen, "never seen")], "doc_id long, text string")).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.n_tokens == 3 and math.isfinite(row.score)
