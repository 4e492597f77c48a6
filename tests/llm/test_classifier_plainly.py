"""Scores and one step of training of the quality classifier, written out plainly."""

import numpy as np

from rowtide.llm import quality_classifier as qc

SETTINGS = qc.Settings(buckets=1 << 10, epochs=1)
TEXTS = ["Plain words here, plain words.", "", "   ", "one", "same same same", "É ünï 中文 \U0001f600 x", "LOUD!!! " * 40, "a\tb\nc d"]


def plain_buckets(text):
    """Every feature of a text by itself: of each word alone, then of each pair."""
    words = qc.WORD.findall(text)
    single = [qc.word_features([w], SETTINGS) for w in words]
    out = [int(b) for buckets, _, _ in single for b in buckets]
    for (_, _, left), (_, _, right) in zip(single, single[1:]):
        out.append(int(qc.pair_buckets(np.concatenate([left, right]), SETTINGS)[0]))
    return out


def test_scores_are_means_through_a_softmax(spark):
    values = np.random.default_rng(1).normal(size=SETTINGS.buckets).astype(np.float32)
    rows = qc.quality_scores(spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING"), (values, 0.3), SETTINGS).collect()
    for r in rows:
        buckets = plain_buckets(r["text"])
        odds = np.mean([float(values[b]) for b in buckets]) + 0.3 if buckets else 0.3
        classes = np.exp([0.0, odds])
        assert abs(r["score"] - classes[1] / classes.sum()) < 1e-9


def test_memory_that_is_cleared_changes_no_score():
    values = np.random.default_rng(2).normal(size=SETTINGS.buckets)
    texts = [f"w{i} x{i % 3} {t}" for i in range(50) for t in TEXTS]
    once = qc.Features(values, SETTINGS).score(texts)
    small = qc.Features(values, SETTINGS, kept=20)
    assert np.allclose(once, np.concatenate([small.score(texts[i : i + 7]) for i in range(0, len(texts), 7)]))


def test_first_step_follows_the_gradient():
    """Output weights start at zero: both classes are equally likely, so the first step moves
    them along the document's mean vector by half the rate."""
    text = TEXTS[0]
    values, bias = qc.train([text], [1], SETTINGS)
    vectors = np.random.default_rng(SETTINGS.seed).uniform(-1, 1, (SETTINGS.buckets, SETTINGS.width)) / SETTINGS.width
    mean = np.mean([vectors[b] for b in plain_buckets(text)], axis=0)
    error = np.array([0.5, -0.5])
    output = -SETTINGS.rate * np.outer(mean, error)
    assert np.allclose(values, vectors @ (output[:, 1] - output[:, 0]), atol=1e-6)
    assert abs(bias - SETTINGS.rate * 0.1) < 1e-9


def test_steps_lower_the_loss():
    texts, labels = [TEXTS[0], TEXTS[6]] * 10, [1, 0] * 10
    losses = []
    for epochs in (1, 3, 6):
        settings = qc.Settings(buckets=1 << 10, epochs=epochs)
        values, bias = qc.train(texts, labels, settings)
        odds = qc.Features(values, settings).score(texts) + bias
        losses.append(float(np.mean(np.log1p(np.exp(np.where(np.array(labels) == 1, -odds, odds))))))
    assert losses[0] > losses[1] > losses[2]
