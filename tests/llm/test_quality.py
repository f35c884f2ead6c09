import zlib

import numpy as np
import pytest

from rasterlake.llm import quality


def blobs(n, share, seed, gap=4.0):
    """``n`` points of which ``share`` are positives, ``gap`` apart from the others."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < share
    return rng.normal(size=(n, quality.N_FEATURES)) + gap * (y[:, None] * (np.arange(quality.N_FEATURES) < 3)), y


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.9])
def test_prior_against_a_known_one(share):
    pos, _ = blobs(12_000, 1.0, 1)
    unl, _ = blobs(12_000, share, 2)
    assert quality.estimate_prior(pos, unl) == pytest.approx(share, abs=0.06)


@pytest.mark.parametrize("n", [1, 2, 5, 19])
def test_prior_of_few_rows(n):
    pos, _ = blobs(n, 1.0, 1)
    unl, _ = blobs(n, 0.5, 2)
    assert 0.05 <= quality.estimate_prior(pos, unl) <= 0.95
    assert np.isfinite(quality.fit(pos, unl).score(unl)).all()


def test_risk_below_zero_is_stepped_back():
    """With a prior of 0.9 and unlabelled rows that are all positives the unbiased risk falls below zero; the fit does not follow it."""
    pos, _ = blobs(60, 1.0, 1)
    unl, y = blobs(400, 0.5, 2)
    net = quality._train(pos, unl, 0.9, 600, 12, 7)
    up, un = net.score(unl[y]), net.score(unl[~y])
    loss = -np.log1p(-np.minimum(net.score(unl), 1 - 1e-9))
    risk = loss.mean() - 0.9 * (-np.log1p(-np.minimum(net.score(pos), 1 - 1e-9))).mean()
    assert risk > -1.0 and up.mean() > un.mean()
    net = quality._train(pos, unl, 0.5, 600, 12, 7)
    assert ((net.score(unl) >= 0.5) == y).mean() > 0.85


def test_labels_of_held_out_rows_and_zeros_change_nothing(spark):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(400):
        good = i % 2 == 0
        docs.append((i, " ".join(("word%d" % rng.integers(0, 300)) if good else "$$$ BUY NOW" for _ in range(30)), "s" if good else "t"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    base = [(i, 1) for i in range(0, 400, 2) if i % 3 == 0 and not held(i)]
    zeros = [i for i in range(1, 400, 2) if i % 3 == 0 and not held(i)]

    def scores(labels, frame=df):
        out = quality.classify_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), keep=["doc_id"]).collect()
        return {r.doc_id: r.score for r in out}

    one = scores(base + [(i, 0) for i in zeros])
    assert one == scores(base + [(i, 0) for i in zeros] + [(i, i % 2) for i in range(400) if held(i)])
    assert one == scores(base + [(i, -3) for i in zeros])
    from pyspark.sql import functions as F

    assert one == scores(base + [(i, 0) for i in zeros], df.withColumn("source", F.lit("u")))
    assert np.mean([one[i] for i in range(0, 400, 2)]) > np.mean([one[i] for i in range(1, 400, 2)])


def test_long_texts_and_bounded_samples(spark):
    docs = spark.createDataFrame([(i, "some plain words, and more. " * (1 if i else 40_000)) for i in range(60)], "doc_id long, text string").withColumnRenamed("text", "t")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    out = quality.classify_quality(docs, labels, text="t", sample=5, unlabelled=7).collect()
    assert len(out) == 60 and all(0 <= r.score <= 1 for r in out)
