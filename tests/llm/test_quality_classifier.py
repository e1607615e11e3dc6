"""Held-out accuracy, the parts of the fit, and odd inputs."""

import zlib

import numpy as np

from specband.llm import quality_classifier as qc


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable").astype(float)
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.quality_scores(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    test = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(test.score.to_numpy(), test.quality.to_numpy()) > 0.95
    assert (test.predicted == test.quality).mean() > 0.93


def test_pooling_is_monotone_and_keeps_means():
    assert qc.pooled(np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1])).tolist() == [0, 1 / 3, 1 / 3, 1]


def test_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 5))
    w, b = r.normal(size=(5, 40000)), r.uniform(0, 2 * np.pi, 40000)
    z = qc.fourier(x, np.zeros(5), np.ones(5), w, b)[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


def test_odd_rows(make, spark, odd_texts):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 19)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = qc.quality_scores(make(odd_texts + [(None, "no id")]), labels).toPandas()
    assert len(out) == len(odd_texts) + 1 and out.score.between(0, 1).all()
    none = labels.limit(0)
    assert set(qc.quality_scores(make(odd_texts), none).toPandas().score) == {0.5}
    assert qc.quality_scores(make([]), labels).count() == 0
