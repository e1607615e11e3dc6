"""Oversampled starting centres and fits in lockstep."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.operators import classify as cl, kmeans as km


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>").repartition(parts).persist()


def test_equal_rows_weigh_as_many(spark):
    x = np.vstack([np.repeat([[0.0, 0.0]], 900, 0), np.repeat([[10.0, 0.0]], 60, 0), np.repeat([[0.0, 10.0]], 40, 0)])
    df = frame(spark, x)
    first = []
    for seed in range(30):  # the first, uniform draw: nine of ten candidates are the common row
        run = km.Run(np.arange(2), 1, seed)
        km.draw_candidates(df, [run], lambda v: v, 0)
        first += run.centers.tolist()
    share = np.mean([c == [0.0, 0.0] for c in first])
    assert len(first) == 30 * km.OVER and 0.75 < share <= 1.0
    runs = km.lockstep(df, [km.Run(np.arange(2), 3, s) for s in range(4)], lambda v: v, 50, 1e-9)
    assert all(r.cost == pytest.approx(0, abs=1e-9) and r.filled == 3 for r in runs)


def test_passes_do_not_depend_on_k(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(1).normal(size=(300, 3)))
    calls = []
    plain = km.draw_candidates
    monkeypatch.setattr(km, "draw_candidates", lambda *a: calls.append(1) or plain(*a))
    for k in (2, 20):
        calls.clear()
        km.spread_centers(df, [km.Run(np.arange(3), k, 0)], lambda v: v)
        assert len(calls) == km.ROUNDS + 1


def test_planted_groups_are_found_by_every_start(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(8, 5)) * 20
    x = np.vstack([c + r.normal(size=(50, 5)) for c in centre])
    best = sum(((x[i * 50:(i + 1) * 50] - x[i * 50:(i + 1) * 50].mean(0)) ** 2).sum() for i in range(8))
    runs = km.lockstep(frame(spark, x), [km.Run(np.arange(5), 8, s) for s in range(5)], lambda v: v, 100, 1e-9)
    assert min(run.cost for run in runs) == pytest.approx(best, rel=1e-9) and sorted(run.cost for run in runs)[2] < 1.5 * best


def test_fewer_rows_than_clusters(spark):
    df = frame(spark, [[1.0, 1.0], [1.0, 1.0], [5.0, 5.0]])
    run = km.best_of(km.lockstep(df, [km.Run(np.arange(2), 4, 0)], lambda v: v, 10, 1e-9))
    assert run.centers.shape == (4, 2) and run.cost == 0 and run.filled == 2
    assert cl.kmeans_large(df, 3, use_pca=False).select("cluster").distinct().count() == 2
    assert km.lockstep(df.where("pixel_id > 9").persist(), [km.Run(np.arange(2), 2, 0)], lambda v: v, 5, 1e-9) == []


def test_noise_differs_by_row_without_warnings():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        a, b = km.row_noise(0, 2000, 42), km.row_noise(1000, 1000, 42)
    assert len(set(a.tolist())) == 2000 and (a[1000:] == b).all() and 0.45 < a.mean() < 0.55 and a.min() > 0


def test_all_runs_are_labelled_in_one_pass(spark):
    x = np.random.default_rng(6).normal(size=(200, 3))
    df = frame(spark, x)
    runs = {f"c{k}": km.Run(np.arange(3), k, 0, x[:k]) for k in (1, 2, 5, 9)}
    out = km.labels(df, runs, lambda v: v)
    assert out.columns == ["pixel_id", "spectrum", *runs]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for r in out.collect():
        d = ((x[r.pixel_id] - x) ** 2).sum(1)
        assert [r[f"c{k}"] for k in (1, 2, 5, 9)] == [int(d[:k].argmin()) for k in (1, 2, 5, 9)]
    assert km.label(df.where("pixel_id < 0"), runs["c2"], lambda v: v, "z").columns == ["pixel_id", "spectrum", "z"]


def test_sweep_labels_in_one_pass(spark, monkeypatch):
    calls, plain = [], cl.nearest_labels
    monkeypatch.setattr(cl, "nearest_labels", lambda *a: calls.append(len(a[1])) or plain(*a))
    df = frame(spark, np.random.default_rng(7).normal(size=(90, 2))).withColumn("class", F.col("pixel_id") % 2)
    got = cl.kmeans_k_sweep(df, [2, 3, 4], "class", n_init=2).orderBy("k").collect()
    assert calls == [3] and [r.k for r in got] == [2, 3, 4] and all(0.5 <= r.purity <= 1 for r in got)
