"""Factorizations of many band sets in lockstep."""

import numpy as np
import pytest

from specband.operators import unmix as um


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(21)
    x = r.random((240, 3)) @ r.random((3, 16)) + 0.01 * r.random((240, 16))
    return spark.createDataFrame([(i, "a" if i % 2 else "b", i // 20, i % 20, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "pixel_id BIGINT, scan_id STRING, y INT, x INT, spectrum ARRAY<DOUBLE>").repartition(3), x


SETS = [(np.arange(4), 2), (np.arange(4, 8), 2), (np.r_[0:4, 8:12], 3), (np.arange(16), 3), (np.array([5]), 1)]


@pytest.mark.parametrize("init", ["svd", "pca", "random", "farthest", "nmf"])
def test_lockstep_equals_one_by_one(mixed, init):
    df, x = mixed
    many = um.fit_many(df, SETS, max_iter=12, tol=1e-9, init=init, method="nnls")
    for (cols, k), fit in zip(SETS, many):
        part = df.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x[:, cols])], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>")
        one = um.fit_mcr(part, k, max_iter=12, tol=1e-9, init=init, method="nnls")
        assert len(fit.errors) == len(one.errors) and fit.errors == pytest.approx(one.errors, rel=1e-6, abs=1e-12)
        assert fit.profiles == pytest.approx(one.profiles, rel=1e-4, abs=1e-6)


def test_passes_do_not_grow_with_the_sets(mixed, monkeypatch):
    df, _ = mixed
    calls = []
    plain = um.matrix_sum
    monkeypatch.setattr(um, "matrix_sum", lambda *a, **b: calls.append(1) or plain(*a, **b))
    um.fit_many(df, SETS[:1], max_iter=4, tol=0.0, init="svd")
    one = len(calls)
    um.fit_many(df, SETS, max_iter=4, tol=0.0, init="svd")
    assert one == 4 and len(calls) == 2 * one
    assert um._batches([3, 3, 3, 9, 1], 6) == [[0, 1], [2], [3], [4]]


def test_stop_rules(mixed):
    df, _ = mixed
    full = um.fit_mcr(df, 3, max_iter=25, tol=0.0, init="svd")
    below = um.fit_mcr(df, 3, max_iter=25, tol=full.errors[4] * 1.0000001, init="svd", stop="error")
    assert len(full.errors) == 25 and len(below.errors) <= 5 and below.errors[-1] < full.errors[4] * 1.0000001
    assert um.fit_mcr(df, 3, max_iter=0, init="svd").errors == []


def test_fold_keeps_the_scan(mixed):
    df, x = mixed
    got = {(r.scan_id, r.y, r.x, r.component): r.value for r in um.fold(df, "spectrum").collect()}
    assert len(got) == x.size and got["a", 1, 1, 3] == x[21, 3]


def test_nmf_of_many_sets(mixed):
    df, x = mixed
    for (cols, k), fit in zip(SETS, um.nmf_many(df, SETS, max_iter=6, tol=0.0, seed=3)):
        part = df.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x[:, cols])], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>")
        assert fit.errors == pytest.approx(um.nmf(part, k, max_iter=6, tol=0.0, seed=3).errors, rel=1e-6, abs=1e-12)
