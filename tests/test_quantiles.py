"""Exact percentiles by refining histograms."""

import math

import numpy as np
import pytest

from specband.functions.scale import quantiles

PROBS = {"lo": 0.0, "p5": 0.05, "mid": 0.5, "q": 0.73, "p99": 0.99, "hi": 1.0}


def expected(values):
    x = np.sort(np.array(values, float))
    out = []
    for p in PROBS.values():
        pos = p * (len(x) - 1)
        a, b = x[math.floor(pos)], x[math.ceil(pos)]
        out.append(float(a + (b - a) * (pos - math.floor(pos))))
    return out


CASES = {
    "normal": np.random.default_rng(0).normal(size=3000),
    "ties": np.random.default_rng(1).integers(-3, 4, 2000).astype(float),
    "one": np.array([4.25]),
    "same": np.full(500, -7.5),
    "wide": np.r_[np.random.default_rng(2).normal(size=400) * 10.0 ** np.random.default_rng(3).integers(-300, 300, 400), 0.0, -0.0, 5e-324],
    "narrow": 1e9 + np.arange(4000) * 1e-6,
    "hot": np.r_[np.full(3000, 1.0), np.nextafter(1.0, 2.0), np.arange(40.0)],
}


def test_every_group_is_exact(spark):
    rows = [(g, float(v)) for g, vs in CASES.items() for v in vs]
    rows += [("normal", None), ("normal", float("nan")), ("void", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {r.g: [r[c] for c in PROBS] for r in quantiles(df, "value", PROBS, ["g"]).collect()}
    assert set(got) == {*CASES, None}
    for g, vs in [*CASES.items(), (None, [3.0, 5.0])]:
        assert got[g] == pytest.approx(expected(vs), rel=1e-12, abs=0), g


def test_whole_table_and_nothing(spark):
    df = spark.createDataFrame([(int(v),) for v in np.random.default_rng(4).integers(0, 10**6, 5000)], "n bigint")
    got = quantiles(df, "n", PROBS).collect()
    assert len(got) == 1 and list(got[0]) == pytest.approx(expected([r.n for r in df.collect()]), rel=1e-12)
    assert quantiles(df.where("n < 0"), "n", PROBS).collect() == [] or all(v is None for v in quantiles(df.where("n < 0"), "n", PROBS).first())


def test_infinities(spark):
    df = spark.createDataFrame([(x,) for x in (math.inf, 1.0, 2.0, 3.0, -math.inf)], "value double")
    assert list(quantiles(df, "value", {"a": 0.25, "m": 0.5, "b": 0.75}).first()) == [1.0, 2.0, 3.0]


def test_rows_are_neither_sorted_nor_written(spark):
    df = spark.range(100_000).selectExpr("id % 3 AS g", "sqrt(id) AS value")
    out = quantiles(df, "value", {"m": 0.5}, ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
