"""The embedding join against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.llm import embedding_join as vectors
from specband.llm.components import components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, t=0.9):
    """``(vec_id, n_links, component_id, kept)`` of every row, and the number of links."""
    dim = max([len(v) for _, v in rows if v] + [1])
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    u = np.zeros((len(rows), dim))
    for k in fine:
        x = np.array(rows[k][1], np.float32).astype(float)
        u[k, :len(x)] = x / np.abs(x).max()
        u[k] /= np.linalg.norm(u[k])
    near = u @ u.T >= t
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        nxt = np.where(near, label[None, :], len(rows)).min(1, initial=len(rows))
        nxt = np.minimum(label, nxt)
        if (nxt == label).all():
            break
        label = nxt
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[k]) if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((d, int(near[k].sum()), low, d == low))
    return sorted(out, key=str), int(near.sum())


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    x = r.normal(size=(260, 24))
    around = lambda n, noise: (lambda c: c + noise * r.normal(size=(n, 24)))(r.normal(size=24))
    body = np.vstack([x, around(150, 0.04), around(60, 0.3), around(40, 0.22), np.repeat(x[:1], 45, 0), x[5:9] * 3.0, x[9:12] * 1e-20, around(90, 0.1)])
    out = [(int(k) * 3 + 7, [float(np.float32(z)) for z in v]) for k, v in enumerate(body)]
    out = [out[k] for k in r.permutation(len(out))]
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [math.nan] + [1.0] * 23), (5, [math.inf] * 24), (6, [None] + [1.0] * 23), (9001, [1.0, 2.0]), (9002, [2.0, 4.0]), (None, out[0][1]), (None, None),
           (9003, [-0.0, 1.0]), (9004, [0.0, 1.0])]
    return out + odd + out[:3]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], SCHEMA).withColumns({"key": F.lit("x"), "m": F.lit(2), "u": F.lit(None).cast("int"), "cell": F.lit(1)})
    out = vectors.embedding_join(df, **kw)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("kw", [{"spread": None}, {"spread": None, "targets": 16, "queries": 24, "lists": 12, "sample": 100}])
def test_whole_reach_loses_no_link(spark, rows, kw):
    assert run(spark, rows, **kw) == brute(rows)[0]


def test_default_reach_and_false_links(spark, rows):
    want, links = brute(rows)
    got = run(spark, rows, lists=32)
    assert 0.97 * links <= sum(r[1] for r in got) <= links
    own, best = {}, {}
    for r in want:
        best[r[0]] = max(best.get(r[0], 0), r[1])
    assert all(r[1] <= best[r[0]] for r in got)


def test_recall_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    r = np.random.default_rng(1)
    near = [(100000 + d, [float(np.float32(x)) for x in np.array(v) + s * r.normal(size=len(v))]) for d, v in rows[::3] for s in (0.01, 0.035, 0.055)]
    want, links = brute(rows + near)
    assert links > 300 and sum(x[1] for x in run(spark, rows + near, lists=64)) >= 0.97 * links


def test_empty_single_and_hopeless(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0, 0.0])]) == [(4, 0, 4, True)]
    assert run(spark, [(4, None), (5, [0.0])]) == [(4, 0, 4, True), (5, 0, 5, True)]
    assert run(spark, [(8, [1.0]), (8, [1.0]), (3, [2.0]), (9, [-1.0])]) == sorted([(8, 2, 3, False), (8, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (205, 203), (203, 209), (205, 209)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {203: 203, 205: 203, 209: 203}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_asymmetric_distances_less_the_coding_error_never_exceed_the_distance():
    r = np.random.default_rng(3)
    x, q = r.normal(size=(200, 20)), r.normal(size=(30, 20))
    books = [vectors.codebook(p, 16, s) for s, p in enumerate(np.array_split(x, 6, axis=1))]
    index = vectors.Index(0.9, 0.2, np.zeros((1, 20)), books, np.zeros((0, 20)), np.zeros(0), np.zeros(0))
    codes, missed = index.encode(x)
    true = np.linalg.norm(q[:, None] - x[None], axis=2)
    assert (index.distances(q, codes) - missed <= true + 1e-9).all() and (index.distances(q, codes) + missed >= true - 1e-9).all()
