"""The partition index of the neighbour search, and the block form of the silhouette."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.functions import blocks
from specband.operators import classify as cl, knn, quality as q


def timed(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def table(spark, x, **columns):
    names = list(columns)
    rows = [(i, *[int(columns[c][i]) for c in names], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["pixel_id BIGINT"] + [f"{c} INT" for c in names] + ["spectrum ARRAY<DOUBLE>"]))


def brute(x, t, ids, k, metric, ok=None):
    d = np.sqrt(((x[:, None] - t[None]) ** 2).sum(-1)) if metric == "euclidean" else np.abs(x[:, None] - t[None]).sum(-1)
    out = []
    for i, row in enumerate(d):
        at = [j for j in np.lexsort((ids, row)) if ok is None or ok(i, j)][:k]
        out.append([(round(float(row[j]), 9), int(ids[j])) for j in at])
    return out


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(12)
    centre = r.normal(size=(12, 6)) * 9
    t = np.vstack([c + r.normal(size=(60, 6)) for c in centre] + [np.repeat(centre[:1], 40, 0), centre[:5] * 50])
    x = np.vstack([t[::9], centre + 0.5, r.normal(size=(20, 6)) * 30])
    return x, t, r.permutation(len(t))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block_rows", [16, 2048])
def test_neighbours_are_exact(spark, data, metric, block_rows):
    x, t, y = data
    train = table(spark, t, **{"class": y}).repartition(3)
    nn = cl.neighbors(table(spark, x), train, 7, metric, False, block_rows=block_rows).orderBy("pixel_id").collect()
    assert [[(round(d, 9), i) for d, i in zip(r.nn_d, r.nn_id)] for r in nn] == brute(x, t, np.arange(len(t)), 7, metric)
    assert all(list(r.nn_class) == [int(y[i]) for i in r.nn_id] for r in nn)


def test_outside_the_own_fold(spark, data):
    _, t, y = data
    fold = np.arange(len(t)) % 3
    nn = cl.neighbors(table(spark, t, **{"class": y, "fold": fold}), table(spark, t, **{"class": y, "fold": fold}), 4, scale=False, outside="fold", block_rows=50).orderBy("pixel_id").collect()
    assert [[(round(d, 9), i) for d, i in zip(r.nn_d, r.nn_id)] for r in nn] == brute(t, t, np.arange(len(t)), 4, "euclidean", lambda i, j: fold[i] != fold[j])


def test_few_blocks_are_visited(spark, data):
    x, t, y = data
    train = table(spark, t, **{"class": y})
    folder, pivots = knn.build(train, 5, "euclidean", None, "pixel_id", 16, None)
    index = knn.Index(folder, pivots, "euclidean")
    near = x[: len(t[::9])]
    index.search(near, np.zeros(len(near), int), 5, False)
    n = len(index.part)
    assert n >= 40 and index.visits < 0.25 * n * len(near)
    assert index.ranges["n"].max() <= 16 and index.ranges["n"].sum() == len(t) - 40 + 5  # of equal rows only k stay


def test_copies_few_rows_and_no_rows(spark):
    train = table(spark, [[1.0, 1.0]] * 500 + [[5.0, 5.0]], **{"class": [0] * 500 + [1]}).repartition(4)
    got = cl.neighbors(table(spark, [[1.0, 1.0], [9.0, 9.0]]), train, 3, scale=False).orderBy("pixel_id").collect()
    assert [list(r.nn_id) for r in got] == [[0, 1, 2], [500, 0, 1]]
    few = cl.neighbors(table(spark, [[1.0, 1.0]]), train.where("pixel_id >= 499"), 5, scale=False).first()
    assert list(few.nn_id) == [499, 500]
    none = cl.neighbors(table(spark, [[1.0, 1.0]]), train.where("pixel_id > 900"), 5, scale=False).first()
    assert list(none.nn_d) == list(none.nn_id) == []


def test_blocks_are_kept_within_a_bound(spark, data):
    _, t, y = data
    folder, _ = knn.build(table(spark, t, **{"class": y}), 3, "euclidean", None, "pixel_id", 32, None)
    store = blocks.Blocks(folder, keep=4000)
    order = store.ranges()["block"]
    for b in [*order, *order]:
        store.read(int(b))
        assert store.bytes <= 4000 or len(store.held) == 1
    assert store.reads > len(order)


def test_silhouette_of_odd_clusterings(spark, data):
    _, t, _ = data
    lab = np.arange(len(t)) % 4
    lab[:3] = [7, 8, 8]  # one cluster of a single row
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(-1))
    s = []
    for i in range(len(t)):
        n = {c: (lab == c).sum() for c in set(lab.tolist())}
        a = d[i, lab == lab[i]].sum() / max(n[lab[i]] - 1, 1)
        b = min(d[i, lab == c].mean() for c in n if c != lab[i])
        s.append((b - a) / max(a, b) if n[lab[i]] > 1 and max(a, b) > 0 else 0.0)
    df = table(spark, t, cluster=lab)
    assert q.silhouette(df, block_rows=37).first()[0] == pytest.approx(np.mean(s), rel=1e-9)
    assert q.silhouette(df.withColumn("cluster", F.lit(1))).first()[0] == 0.0
    assert q.silhouette(df.where("pixel_id < 0")).first()[0] == 0.0


def test_distances_of_near_far_and_huge_rows(data):
    x, t, _ = data
    for offset in (0.0, 1e6):
        a, b = x + offset, np.vstack([t, x, x + 1e-7]) + offset
        want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        assert q.exact_distances(a, b) == pytest.approx(want, rel=1e-9, abs=0)
    big = np.array([[1e308, 1.0], [1e308, 4.0], [0.0, 0.0]])
    assert q.exact_distances(big, big).tolist() == [[0, 3, np.inf], [3, 0, np.inf], [np.inf, np.inf, 0]]


def test_distances_take_a_matrix_product():
    r = np.random.default_rng(4)
    x, t = r.normal(size=(128, 64)), r.normal(size=(2048, 64))

    def band_by_band():
        total = np.zeros((len(x), len(t)))
        for b in range(64):
            total += (x[:, b, None] - t[None, :, b]) ** 2
        return np.sqrt(total)

    assert q.exact_distances(x, t) == pytest.approx(band_by_band(), rel=1e-9)
    assert min(timed(lambda: q.exact_distances(x, t)) for _ in range(20)) < min(timed(band_by_band) for _ in range(5)) / 3


def test_silhouette_work_is_spread(spark, data, monkeypatch):
    _, t, _ = data
    monkeypatch.setattr(q, "TASK_ROWS", 50)
    df = table(spark, t, cluster=np.arange(len(t)) % 3).coalesce(1)
    got = q.silhouette(df)
    assert "RoundRobin" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(q, "TASK_ROWS", 8192)
    assert got.first()[0] == pytest.approx(q.silhouette(df).first()[0], rel=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_rows_beyond_the_known_bound_are_left_out(data, metric):
    x, t, _ = data
    ids, k = np.arange(len(t))[::-1].copy(), 5
    plain_c, plain_d = knn.nearest(x, t, ids, k, metric)
    assert [[(round(float(d), 9), int(ids[c])) for c, d in zip(*r)] for r in zip(plain_c, plain_d)] == brute(x, t, ids, k, metric)
    column, d = knn.nearest(x, t, ids, k, metric, None, plain_d[:, 2])  # ties at the bound stay
    inside = plain_d <= plain_d[:, 2:3]
    assert (column[inside] == plain_c[inside]).all() and (d[inside] == plain_d[inside]).all()
    none, far = knn.nearest(x, t, ids, k, metric, np.ones((len(x), len(t)), bool), plain_d[:, 0])
    assert (none == -1).all() and np.isinf(far).all()


def test_search_memory_is_bounded(spark):
    import tracemalloc

    r = np.random.default_rng(9)
    t = r.normal(size=(6000, 16))
    folder, pivots = knn.build(table(spark, t, **{"class": np.zeros(len(t))}), 3, "euclidean", None, "pixel_id", 16, None)
    index = knn.Index(folder, pivots, "euclidean")
    x = r.normal(size=(10_000, 16))
    tracemalloc.start()
    step = max(1, knn.CELLS // len(index.part))
    index.search(x[:step], np.zeros(len(x[:step]), int), 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
