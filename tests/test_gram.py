"""The Gram matrix as a table of tiles."""

import numpy as np
import pytest

from specband.operators import gram, select as sel, stats as st


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>").repartition(5)


@pytest.fixture(scope="module")
def x():
    r = np.random.default_rng(6)
    x = r.normal(size=(120, 23)) @ r.normal(size=(23, 23)) + r.normal(size=23)
    x[:, 7] = 2.5  # constant
    x[:, 11] = 0.0
    return x


@pytest.mark.parametrize("tile,room", [(256, 1 << 27), (5, 3 * 5 * 5 * 8), (4, 1)])
def test_rows_and_long_form(spark, x, tile, room):
    g = gram.GramTable(frame(spark, x), tile, group_bytes=room)
    assert g.n == 120 and np.allclose(g.total, x.sum(0)) and np.allclose(g.variances(), x.var(0))
    for b in (0, 7, 11, 22):
        assert np.allclose(g.row(b), x.T @ x[:, b])
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.corrcoef(x.T))
    corr[:, [7, 11]] = corr[[7, 11]] = 0
    got = np.full((23, 23), np.nan)
    for r in g.long("corr", "correlation").collect():
        got[r.band_a, r.band_b] = r["corr"]
    other = [b for b in range(23) if b not in (7, 11)]
    assert np.allclose(got[np.ix_(other, other)], corr[np.ix_(other, other)]) and np.isfinite(got).all()
    size = np.linalg.norm(x, axis=0)
    cos = {(r.band_a, r.band_b): r["c"] for r in g.long("c", "cosine").collect()}
    assert len(cos) == 23 * 23 and all(c == pytest.approx(x[:, a] @ x[:, b] / ((size[a] or 1) * (size[b] or 1)), abs=1e-9) for (a, b), c in cos.items())


def test_more_bands_than_a_matrix_on_the_driver(spark, monkeypatch):
    r = np.random.default_rng(7)
    x = r.normal(size=(12, 4500)).round(3)
    monkeypatch.setattr(gram, "STRIP_BYTES", 1)
    df = frame(spark, x)
    pos = [r["band_id"] for r in sel.select_greedy_diversity(df, 3).collect()]
    assert pos == sel.greedy_diversity(np.cov(x.T, bias=True), 3)


def test_groups_cover_every_pair_once():
    for room in (1, 1000, 1 << 20):
        pairs = [p for g in gram.tile_groups(7, 8, room) for p in g]
        assert sorted(pairs) == [(a, b) for a in range(7) for b in range(a, 7)]
    assert len(gram.tile_groups(7, 8, 8 * 8 * 8 * 10)) == 3


def test_no_rows(spark):
    g = gram.GramTable(frame(spark, np.zeros((1, 3))).where("pixel_id < 0"))
    assert g.n == 0 and g.long("corr", "correlation").count() == 0
    assert st.band_cosine(frame(spark, np.zeros((2, 2)))).count() == 4
