"""Hand-computed small cases, numpy re-derivations and invariants."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.functions.columns import emission_axis
from specband.functions.linalg import assign, expected_mi_term, nnls_gram
from specband.functions.scale import ordinal, prefix_max, quantiles
from specband.operators import calibrate as cal, classify as cl, compare as cmp, influence as inf, objects as ob
from specband.operators import quality as q, reshape as rs, select as sel, stats as st, unmix as um
from specband.plans import experiments as ex
from specband.sources import io


def rows(df):
    return [tuple(r) for r in df.collect()]


def grid(spark, lines, name="class"):
    data = [("s", y * 1000 + x, y, x, v) for y, line in enumerate(lines) for x, v in enumerate(line)]
    return spark.createDataFrame(data, f"scan_id STRING, pixel_id BIGINT, y INT, x INT, {name} INT")


@pytest.fixture(scope="module")
def planted(spark):
    """Three well separated groups in 12 bands, with group sizes 50, 30 and 20."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(3, 12)) * 5 + 20
    labels = np.repeat([0, 1, 2], [50, 30, 20])
    x = centers[labels] + rng.normal(size=(100, 12)) * 0.3
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(labels, x))], "pixel_id BIGINT, class INT, spectrum ARRAY<DOUBLE>")
    return df.repartition(3).cache(), x, labels


def test_cutoff(spark):
    df = spark.createDataFrame([(300.0, float(e)) for e in (330, 340, 550, 560, 600, 640, 650)], "excitation DOUBLE, emission DOUBLE")
    assert sorted(r[1] for r in rows(cal.spectral_cutoff(df, 40))) == [340, 550, 650]


def test_emission_axis(spark):
    df = spark.createDataFrame([(float(e), i) for e in (400, 410) for i in range(3)], "e DOUBLE, i INT")
    assert [r[0] for r in rows(df.select(emission_axis(F.col("e"), F.col("i"))))] == [420, 430, 440, 430, 440, 450]


def test_exposure_reference(spark):
    cubes = spark.createDataFrame([(300.0, 5.0), (310.0, 5.0), (320.0, 5.0)], "excitation DOUBLE, value DOUBLE")
    exposure = spark.createDataFrame([(300.0, 10.0), (310.0, 20.0), (999.0, 500.0)], "excitation DOUBLE, exposure DOUBLE")
    got = {r["excitation"]: r["value"] for r in cal.normalize_exposure(cubes, exposure, "max").collect()}
    assert got == {300.0: 10.0, 310.0: 5.0, 320.0: 5.0}  # the unused 999 nm exposure is no reference


def test_power_rounding_half_even(spark):
    t = spark.createDataFrame([("a", 305.0, 1.0), ("a", 315.0, 3.0)], "file STRING, wavelength DOUBLE, power DOUBLE")
    assert rows(io.average_power(t)) == [(300.0, 1.0), (320.0, 3.0)]


def test_trace_parsing_skips_header_and_junk(spark):
    text = "x\t1\n//DATA//\nX\tY\n300\t0.5\nbad line\n310\t0.25\n"
    f = spark.createDataFrame([("a.trq", text), ("b.trq", "no marker\n1\t2\n")], "file STRING, text STRING")
    assert rows(io.scan_power_traces(f)) == [("a.trq", 300.0, 0.5), ("a.trq", 310.0, 0.25)]


def test_tile_starts():
    assert rs.tile_starts(100, 64, 8) == [0, 36]
    assert rs.tile_starts(50, 64, 8) == [0]


def test_tiles_cover_and_merge_is_identity(spark):
    df = spark.createDataFrame([("s", y, x, 300.0, 0, float(y * 31 + x)) for y in range(30) for x in range(23)], "scan_id STRING, y INT, x INT, excitation DOUBLE, em_idx INT, value DOUBLE")
    t = rs.tile(df, (30, 23), 16, 4)
    starts = {(a, b) for a in rs.tile_starts(30, 16, 4) for b in rs.tile_starts(23, 16, 4)}
    assert {(r["y_start"], r["x_start"]) for r in t.collect()} == starts
    assert t.where("y < y_start OR y >= y_start + 16 OR x < x_start OR x >= x_start + 16").isEmpty()
    merged = {(r["y"], r["x"]): r["value"] for r in rs.merge_tiles(t).collect()}
    assert merged == {(y, x): float(y * 31 + x) for y in range(30) for x in range(23)}


def test_wide_long_round_trip(spark):
    cells = spark.createDataFrame([("s", 0, x, 300.0, i, 420.0 + 10 * i, float(x * 10 + i)) for x in range(3) for i in range(4)],
                                  "scan_id STRING, y INT, x INT, excitation DOUBLE, em_idx INT, emission DOUBLE, value DOUBLE")
    bands = rs.band_catalog(cells)
    back = rs.spectrum_to_long(rs.cube_to_spectrum(cells, bands, 4), bands)
    assert sorted(rows(back.select("x", "em_idx", "value"))) == sorted(rows(cells.select("x", "em_idx", "value")))


def test_polygon_matches_rectangle(spark):
    g = grid(spark, [[0] * 9] * 9)
    poly = [(1.5, 2.5), (6.5, 2.5), (6.5, 5.5), (1.5, 5.5)]
    kept = {(r["y"], r["x"]) for r in cal.mask_from_polygon(g, poly).where("keep").collect()}
    assert kept == {(y, x) for y in range(3, 6) for x in range(2, 7)}
    assert cal.mask_from_polygon(g, poly[:2]).where("keep").isEmpty()


def test_apply_mask_rejects_other_shape(spark):
    c = spark.createDataFrame([("s", 0, 0, 1.0), ("s", 0, 1, 1.0)], "scan_id STRING, y INT, x INT, value DOUBLE")
    m = spark.createDataFrame([("s", 0, 0, True)], "scan_id STRING, y INT, x INT, keep BOOLEAN")
    with pytest.raises(Exception, match="different pixels"):
        cal.apply_mask(c, m).collect()


def test_center_pad_crop(spark):
    img = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(6)], "y INT, x INT, r INT")
    out = {(r["y"], r["x"]): r["r"] for r in io.center_pad_crop(img, (4, 6), 7, 4, {"r": 0}).collect()}
    assert len(out) == 28 and {y for (y, _), v in out.items() if v} == {1, 2, 3, 4}


# -- distributed helpers -----------------------------------------------------------------------------

def test_ordinal_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 1000)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id INT, v INT").repartition(7)
    got = sorted((r["ordinal"], r["v"], r["id"]) for r in ordinal(df, ["v", "id"]).collect())
    want = sorted((int(x), i) for i, x in enumerate(v))
    assert [g[0] for g in got] == list(range(1000)) and [(g[1], g[2]) for g in got] == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    v, g = np.round(rng.normal(size=2000), 2), rng.choice(["a", "b"], 2000, p=[0.9, 0.1])
    df = spark.createDataFrame([(str(k), float(x)) for k, x in zip(g, v)], "g STRING, v DOUBLE").repartition(5)
    for r in quantiles(df, "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99}, ["g"]).collect():
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(v[g == r["g"]], [0.05, 0.5, 0.99]))


def test_prefix_max(spark):
    rng = np.random.default_rng(3)
    v = rng.random(500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i INT, v DOUBLE").repartition(6)
    got = [r["m"] for r in prefix_max(df, ["i"], "v", "m").orderBy("i").collect()]
    assert got[0] is None and np.allclose(got[1:], np.maximum.accumulate(v)[:-1])


# -- selection ---------------------------------------------------------------------------------------

def test_min_distance(spark):
    ranked = spark.createDataFrame([(1, 300.0, 420.0, 0, 4.0), (2, 300.0, 430.0, 1, 3.0), (3, 310.0, 425.0, 0, 2.0), (4, 300.0, 435.0, 2, 1.0)],
                                   "rank INT, excitation DOUBLE, emission DOUBLE, em_idx INT, influence DOUBLE")
    assert [r["rank"] for r in sel.select_min_distance(ranked, 15.0, 10).orderBy("position").collect()] == [1, 3, 4]
    assert [r["rank"] for r in sel.select_min_distance(ranked, 15.0, 2).orderBy("position").collect()] == [1, 3]


def test_mmr_prefers_diverse_band():
    sim = np.eye(3)
    sim[0, 1] = sim[1, 0] = 1.0
    assert sel.mmr_order(np.array([1.0, 0.9, 0.6]), sim, 2) == [0, 2]
    assert sel.mmr_order(np.array([1.0, 0.9, 0.6]), sim, 2, 0.0) == [0, 1]


def test_mmr_against_direct_loop():
    rng = np.random.default_rng(4)
    inf_, a = rng.random(30), rng.normal(size=(30, 50))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    sim = a @ a.T
    chosen = [int(np.argmax(inf_))]
    while len(chosen) < 8:
        score = {i: inf_[i] / inf_.max() - 0.5 * max(abs(sim[i, j]) for j in chosen) for i in range(30) if i not in chosen}
        chosen.append(max(score, key=score.get))
    assert sel.mmr_order(inf_, sim, 8) == chosen


def test_greedy_and_loading_selection_rules():
    cov = np.diag([3.0, 2.0, 1.0])
    cov[0, 1] = cov[1, 0] = np.sqrt(6) * 0.99
    assert sel.greedy_diversity(cov, 2) == [0, 2]
    load = np.array([[0.1, 0.9, 0.3, 0.2], [0.8, 0.1, 0.2, 0.3]])
    assert sel.loadings_sequential(load, np.ones(4), 3) == [1, 2, 3]
    assert sel.loadings_sequential(np.zeros((0, 4)), np.array([1.0, 4, 3, 2]), 2) == [1, 2]
    assert sel.loadings_top5(load, 2) == [0, 1]
    # bands 6, 2, 7 lead; the first component's five strongest make six bands known before the second is reached
    wide = np.array([[5, 4, 0, 3, 2, 1, 9, 0], [0, 0, 9, 1, 2, 3, 4, 5], [1, 0, 0, 2, 3, 4, 5, 9]], float)
    assert sel.loadings_top5(wide, 3) == [0, 1, 2] and sel.loadings_top5(wide, 8) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_percentile_delta_snaps_to_median(spark):
    stats = spark.createDataFrame([(0, 0.5, *[float(p) for p in inf.STORED])], "dim_id INT, mean DOUBLE, " + ", ".join(f"p{p} DOUBLE" for p in inf.STORED))
    plan = inf.perturbation_plan(stats.select("dim_id"), [10])
    assert {r["delta"] for r in inf.perturbation_deltas(plan, stats, "percentile").collect()} == {49.5}


def test_linear_latent_matches_numpy(planted):
    df, x, _ = planted
    m = inf.linear_latent(df, 2)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(m.ratio, values[:2] / values.sum())
    back = np.array([r["reconstruction"] for r in m.decode(m.encode(df)).orderBy("pixel_id").collect()])
    assert ((back - x) ** 2).sum() == pytest.approx(values[2:].sum() * len(x), rel=1e-6)


def test_band_correlation_and_cosine(planted, spark):
    df, x, _ = planted
    c = np.zeros((12, 12))
    for r in st.band_correlation(df).collect():
        c[r["band_a"], r["band_b"]] = r["corr"]
    assert np.allclose(c, np.corrcoef(x.T))


def test_hot_key_formatting(spark):
    s = spark.createDataFrame([(365.0, 430.0), (365.0, 420.0), (300.0, 500.0)], "excitation DOUBLE, emission DOUBLE")
    assert rows(sel.format_combinations(s)) == [("Ex300nm: [500.0]nm | Ex365nm: [420.0, 430.0]nm",)]


# -- classification ----------------------------------------------------------------------------------

def brute_knn(x, t, y, k):
    d = np.sqrt(((x[:, None] - t[None]) ** 2).sum(-1))
    out = []
    for row in d:
        near = y[np.argsort(row, kind="stable")[:k]]
        out.append(min(np.unique(near), key=lambda c: (-(near == c).sum(), c)))
    return out


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_knn_matches_brute_force_also_in_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(60, 3)).astype(float)  # many ties
    y = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))], "pixel_id BIGINT, class INT, spectrum ARRAY<DOUBLE>").repartition(3)
    train = df.where("pixel_id < 25")
    nn = cl.neighbors(df.drop("class"), train, 5, scale=False, block_rows=block_rows)
    got = [r["c"] for r in nn.withColumn("c", cl.vote_label(cl.votes(5))).orderBy("pixel_id").collect()]
    assert got == brute_knn(x, x[:25], y[:25], 5)


def test_kmeans_finds_planted_groups(planted):
    df, _, labels = planted
    for out in (cl.kmeans(df, 3, n_init=3)[0], cl.kmeans_large(df, 3, sample=60, n_init=3)):
        ct = out.groupBy("class", "cluster").agg(F.count("*").alias("n"))
        assert cmp.purity(ct).first()[0] == 1.0


@pytest.mark.parametrize("block_rows", [20_000, 13])
def test_silhouette_matches_numpy(planted, block_rows):
    df, x, labels = planted
    lab = np.where(np.arange(100) % 7 == 0, (labels + 1) % 3, labels)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(100):
        m = [d[i, lab == c].sum() / ((lab == c).sum() - (c == lab[i])) for c in range(3)]
        a, b = m[lab[i]], min(v for c, v in enumerate(m) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = q.silhouette(df.withColumn("cluster", F.when(F.col("pixel_id") % 7 == 0, (F.col("class") + 1) % 3).otherwise(F.col("class"))), None, block_rows=block_rows)
    assert got.first()[0] == pytest.approx(np.mean(s), rel=1e-9)


def test_stratified_folds_balance_classes(planted):
    df, _, _ = planted
    n = cl.stratified_folds(df, "pixel_id").groupBy("class", "fold").count().collect()
    assert {(r["class"], r["count"]) for r in n} == {(0, 10), (1, 6), (2, 4)}


# -- comparison --------------------------------------------------------------------------------------

# a plus of class 1 between two bars of 0 and 2; three labelled pixels are wrong
PLUS = ["00.1.22", "00.1.22", "0.111.2", "00.1.22", "00.1.22"]
SEEN = ["00.1.22", "01.1.22", "0.121.2", "00.1.22", "00.1.20"]


def picture(spark, lines, name="class"):
    return grid(spark, [[-1 if c == "." else int(c) for c in line] for line in lines], name)


def test_small_labels(spark):
    t, p = picture(spark, PLUS), picture(spark, SEEN, "cluster")
    assert rows(cmp.pixel_accuracy(p, t).select("correct_pixels", "total_pixels")) == [(22, 25)]
    s = cmp.scores(cmp.contingency(p, t)).first()
    assert s["accuracy"] == pytest.approx(22 / 25) and s["balanced_accuracy"] == pytest.approx((8 / 9 + 6 / 7 + 8 / 9) / 3)
    rois = spark.createDataFrame([("left", 0, 0, 5, 0, 2), ("mid", 1, 1, 4, 2, 5)], "roi_id STRING, ord INT, y0 INT, y1 INT, x0 INT, x1 INT")
    got = {r["roi_id"]: (r["class"], r["purity"], r["pixel_count"]) for r in cmp.roi_mapping(rois, t).collect()}
    assert got == {"left": (0, 1.0, 9), "mid": (1, 1.0, 5)}
    bad = spark.createDataFrame([("bg", 0, 0, 2, 2, 3)], "roi_id STRING, ord INT, y0 INT, y1 INT, x0 INT, x1 INT")
    with pytest.raises(ValueError):
        cmp.roi_mapping(bad, t)


def test_purity_example(spark):
    ct = spark.createDataFrame([(0, 0, 3), (1, 0, 1), (0, 1, 1), (1, 1, 2)], "class INT, cluster INT, n BIGINT")
    assert cmp.purity(ct).first()[0] == pytest.approx(5 / 7)


def test_identical_labels_are_perfect(spark):
    ct = spark.createDataFrame([(0, 5, 4), (1, 7, 6), (2, 1, 3)], "class INT, cluster INT, n BIGINT")
    assert cmp.pair_scores(ct).first()["ari"] == pytest.approx(1.0)
    i = cmp.information_scores(ct).first()
    assert i["nmi"] == pytest.approx(1.0) and cmp.adjusted_mutual_info(ct).first()[0] == pytest.approx(1.0)
    assert cmp.misclassification_rate(ct).first()[0] == 0.0


def test_assignment_against_permutations():
    rng = np.random.default_rng(6)
    for n, m in ((4, 4), (3, 5), (5, 3), (6, 6)):
        c = rng.integers(-20, 20, size=(n, m)).astype(float)
        short, wide = (c, False) if n <= m else (c.T, True)
        best = min(sum(short[i, p[i]] for i in range(short.shape[0])) for p in permutations(range(short.shape[1]), short.shape[0]))
        assert sum(c[i, j] for i, j in assign(c)) == pytest.approx(best)


def test_expected_mi_windows_agree_with_full_sum():
    from math import exp, lgamma, log

    a, b, n = 400, 700, 2000
    full = sum(k / n * log(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1)
               - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1)) for k in range(1, 401))
    assert expected_mi_term(a, b, n) == pytest.approx(full, rel=1e-8)


def test_roc_auc_perfect_and_tied(spark):
    s = spark.createDataFrame([(c, lab, float(c == lab)) for c in (0, 1) for lab in (0, 1) for _ in range(5)], "class INT, label INT, score DOUBLE")
    assert cmp.roc_auc_ovr(s).first()[0] == 1.0
    assert cmp.roc_auc_ovr(s.withColumn("score", F.lit(0.5))).first()[0] == 0.5


# -- objects -----------------------------------------------------------------------------------------

def shapes():
    """An L of class 3, a frame of class 1 with a dot of class 2 in its middle, and a specule too small to count."""
    t = np.zeros((60, 70), dtype=int)
    t[4:34, 5:11], t[28:34, 11:25] = 3, 3
    t[8:28, 40:60], t[10:26, 42:58], t[15:21, 47:53] = 1, 0, 2
    t[50:54, 50:54] = 1
    p = t.copy()
    p[4:9, 5:11], p[15:21, 47:50] = 1, 3
    return t, p


@pytest.mark.parametrize("tile", [256, 16])
def test_shapes(spark, tile):
    t, p = shapes()
    truth, pred = grid(spark, t.tolist()), grid(spark, p.tolist(), "cluster")
    o = ob.filter_small(ob.connected_components(truth.where("class <> 0"), 8, tile), 30)
    s = {r["object_id"]: (r["pixel_count"], r["class_label"], r["y_min"], r["x_max"]) for r in ob.object_summary(o, truth).collect()}
    assert s == {1: (264, 3, 4, 24), 2: (144, 1, 8, 59), 3: (36, 2, 15, 52)}
    acc = {r["object_id"]: r["accuracy"] for r in ob.object_accuracy(o, pred, truth).collect()}
    assert acc == {1: pytest.approx(234 / 264), 2: 1.0, 3: 0.5}


def test_touching_classes_and_connectivity(spark):
    t = grid(spark, [[1, 1, 2, 2]])
    o = ob.connected_components(t)
    assert rows(ob.object_summary(o, t).select("object_id", "pixel_count", "class_label")) == [(1, 4, 1)]
    assert ob.connected_components(t, split_by="class").select("object_id").distinct().count() == 2
    d = grid(spark, [[1, 0], [0, 1]]).where("class = 1")
    assert ob.connected_components(d, 8).select("object_id").distinct().count() == 1
    assert ob.connected_components(d, 4).select("object_id").distinct().count() == 2


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_on_noise_match_flood_fill(spark, connectivity):
    rng = np.random.default_rng(7)
    m = rng.random((40, 37)) < 0.55
    want, label = np.zeros(m.shape, int), 0
    for y in range(40):
        for x in range(37):
            if m[y, x] and not want[y, x]:
                label += 1
                stack = [(y, x)]
                want[y, x] = label
                while stack:
                    a, b = stack.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if connectivity == 4 and abs(dy) + abs(dx) != 1:
                                continue
                            u, v = a + dy, b + dx
                            if 0 <= u < 40 and 0 <= v < 37 and m[u, v] and not want[u, v]:
                                want[u, v] = label
                                stack.append((u, v))
    g = grid(spark, m.astype(int).tolist()).where("class = 1")
    got = {(r["y"], r["x"]): r["object_id"] for r in ob.connected_components(g, connectivity, 8).collect()}
    assert got == {(y, x): want[y, x] for y, x in zip(*np.nonzero(m))}


def test_two_scans_keep_their_own_numbers(spark):
    a = grid(spark, [[1, 0, 1]]).where("class = 1")
    o = ob.connected_components(a.unionByName(a.withColumn("scan_id", F.lit("t"))))
    assert sorted(rows(o.select("scan_id", "x", "object_id"))) == [("s", 0, 1), ("s", 2, 2), ("t", 0, 1), ("t", 2, 2)]


# -- experiments -------------------------------------------------------------------------------------

def test_pareto(spark):
    r = spark.createDataFrame([("a", 0.8, 5), ("b", 0.8, 7), ("c", 0.9, 10), ("d", 0.85, 12)], "config_name STRING, accuracy DOUBLE, n_bands INT")
    assert sorted(x["config_name"] for x in ex.pareto_frontier(r).collect()) == ["a", "c"]


def test_tolerance(spark):
    r = spark.createDataFrame([("BASELINE_FULL_DATA", 1, 0.80, 204), ("a", 1, 0.75, 3), ("b", 1, 0.77, 6), ("c", 1, 0.79, 9)], "config_name STRING, perturbation_dim INT, accuracy DOUBLE, n_bands INT")
    got = {x["level"]: x["min_bands"] for x in ex.tolerance_min_bands(r, (0.95, 2.0)).collect()}
    assert got == {0.95: 6, 2.0: None}


def test_trend_fit_recovers_parabola_and_line(spark):
    r = spark.createDataFrame([(x, 2.0 * x * x - 3.0 * x + 1.0) for x in range(1, 9)], "n_bands INT, accuracy DOUBLE")
    f = ex.trend_fit(r).first()
    m = f["m"]
    assert f["degree"] == 2 and f["c2"] == pytest.approx(2.0) and f["c1"] == pytest.approx(4 * m - 3) and f["c0"] == pytest.approx(2 * m * m - 3 * m + 1)
    two = ex.trend_fit(r.where("n_bands < 3")).first()
    assert two["degree"] == 1 and two["c1"] == pytest.approx(3.0)


def test_robustness_sample_distinct_and_complete(spark):
    b = spark.createDataFrame([(i,) for i in range(6)], "band_id INT")
    assert ex.robustness_sample(b, 3, 100).distinct().count() == 20
    s = [tuple(r[0]) for r in ex.robustness_sample(b, 3, 15).collect()]
    assert len(set(s)) == 15 and all(list(x) == sorted(set(x)) for x in s)


def test_robustness_evaluation_finds_informative_bands(planted, spark):
    from specband.plans.robustness import robustness_evaluate

    df, x, labels = planted
    subsets = spark.createDataFrame([([0, 1, 2, 3],), ([5, 6, 7, 8],)], "subset ARRAY<INT>")
    got = robustness_evaluate(df, subsets, k=3, n_init=4).collect()
    assert len(got) == 2 and all(r["accuracy"] == 1.0 for r in got)


def test_sweep_keeps_failures_as_rows(spark, tmp_path):
    def run(cfg):
        if cfg["n"] < 0:
            raise ValueError("negative")
        return spark.createDataFrame([(0.5, cfg["n"])], "accuracy DOUBLE, n_bands INT")

    out = ex.config_sweep_runner(spark, [{"name": "good", "n": 3}, {"name": "bad", "n": -1}], run, str(tmp_path / "sweep"))
    got = {r["config_name"]: (r["accuracy"], r["error"]) for r in out.collect()}
    assert got["good"] == (0.5, None) and got["bad"][0] is None and "negative" in got["bad"][1]
    assert rows(ex.sweep_status(out)) == [(1, 1)]


# -- factorization -----------------------------------------------------------------------------------

def test_nnls_satisfies_optimality():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(20, 5)), rng.normal(size=(20, 200))
    g, h = a.T @ a, a.T @ b
    x = nnls_gram(g, h)
    grad = g @ x - h
    assert (x >= 0).all() and (grad > -1e-7).all() and np.abs(grad[x > 0]).max() < 1e-7


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(9)
    s = np.abs(rng.normal(size=(3, 15)))
    c = np.abs(rng.normal(size=(120, 3)))
    c[:3] = np.eye(3) * 4
    x = c @ s
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>").repartition(4).cache(), x


@pytest.mark.parametrize("method", ["clip", "ridge", "nnls"])
def test_mcr_fits_exact_mixture(mixture, method):
    df, x = mixture
    fit = um.fit_mcr(df, 3, max_iter=60, tol=1e-12, init="farthest", method=method)
    assert fit.explained_variance > 0.97
    if method == "nnls":
        assert all(b <= a + 1e-9 for a, b in zip(fit.errors, fit.errors[1:]))
    c = np.array([r["concentration"] for r in fit.concentrations(df).orderBy("pixel_id").collect()])
    assert (c >= 0).all() and ((x - c @ fit.profiles) ** 2).mean() == pytest.approx(fit.error, abs=5e-3)


def test_als_step_matches_numpy(mixture):
    df, x = mixture
    s = um.mcr_init(df, 3, "random", 1)
    new, fit = um.als_step(df, s, "clip", normalize=False)
    c = np.maximum(np.linalg.lstsq(s.T, x.T, rcond=None)[0].T, 0)
    want = np.maximum(np.linalg.lstsq(c, x, rcond=None)[0], 0)
    assert np.allclose(new, want) and fit["mse"] == pytest.approx(((x - c @ want) ** 2).mean())
    assert fit["explained_variance"] == pytest.approx(1 - (x - c @ want).var() / x.var())


def test_nmf_error_falls_and_ica_separates(mixture, spark):
    df, _ = mixture
    errors = um.nmf(df, 3, max_iter=15, tol=0).errors
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    rng = np.random.default_rng(10)
    src = np.column_stack([rng.uniform(-1, 1, 800), np.sign(rng.normal(size=800)) * rng.exponential(size=800)])
    x = src @ rng.normal(size=(2, 4))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pixel_id BIGINT, spectrum ARRAY<DOUBLE>")
    mean, w, _ = um.fast_ica(d, 2)
    got = np.array([r["sources"] for r in um.ica_sources(d, mean, w).orderBy("pixel_id").collect()])
    corr = np.abs(np.corrcoef(got.T, src.T)[:2, 2:])
    assert (corr.max(axis=1) > 0.95).all()


def test_two_sided_p_against_integration():
    for t, df in ((0.0, 5), (0.3, 3), (1.0, 1), (2.5, 7), (4.0, 40), (-1.7, 12), (12.0, 2)):
        x = np.linspace(0, abs(t), 200_001)
        pdf = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / np.sqrt(df * np.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert ex.two_sided_p(t, df) == pytest.approx(1 - 2 * np.trapezoid(pdf, x), abs=1e-8)


def test_two_sample_t(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("c", 5.0)], "g STRING, v DOUBLE")
    got = {(r["a"], r["b"]): (r["df"], r["mean_diff"], r["t"]) for r in ex.two_sample_t(df, "g", "v").collect()}
    assert got["a", "b"] == (3, -3.0, pytest.approx(-3.0 / np.sqrt((2 * 1.0 + 1 * 2.0) / 3 * (1 / 3 + 1 / 2))))
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_wide_form_holds_no_wide_aggregate(spark):
    rows = [("s", 300.0, 420.0, 0, 0, 1.0), ("s", 300.0, 420.0, 0, 0, 3.0), ("s", 300.0, 430.0, 0, 0, None), ("s", 320.0, 420.0, 0, 1, float("nan")),
            ("s", 320.0, 420.0, 0, 1, 5.0), ("s", 999.0, 420.0, 7, 7, 2.0), ("s", None, 420.0, 8, 8, 2.0), (None, 300.0, 420.0, 0, 0, 9.0), ("t", 300.0, 420.0, None, 0, 4.0)]
    cells = spark.createDataFrame(rows, "scan_id STRING, excitation DOUBLE, emission DOUBLE, y INT, x INT, value DOUBLE")
    names = ["420-300", "430-300", "420-320", "440-340"]
    wide = rs.cube_to_wide(cells, names)
    assert wide.columns == ["scan_id", "y", "x", *names]
    got = {tuple(r)[:3]: tuple("nan" if v != v else v for v in tuple(r)[3:]) for r in wide.collect()}
    assert got == {("s", 0, 0): (3.0, None, None, None), ("s", 0, 1): (None, None, "nan", None), ("s", 7, 7): (None,) * 4, ("s", 8, 8): (None,) * 4,
                   (None, 0, 0): (9.0, None, None, None), ("t", None, 0): (4.0, None, None, None)}
    plan = rs.cube_to_wide(cells.withColumn("scan_id", F.lit("s")), names)._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_many_tiles_are_labelled_in_one_call(spark):
    r = np.random.default_rng(8)
    y, x = np.nonzero(r.random((40, 33)) < 0.6)
    c = r.integers(0, 2, len(y))
    for split in ([], [c]):
        for conn in (4, 8):
            got = ob.label_tile(y, x, conn, y // 7, x // 7, *split)
            for t in {*zip((y // 7).tolist(), (x // 7).tolist())}:
                at = (y // 7 == t[0]) & (x // 7 == t[1])
                assert (got[at] == ob.label_tile(y[at], x[at], conn, *[v[at] for v in split])).all()
    px = spark.createDataFrame([("s", int(a), int(b), int(k)) for a, b, k in zip(y, x, c)], "scan_id STRING, y INT, x INT, class INT")
    for split_by in (None, "class"):
        small, whole = ({(p.y, p.x): p.object_id for p in ob.connected_components(px, 8, t, split_by).collect()} for t in (7, 256))
        assert small == whole
    assert len(small) == len(y)
