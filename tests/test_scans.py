"""Several scans of different sizes: every step works per scan and no key is shared between them."""

import pytest
from pyspark.sql import functions as F

from specband.operators import calibrate as cal, objects as ob, reshape as rs
from specband.plans import band_selection as bs, experiments as ex
from specband.sources import io

SHAPES = {"a": (6, 6), "b": (4, 9), "c": (3, 2)}
GAIN = {"a": 1.0, "b": 100.0, "c": 10.0}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def cubes(spark):
    """Two excitations of three bands; scan b is a hundred times brighter, one pixel of c lacks an excitation."""
    data = [(s, float(ex_), b, 420.0 + 10 * b, y, x, GAIN[s] * (1 + y * w + x + b + ex_ / 100)) for s, (h, w) in SHAPES.items() for y in range(h) for x in range(w)
            for ex_ in (300, 400) for b in range(3) if not (s == "c" and (y, x) == (0, 0) and ex_ == 400)]
    return spark.createDataFrame(data, "scan_id STRING, excitation DOUBLE, em_idx INT, emission DOUBLE, y INT, x INT, value DOUBLE").cache()


def test_exposure_by_scan(spark, cubes):
    table = spark.createDataFrame([(s, e, {"a": 2.0, "b": 4.0, "c": 8.0}[s] * (1 if e == 300 else 2)) for s in SHAPES for e in (300.0, 400.0)], "scan_id STRING, excitation DOUBLE, exposure DOUBLE")
    out = cal.normalize_exposure(cubes, table)
    assert out.count() == cubes.count()
    got = {(r["scan_id"], r["excitation"]): r["f"] for r in out.join(cubes.withColumnRenamed("value", "was"), [c for c in cubes.columns if c != "value"]).groupBy(
        "scan_id", "excitation").agg(F.avg(F.col("value") / F.col("was")).alias("f")).collect()}
    assert all(got[s, 300.0] == pytest.approx(2) and got[s, 400.0] == pytest.approx(1) for s in SHAPES)
    with pytest.raises(Exception, match="several rows"):
        cal.attach_exposure(cubes, table.drop("scan_id")).collect()
    assert rows(cal.normalize_exposure(cubes, table, excitations=cubes.select("scan_id", "excitation").distinct())) == rows(out)


def test_validity_counts_the_scan_s_excitations(cubes):
    assert rows(cal.valid_pixels(cubes).groupBy("scan_id").count()) == [("a", 36), ("b", 36), ("c", 5)]
    late = cubes.where(~((F.col("scan_id") == "a") & (F.col("y") == 0) & (F.col("excitation") == 300) & (F.col("em_idx") == 0)))
    assert rows(cal.valid_pixels(late, "first_band").groupBy("scan_id").count()) == [("a", 30), ("b", 36), ("c", 6)]
    bands = rs.band_catalog(cubes)
    assert rows(rs.cube_to_spectrum(cubes, bands, 6).groupBy("scan_id").count()) == [("a", 36), ("b", 36), ("c", 5)]
    assert rows(rs.cube_to_spectrum(late, bands, 6, "first_band").groupBy("scan_id").count()) == [("a", 30), ("b", 36), ("c", 6)]


def test_images_are_scaled_on_their_own(cubes):
    one = cubes.where("excitation = 300")
    for df, col in ((rs.projection(one), "value"), (rs.false_color(one, 3), "r"), (rs.rgb_by_wavelength(cubes), "r"), (rs.rgb_by_wavelength(cubes, normalization="percentile"), "g")):
        top = dict(rows(df.groupBy("scan_id").agg(F.max(col))))
        assert all(v == pytest.approx(1.0, abs=1e-6) for v in top.values()) and set(top) == set(SHAPES)
    channels = one.select("scan_id", "y", "x", F.lit("r").alias("channel"), "value")
    low = dict(rows(rs.rgb_enhance(channels, 1.0).groupBy("scan_id").agg(F.min("value"))))
    assert set(low) == set(SHAPES) and all(v == 0 for v in low.values())
    best = rs.band_catalog(cubes).withColumn("rank", F.col("band_id") + 1)
    assert dict(rows(io.layers(cubes, best, 1).groupBy("scan_id").agg(F.max("layer")))) == {s: 65535 for s in SHAPES}


def test_shapes_by_scan(spark, cubes):
    one = cubes.where("excitation = 300 AND em_idx = 0")
    tiles = rs.tile(one, None, 4, 1)
    for s, shape in SHAPES.items():
        mine = lambda df: rows(df.where(F.col("scan_id") == s))
        assert mine(tiles) == rows(rs.tile(one.where(F.col("scan_id") == s), shape, 4, 1))
    mask = one.select("scan_id", "y", "x", (F.col("x") % 2 == 0).alias("keep"))
    for whole, part in ((cal.downscale_mask(mask, 2), lambda m, shape: cal.downscale_mask(m, 2, shape)),
                        (rs.patches(mask, None, 2, 1, None, 0.3), lambda m, shape: rs.patches(m, shape, 2, 1, None, 0.3))):
        for s, shape in SHAPES.items():
            want = rows(part(mask.where(F.col("scan_id") == s), shape))
            assert rows(whole.where(F.col("scan_id") == s)) == want and want
    assert rs.patches(mask, None, 1, 1, 3, 0.3).groupBy("scan_id").count().where("count <> 3").isEmpty()


def test_training_pixels_of_every_scan(spark, cubes):
    bands = bs.varied_bands(cubes, 2)
    px = bs.spectra_on_bands(cubes, bands, 2)
    assert px.select("pixel_id").distinct().count() == px.count() == 77  # one pixel of c has none of the two bands
    truth = px.select("scan_id", "y", "x", (F.col("y") % 2).cast("int").alias("class"))
    rois = spark.createDataFrame([("r", 0, 0, 9, 0, 9)], "roi_id STRING, ord INT, y0 INT, y1 INT, x0 INT, x1 INT")
    out = bs.classify_and_score(cubes, bands, 2, truth, rois, k=1).first()
    assert out["n_pixels"] == 77 and out["accuracy"] == 1.0  # every pixel is its own nearest training row


def test_objects_of_one_number(spark):
    objects = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1), ("b", 0, 0, 1)], "scan_id STRING, y INT, x INT, object_id BIGINT")
    layer = objects.drop("object_id").withColumn("v", F.lit(1))
    assert ob.object_pixels(objects, layer, 1, "b").count() == 1 and ob.object_pixels(objects, layer, 1).count() == 3
    scores = spark.createDataFrame([("a", 1, "k", 0.2), ("b", 1, "k", 0.9)], "scan_id STRING, object_id BIGINT, config_name STRING, accuracy DOUBLE")
    assert rows(ob.multi_config_object_compare(scores, ["k"])) == [("a", 1, 0.2), ("b", 1, 0.9)]


def test_a_sweep_continues(spark, tmp_path):
    calls = []

    def run(cfg):
        calls.append(cfg["name"])
        if cfg["name"] == "bad" and calls.count("bad") == 1:
            raise RuntimeError("x" * 2000)
        return spark.createDataFrame([(len(calls),)], "score INT")

    configs = [{"name": n} for n in ("one", "bad", "two")]
    first = ex.config_sweep_runner(spark, configs, run, str(tmp_path / "s"))
    assert first.count() == 3 and len(first.where("error IS NOT NULL").first()["error"]) > 2000
    again = ex.config_sweep_runner(spark, configs, run, str(tmp_path / "s"))
    assert calls == ["one", "bad", "two", "bad"] and rows(again.select("config_name", "score")) == [("bad", 4), ("one", 1), ("two", 3)]
    assert again.where("error IS NOT NULL").count() == 0
