"""Scan manifests, and configurations that run at the same time."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.operators import calibrate as cal, classify as cl, reshape as rs
from specband.plans import experiments as ex
from specband.sources import io

CELL = "scan_id STRING, excitation DOUBLE, em_idx INT, emission DOUBLE, y INT, x INT, value DOUBLE"


@pytest.fixture(scope="module")
def cubes(spark):
    rows = []
    for scan, size, lines in (("a", 3, (300, 320, 340)), ("b", 5, (320, 360))):
        for e in lines:
            for b in range(4):
                for y in range(size):
                    for x in range(size + 1):
                        gap = (scan, e, y, x) in {("a", 320, 1, 1), ("b", 360, 4, 5)} or (scan == "b" and b == 2 and y == 0)
                        rows.append((scan, float(e), b, 340.0 + 30 * b + e / 10, y, x, None if gap else float(e + b + y * x)))
    return spark.createDataFrame(rows, CELL)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_stored_cubes_and_manifest(spark, cubes, tmp_path):
    manifest = io.write_cubes(cubes, str(tmp_path))
    assert same(cubes, io.read_cubes(spark, str(tmp_path)))
    got = {(r.scan_id, r.excitation, r.em_idx): (r.cells, r.measured, r.h, r.w) for r in manifest.collect()}
    assert len(got) == 3 * 4 + 2 * 4 and got["a", 320.0, 1] == (12, 11, 3, 4) and got["b", 360.0, 2] == (30, 23, 5, 6)


def test_manifest_changes_no_result(spark, cubes):
    manifest = cal.scan_manifest(cubes)
    for rule in ("all_excitations", "first_band"):
        assert same(cal.valid_pixels(cubes, rule), cal.valid_pixels(cubes, rule, manifest))
        bands = cubes.where("excitation <> 340").select("excitation", "em_idx").distinct().withColumn("band_id", (F.col("excitation") / 20 * 4 - 60 + F.col("em_idx")).cast("int"))
        assert same(rs.cube_to_spectrum(cubes, bands, 16, rule), rs.cube_to_spectrum(cubes, bands, 16, rule, manifest))
    exposure = spark.createDataFrame([(300.0, 10.0), (320.0, 20.0), (340.0, 50.0), (360.0, 80.0)], "excitation DOUBLE, exposure DOUBLE")
    power = spark.createDataFrame([(300.0, 2.0), (320.0, None)], "excitation DOUBLE, power DOUBLE")
    plain, quick = cal.calibrate(cubes, exposure, power), cal.calibrate(cubes, exposure, power, manifest=manifest)
    assert plain["power"].count() > 0 and all(same(plain[k], quick[k]) for k in plain)
    with_scan = exposure.crossJoin(spark.createDataFrame([("a",), ("b",)], "scan_id STRING"))
    assert same(cal.calibrate(cubes, with_scan, power)["power"], cal.calibrate(cubes, with_scan, power, manifest=manifest)["power"])


def test_one_pass_over_the_cells(spark, cubes, tmp_path):
    manifest = io.write_cubes(cubes, str(tmp_path))
    cells = io.read_cubes(spark, str(tmp_path))
    bands = spark.createDataFrame([(300.0, 0, 0), (320.0, 1, 1)], "excitation DOUBLE, em_idx INT, band_id INT")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(f"{tmp_path}/cells") or df._jdf.queryExecution().executedPlan().toString().count("/cells]")
    exposure = spark.createDataFrame([(300.0, 10.0)], "excitation DOUBLE, exposure DOUBLE")
    power = spark.createDataFrame([(300.0, 2.0)], "excitation DOUBLE, power DOUBLE")
    assert scans(rs.cube_to_spectrum(cells, bands, 2, manifest=manifest)) == 1
    assert scans(cal.calibrate(cells, exposure, power, manifest=manifest)["power"]) == 1


def test_configurations_overlap_and_commit_alone(spark, tmp_path):
    spans, lock = {}, threading.Lock()

    def run(cfg):
        start = time.time()
        time.sleep(2)
        if cfg["name"] == "bad":
            raise ValueError("no such band")
        out = spark.range(cfg["n"]).agg(F.sum("id").alias("purity"))
        with lock:
            spans[cfg["name"]] = (start, time.time())
        return out

    configs = [{"name": "one", "n": 5}, {"name": "two", "n": 7}, {"name": "bad", "n": 1}]
    got = {r.config_name: (r.purity, r.error) for r in ex.config_sweep_runner(spark, configs, run, str(tmp_path / "s"), workers=2).collect()}
    assert got["one"] == (10, None) and got["two"] == (21, None) and "no such band" in got["bad"][1]
    (a, b), (c, d) = spans["one"], spans["two"]
    assert max(a, c) < min(b, d)  # both were under way at the same time
    spans.clear()
    again = ex.config_sweep_runner(spark, [*configs, {"name": "three", "n": 3}], lambda c: run({**c, "name": "fine"} if c["name"] == "bad" else c), str(tmp_path / "s"), workers=3)
    assert {r.config_name: r.error for r in again.collect()} == {"one": None, "two": None, "bad": None, "three": None} and set(spans) == {"fine", "three"}


def test_best_k_of_a_real_sweep(spark):
    r = np.random.default_rng(4)
    x = np.vstack([c + 0.1 * r.normal(size=(30, 4)) for c in r.normal(size=(4, 4)) * 9])
    df = spark.createDataFrame([(i, i // 30, [float(v) for v in row]) for i, row in enumerate(x)], "pixel_id BIGINT, class INT, spectrum ARRAY<DOUBLE>")
    sweep = cl.kmeans_k_sweep(df, [2, 3, 4, 5], "class", n_init=4)
    assert cl.best_k(sweep).first()["k"] == 4 and cl.best_k(sweep, "purity").first()[:] == (4, 1.0)
