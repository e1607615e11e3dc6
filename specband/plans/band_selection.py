"""From calibrated cells to the score of a small band set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specband.functions.columns import PIXEL
from specband.functions.scale import MAX_BANDS, cut, rank_rows, require_bounded
from specband.operators import calibrate as cal, compare as cmp
from specband.operators.classify import knn_classify
from specband.operators.reshape import cube_to_spectrum
from specband.operators.select import select_variance


def calibrated_cells(cubes: DataFrame, exposure: DataFrame, offset: float = 40.0, ref: str = "max", manifest: DataFrame | None = None) -> DataFrame:
    """Cut-off and exposure; the ``manifest`` of the scans tells the excitations, so that the cells are read once."""
    used = None if manifest is None else cal.spectral_cutoff(manifest, offset).select("scan_id", "excitation").distinct()
    return cal.normalize_exposure(cal.spectral_cutoff(cubes, offset), exposure, ref, used)


def varied_bands(cells: DataFrame, n: int) -> DataFrame:
    """The n most varying bands with a dense ``band_id`` in band order; a local table, so later steps do not rescan."""
    top = require_bounded(select_variance(cells, n, ["excitation", "em_idx"]), "selected bands", MAX_BANDS)
    top = top.sort_values(["excitation", "em_idx"]).reset_index(drop=True)
    rows = [(i, float(r.excitation), int(r.em_idx), float(r.variance)) for i, r in enumerate(top.itertuples(index=False))]
    return cells.sparkSession.createDataFrame(rows, "band_id INT, excitation DOUBLE, em_idx INT, variance DOUBLE")


def spectra_on_bands(cells: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """Pixels with one array over the chosen bands; missing cells are 0.

    ``pixel_id`` numbers (scan, y, x) in that order: scans by name, then coordinates of up to 21 bits each.
    """
    scans = rank_rows(cells.select("scan_id").distinct(), ["scan_id"], "__s")
    px = cube_to_spectrum(cells, bands, n, rule=None).join(scans, "scan_id")
    number = F.col("__s").cast("bigint") * (1 << 42) + F.col("y").cast("bigint") * (1 << 21) + F.col("x")
    return px.withColumn("pixel_id", number).drop("__s")


def classify_and_score(cells: DataFrame, bands: DataFrame, n: int, truth: DataFrame, rois: DataFrame, k: int = 5) -> DataFrame:
    """kNN trained on the labelled pixels inside the regions; purity and accuracy over all labelled pixels."""
    # written once: scaling, training rows and the vote all read these few columns instead of the cells
    px = cut(spectra_on_bands(cells, bands, n).join(truth.select(*PIXEL, "class"), PIXEL))
    train = cmp.rect_join(px.where(F.col("class") >= 0), rois).dropDuplicates(PIXEL)
    pred = knn_classify(px, train, k)
    ct = pred.where(F.col("class") >= 0).groupBy("class", "cluster").agg(F.count("*").alias("n"))
    ok = F.sum(F.when(F.col("class") == F.col("cluster"), F.col("n")).otherwise(0))
    both = cmp.purity(ct).crossJoin(F.broadcast(ct.agg((ok / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_pixels"))))  # one row each
    return both.select("purity", "accuracy", "n_pixels")


def select_and_score(cubes: DataFrame, exposure: DataFrame, truth: DataFrame, rois: DataFrame, n: int = 10, k: int = 5, manifest: DataFrame | None = None) -> DataFrame:
    """Calibrate, choose the n most varying bands, classify on them and score: one row."""
    cells = calibrated_cells(cubes, exposure, manifest=manifest)
    return classify_and_score(cells, varied_bands(cells, n), n, truth, rois, k).withColumn("n_bands", F.lit(n))
