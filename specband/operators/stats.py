"""Normalization and band statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from specband.functions.columns import clip, let
from specband.functions.scale import MAX_BANDS, checked_broadcast, ordinal, quantiles, scalars



# -- whole-table scaling ---------------------------------------------------------------------------

def _with_limits(cells: DataFrame, limits: DataFrame, by: list[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """Make the columns of ``limits`` (one row, or one per group) available next to every cell."""
    if not by:
        s = scalars(limits)
        return cells, s.getField
    names = [c for c in limits.columns if c not in by]
    renamed = limits.withColumnsRenamed({c: f"__{c}" for c in names})
    return cells.join(checked_broadcast(renamed), by, "left"), lambda c: F.col(f"__{c}")


def normalize_global_minmax(cells: DataFrame, eps: float = 0.0, by: list[str] = ()) -> DataFrame:
    """(v - min) / (max - min + eps) over all excitations; constant data -> 0.  ``by`` (scan_id) keeps scans apart."""
    limits = cells.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d, at = _with_limits(cells, limits, list(by))
    lo, hi, v = at("lo"), at("hi"), F.col("value")
    return d.withColumn("value", F.when((hi > lo) | F.lit(eps > 0), (v - lo) / (hi - lo + eps)).when(v.isNotNull(), 0.0)).select(*cells.columns)


def normalize_minmax(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    return normalize_global_minmax(cells, 1e-10, by)


def normalize_global_percentile(cells: DataFrame, low: float = 0.05, high: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Clip to the exact percentiles of the positive values; without any, to 0..1.  NULL cells stay NULL."""
    v = F.col("value")
    q = quantiles(cells.where(v > 0), "value", {"lo": low, "hi": high}, list(by))
    if not by:
        q = q.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    d, at = _with_limits(cells, q, list(by))
    lo, hi = F.coalesce(at("lo"), F.lit(0.0)), F.coalesce(at("hi"), F.lit(1.0))
    return d.withColumn("value", F.when(v.isNotNull(), clip((v - lo) / (hi - lo + 1e-10)))).select(*cells.columns)


def normalize_standard(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    limits = cells.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    d, at = _with_limits(cells, limits, list(by))
    return d.withColumn("value", (F.col("value") - at("m")) / (at("sd") + 1e-10)).select(*cells.columns)


# -- per-band scaling ------------------------------------------------------------------------------

def standardize_bands(cells: DataFrame, band: list[str] = ("excitation", "em_idx"), rule: str = "eps") -> DataFrame:
    """Per-band z-score with population deviation: ``eps`` adds 1e-8, ``unit`` turns 0 into 1."""
    m = cells.groupBy(*band).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__sd"))
    sd = F.col("__sd") + 1e-8 if rule == "eps" else F.when(F.col("__sd") == 0, 1.0).otherwise(F.col("__sd"))
    return cells.join(checked_broadcast(m), list(band)).withColumn("value", (F.col("value") - F.col("__m")) / sd).drop("__m", "__sd")


def band_moments(pixels: DataFrame) -> DataFrame:
    """One row with the arrays ``mean`` and ``std`` (population) over the bands of ``spectrum``."""
    per = pixels.select(F.posexplode("spectrum").alias("b", "v")).groupBy("b").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("b", "m", "s")))
    return per.agg(rows.alias("r")).select(
        F.transform("r", lambda e: e["m"]).alias("mean"), F.transform("r", lambda e: e["s"]).alias("std"))


def standardize_spectra(pixels: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Array form of the z-score; ``fit_on`` supplies the rows the moments come from; deviation 0 -> 1."""
    fit = band_moments(fit_on if fit_on is not None else pixels).first()  # two numbers per band
    std = [d if d else 1.0 for d in fit["std"]]
    centred = F.zip_with("spectrum", F.lit(list(fit["mean"])), lambda v, m: v - m)
    return pixels.withColumn("spectrum", F.zip_with(centred, F.lit(std), lambda v, d: v / d))


def snv(spectrum: Column, sample: bool = False) -> Column:
    """Standard normal variate of one spectrum (population deviation unless ``sample``)."""
    n = F.size(spectrum)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    # ``let`` evaluates mean and deviation once per spectrum instead of once per element
    return let(total(spectrum) / n, lambda mean: let(
        F.sqrt(total(F.transform(spectrum, lambda v: (v - mean) * (v - mean))) / (n - 1 if sample else n)),
        lambda sd: F.transform(spectrum, lambda v: F.when(sd == 0, F.lit(0.0)).otherwise((v - mean) / F.nullif(sd, F.lit(0.0))))))


def l2_normalize_band(cells: DataFrame, band: list[str] = ("excitation", "em_idx")) -> DataFrame:
    norm = cells.groupBy(*band).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__n"))
    return cells.join(checked_broadcast(norm), list(band)).withColumn(
        "value", F.col("value") / F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__n"))).drop("__n")


# -- statistics ------------------------------------------------------------------------------------

def mean_spectrum(cells: DataFrame, excitation: float | None = None, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Mean per band, optionally of one excitation and inside a half-open (y0, y1, x0, x1)."""
    if excitation is not None:
        cells = cells.where(F.col("excitation") == float(excitation))
    if region:
        y0, y1, x0, x1 = region
        cells = cells.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return cells.groupBy("excitation", "em_idx").agg(F.avg("value").alias("mean"))


def band_variance(cells: DataFrame, band: list[str] = ("excitation", "em_idx"), as_divisor: bool = False) -> DataFrame:
    var = F.var_pop("value")
    return cells.groupBy(*band).agg((F.when(var == 0, 1.0).otherwise(var) if as_divisor else var).alias("variance"))


def spectra_matrix(column) -> np.ndarray:
    """Arrow list column -> rows x bands (missing cells 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and len(flat) % n:
        raise ValueError("spectra of different lengths")
    return np.nan_to_num(flat.reshape(n, -1)) if n else np.zeros((0, 0))


def matrix_sum(pixels: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str = "spectrum", partitions: int | None = None) -> np.ndarray | None:
    """Sum over all rows of ``fn(rows x bands)``, a vector whose length depends on the bands only.

    Each partition adds up its own vector; partial vectors are summed in shrinking rounds, so at most
    32 of them meet on the driver.  Callers that know the number of ``partitions`` save the rounds where it is small already.
    """
    def pack(total):
        return pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    def partial(batches):
        total = None
        for batch in batches:
            x = spectra_matrix(batch.column(0))
            if len(x):
                if x.shape[1] > MAX_BANDS:
                    raise ValueError(f"{x.shape[1]} bands exceed {MAX_BANDS}")
                total = fn(x) if total is None else total + fn(x)
        if total is not None:
            yield pack(total)

    def add(batches):
        total = None
        for batch in batches:
            for row in batch.column(0):
                v = row.values.to_numpy()
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pack(total)

    parts = pixels.select(column).mapInArrow(partial, "v ARRAY<DOUBLE>")
    cores = pixels.sparkSession.sparkContext.defaultParallelism
    for width in [] if partitions is not None and partitions <= 32 else [cores, 32] if cores > 32 else [cores]:
        parts = parts.repartition(width).mapInArrow(add, "v ARRAY<DOUBLE>")
    rows = parts.collect()
    return np.sum([r["v"] for r in rows], axis=0) if rows else None


def gram(pixels: DataFrame, column: str = "spectrum") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and the B x B matrix of cross products."""
    v = matrix_sum(pixels, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]), column)
    if v is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    b = int(round((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2))
    return int(v[0]), v[1:1 + b], v[1 + b:].reshape(b, b)


def moments(pixels: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, mean, population covariance and Gram matrix of the spectra."""
    n, s, g = gram(pixels)
    mean = s / max(n, 1)
    return n, mean, g / max(n, 1) - np.outer(mean, mean), g


def correlation_matrix(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(cov / np.outer(sd, sd))


def band_correlation(pixels: DataFrame) -> DataFrame:
    """``band_a, band_b, corr``; the matrix is a table at any number of bands, a constant band correlates 0."""
    from specband.operators.gram import GramTable

    return GramTable(pixels).long("corr", "correlation")


def band_cosine(pixels: DataFrame) -> DataFrame:
    from specband.operators.gram import GramTable

    return GramTable(pixels).long("cosine", "cosine")


def band_cv_high_variability(cells: DataFrame, band: list[str] = ("excitation", "em_idx")) -> DataFrame:
    """Coefficient of variation per band, flagged above the 75th percentile of the bands."""
    cv = cells.groupBy(*band).agg((F.stddev_pop("value") / (F.avg("value") + 1e-10) * 100).alias("cv"))
    limit = scalars(cv.agg(F.percentile("cv", 0.75).alias("p"))).getField("p")  # one row per band
    return cv.withColumn("high", F.col("cv") > limit)


def outlier_rate(cells: DataFrame, z: float = 3.0, band: list[str] = ("excitation", "em_idx")) -> DataFrame:
    return standardize_bands(cells, band, "unit").agg(F.avg((F.abs(F.col("value")) > z).cast("double")).alias("outlier_rate"))


def distribution_summary(cells: DataFrame, value: str = "value") -> DataFrame:
    med = quantiles(cells, value, {"median": 0.5})
    s = scalars(med).getField("median")
    return cells.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"),
                     F.kurtosis(value).alias("kurtosis")).withColumn("median", s)


def ecdf(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Sorted values with rank / n; ``key`` makes the order total."""
    kept = df.where(F.col(value).isNotNull())
    n = scalars(kept.agg(F.count("*").alias("n"))).getField("n")
    return ordinal(kept.select(value, *key), [value, *key], "__o").select(value, *key, ((F.col("__o") + 1) / n).alias("ecdf"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin is closed."""
    s = scalars(df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")))
    lo, hi = s.getField("lo"), s.getField("hi")
    pos = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).groupBy(F.when(hi > lo, pos).otherwise(bins // 2).cast("int").alias("bin")).agg(F.count("*").alias("n"))
