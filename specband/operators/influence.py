"""Latent statistics, perturbation plans, band influence and reconstruction quality on tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.scale import checked_broadcast, quantiles, scalars
from specband.operators.stats import correlation_matrix, moments, spectra_matrix

# Fixed values.
STORED = (5, 10, 25, 50, 75, 90, 95)  # stored percentiles of a latent dimension


# -- importance of latent dimensions ---------------------------------------------------------------

def dim_importance(latent: DataFrame, method: str = "variance") -> DataFrame:
    """``variance``: sample variance; ``activation``: mean absolute value."""
    score = {"variance": F.var_samp("value"), "activation": F.avg(F.abs(F.col("value")))}[method]
    return latent.groupBy("dim_id").agg(score.alias("importance"))


def dim_importance_pca(samples: DataFrame, n_dims: int) -> DataFrame:
    """Sum of absolute loadings over the leading components of the standardized latent matrix."""
    n, _, cov, _ = moments(samples)
    k = min(2 * n_dims, len(cov), n - 1)
    values, vectors = np.linalg.eigh(correlation_matrix(cov))
    top = vectors[:, np.argsort(values)[::-1][:k]]
    rows = [(i, float(s)) for i, s in enumerate(np.abs(top).sum(axis=1))]
    return samples.sparkSession.createDataFrame(rows, "dim_id INT, importance DOUBLE")


def dim_importance_ablation(recon: DataFrame) -> DataFrame:
    """Mean squared change per excitation with the dimension zeroed, summed over excitations."""
    d = F.col("perturbed") - F.col("baseline")
    return recon.groupBy("dim_id", "excitation").agg(F.avg(d * d).alias("mse")).groupBy("dim_id").agg(F.sum("mse").alias("importance"))


def top_dims(importance: DataFrame, n: int, shape: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Best n dimensions with rank; the flat index unravels to (c, l, h, w) of ``shape``."""
    best = importance.orderBy(F.desc("importance"), "dim_id").limit(n)
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "dim_id")))  # n rows
    if shape:
        step = [int(np.prod(shape[i + 1:])) for i in range(4)]
        out = out.withColumns({a: (F.floor(F.col("dim_id") / s) % m).cast("int") for a, s, m in zip(("c", "l", "h", "w"), step, shape)})
    return out


def latent_stats(latent: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and the stored percentiles per dimension."""
    q = quantiles(latent, "value", {f"p{p}": p / 100 for p in STORED}, ["dim_id"])
    agg = latent.groupBy("dim_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return agg.join(q, "dim_id")


# -- perturbation ----------------------------------------------------------------------------------

def perturbation_plan(dims: DataFrame, magnitudes: list[float] = (10, 20, 30), directions: list[str] = ("bidirectional",)) -> DataFrame:
    """One row per (dimension, magnitude, sign); the two signs of a bidirectional test weigh one half each."""
    signs = {"bidirectional": [(-1, 0.5), (1, 0.5)], "positive": [(1, 1.0)], "negative": [(-1, 1.0)]}
    steps = [(float(m), d, s, w) for m in magnitudes for d in directions for s, w in signs[d]]
    arr = F.array(*[F.struct(F.lit(m).alias("magnitude"), F.lit(d).alias("direction"), F.lit(s).alias("sign"), F.lit(w).alias("weight")) for m, d, s, w in steps])
    return dims.select("*", F.inline(arr))


def delta_percentile(magnitude: Column, sign: Column) -> Column:
    """Value of the stored percentile nearest to 50 + sign * magnitude / 2 (first listed wins), minus the mean."""
    target = F.lit(50.0) + sign * magnitude / 2
    options = F.array(*[F.struct(F.abs(F.lit(float(p)) - target).alias("d"), F.lit(i).alias("i"), F.col(f"p{p}").alias("v")) for i, p in enumerate(STORED)])
    return F.array_min(options)["v"] - F.col("mean")


def delta_std(magnitude: Column, sign: Column) -> Column:
    return sign * (magnitude / 100.0) * F.col("std")


def delta_range(magnitude: Column, sign: Column) -> Column:
    return sign * (magnitude / 100.0) * (F.col("max") - F.col("min"))


DELTAS = {"percentile": delta_percentile, "standard_deviation": delta_std, "absolute_range": delta_range}


def perturbation_deltas(plan: DataFrame, stats: DataFrame, method: str = "percentile") -> DataFrame:
    delta = DELTAS[method](F.col("magnitude"), F.col("sign"))
    return plan.join(checked_broadcast(stats), "dim_id").withColumn("delta", delta).select(*plan.columns, "delta")


# -- influence -------------------------------------------------------------------------------------

def band_influence(recon: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Mean absolute change of every band per plan entry, times the entry's importance."""
    out = recon.groupBy("plan_id", "excitation", "em_idx").agg(F.avg(F.abs(F.col("perturbed") - F.col("baseline"))).alias("influence"))
    if importance is not None:
        out = out.join(checked_broadcast(importance), "plan_id").withColumn("influence", F.col("influence") * F.col("importance")).drop("importance")
    return out


def accumulate_influence(per_plan: DataFrame) -> DataFrame:
    """Weighted sum over the plan."""
    return per_plan.groupBy("excitation", "em_idx").agg(F.sum(F.col("influence") * F.col("weight")).alias("influence"))


def gradient_influence(pairs: DataFrame, stats: DataFrame, eps: float = 0.1) -> DataFrame:
    """Central difference of the two perturbed reconstructions, mean absolute, times score, summed over dimensions."""
    j = pairs.join(checked_broadcast(stats.select("dim_id", "std", "score")), "dim_id")
    d = (F.col("plus") - F.col("minus")) / (2 * eps * (F.col("std") + 1e-8))
    per = j.groupBy("dim_id", "score", "excitation", "em_idx").agg(F.avg(F.abs(d)).alias("m"))
    return per.groupBy("excitation", "em_idx").agg(F.sum(F.col("m") * F.col("score")).alias("influence"))


def linear_influence(deltas: DataFrame, loadings: DataFrame) -> DataFrame:
    """Influence in a linear latent space, where a shift of dimension d moves band b by delta * loading."""
    j = deltas.join(checked_broadcast(loadings), "dim_id")
    step = F.abs(F.col("delta") * F.col("loading")) * F.col("importance") * F.col("weight")
    return j.groupBy("band_id").agg(F.sum(step).alias("influence"))


def normalize_influence(influence: DataFrame, method: str = "variance", variance: DataFrame | None = None) -> DataFrame:
    if method == "none":
        return influence
    if method == "variance":
        v = F.when(F.col("variance") == 0, 1.0).otherwise(F.coalesce("variance", F.lit(1.0)))
        return influence.join(checked_broadcast(variance), ["excitation", "em_idx"], "left").withColumn("influence", F.col("influence") / v).drop("variance")
    if method == "max_per_excitation":
        top = F.max("influence").over(Window.partitionBy("excitation"))
        return influence.withColumn("influence", F.when(top > 0, F.col("influence") / F.nullif(top, F.lit(0.0))).otherwise(F.col("influence")))
    raise ValueError(f"unknown method {method}")


# -- linear latent space ---------------------------------------------------------------------------

class LinearLatent:
    """Principal axes of the spectra: ``encode`` projects, ``decode`` multiplies the loadings back."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, ratio: np.ndarray):
        self.mean, self.axes, self.ratio = mean, axes, ratio

    def loadings(self, spark) -> DataFrame:
        rows = [(b, d, float(self.axes[b, d])) for b in range(self.axes.shape[0]) for d in range(self.axes.shape[1])]
        return spark.createDataFrame(rows, "band_id INT, dim_id INT, loading DOUBLE")

    def _map(self, pixels: DataFrame, fn, source: str, target: str) -> DataFrame:
        at = pixels.columns.index(source)
        schema = ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes if n != target) + f", `{target}` ARRAY<DOUBLE>"
        keep = [i for i, n in enumerate(pixels.columns) if n != target]

        def run(batches):
            for b in batches:
                out = fn(spectra_matrix(b.column(at))) if b.num_rows else np.zeros((0, 0))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(out.shape[1], 1), dtype=np.int32)[:b.num_rows + 1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [flat], names=[b.schema.names[i] for i in keep] + [target])

        return pixels.mapInArrow(run, schema)

    def encode(self, pixels: DataFrame, target: str = "scores") -> DataFrame:
        mean, axes = self.mean, self.axes
        return self._map(pixels, lambda x: (x - mean) @ axes, "spectrum", target)

    def decode(self, scores: DataFrame, source: str = "scores", target: str = "reconstruction") -> DataFrame:
        mean, axes = self.mean, self.axes
        return self._map(scores, lambda z: z @ axes.T + mean, source, target)


def linear_latent(pixels: DataFrame, k: int) -> LinearLatent:
    """Leading k axes from the band covariance; the largest loading of every axis is positive."""
    _, mean, cov, _ = moments(pixels)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    total = values.sum()
    return LinearLatent(mean, axes, values[order] / total if total > 0 else np.zeros(len(order)))


# -- reconstruction quality ------------------------------------------------------------------------

def _psnr(mse: Column) -> Column:
    return F.when(mse > 0, 10 * F.log10(1.0 / F.nullif(mse, F.lit(0.0)))).otherwise(F.lit(float("inf")))


def reconstruction_error(cells: DataFrame, valid: str | None = "valid") -> DataFrame:
    """MSE, MAE, PSNR and count per excitation over valid cells, and the mean over excitations (NULL row)."""
    d = F.col("perturbed") - F.col("baseline")
    kept = cells.where(F.col(valid)) if valid else cells
    per = kept.groupBy("excitation").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n"))
    total = per.agg(F.lit(None).cast("double").alias("excitation"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.sum("n").alias("n"))
    return per.unionByName(total).withColumn("psnr", _psnr(F.col("mse")))


def error_map(cells: DataFrame, pixel: list[str]) -> DataFrame:
    d = F.col("perturbed") - F.col("baseline")
    return cells.groupBy(*pixel).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def _ssim(a: str, b: str) -> Column:
    c1, c2 = 0.01 ** 2, 0.03 ** 2
    ma, mb = F.avg(a), F.avg(b)
    return ((2 * ma * mb + c1) * (2 * F.covar_pop(a, b) + c2)) / ((ma * ma + mb * mb + c1) * (F.var_pop(a) + F.var_pop(b) + c2))


def global_ssim(cells: DataFrame, a: str = "baseline", b: str = "perturbed") -> DataFrame:
    """Structural similarity of one window that covers everything."""
    return cells.agg(_ssim(a, b).alias("ssim"))


def quality_by_method(cells: DataFrame, by: str) -> DataFrame:
    """PSNR (peak = maximum of the original), SSIM, MAE and correlation per reconstruction."""
    d = F.col("perturbed") - F.col("baseline")
    psnr = 20 * F.log10(F.max("baseline") / (F.sqrt(F.avg(d * d)) + 1e-10))
    return cells.groupBy(by).agg(psnr.alias("psnr"), _ssim("baseline", "perturbed").alias("ssim"), F.avg(F.abs(d)).alias("mae"), F.corr("baseline", "perturbed").alias("r"))


def impact_by_perturbation(cells: DataFrame, by: str) -> DataFrame:
    d = F.col("perturbed") - F.col("baseline")
    return cells.groupBy(by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_error"), F.corr("baseline", "perturbed").alias("r"))


def importance_profile(importance: DataFrame, n: int = 20, value: str = "value") -> DataFrame:
    """Mean importance per band, the n best bands, with the overall mean and median on every line."""
    med = scalars(quantiles(importance, value, {"m": 0.5})).getField("m")
    mean = scalars(importance.agg(F.avg(value).alias("m"))).getField("m")
    per = importance.groupBy("band_id").agg(F.avg(value).alias("importance"))
    return per.orderBy(F.desc("importance"), "band_id").limit(n).withColumns({"overall_mean": mean, "overall_median": med})


def sparsity_kl(latent: DataFrame, rho: float = 0.05, channel: str = "dim_id") -> DataFrame:
    """Sum over channels of KL(rho || mean activation), guarded by 1e-8."""
    e = 1e-8
    h = latent.groupBy(channel).agg(F.avg("value").alias("h"))
    kl = rho * F.log((rho + e) / (F.col("h") + e)) + (1 - rho) * F.log((1 - rho + e) / (1 - F.col("h") + e))
    return h.agg(F.sum(kl).alias("sparsity"))
