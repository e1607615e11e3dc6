"""Training sets, nearest neighbours, K-means and cluster profiles."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.columns import PIXEL, hash_order_key, let
from specband.functions.scale import bounded_pandas, checked_broadcast, cut, ordinal, require_bounded, scalars
from specband.operators.compare import rect_join, roi_mapping
from specband.operators.knn import neighbors
from specband.operators.kmeans import Run, best_of, label as nearest_label, labels as nearest_labels, lockstep
from specband.operators.stats import moments


# -- training rows ---------------------------------------------------------------------------------

def roi_training_set(pixels: DataFrame, rois: DataFrame, label: str = "roi", truth: DataFrame | None = None) -> DataFrame:
    """Pixels inside the rectangles with a ``class``; a pixel in two rectangles counts twice.

    ``roi``: the rectangle's order; ``dominant``: its most frequent true class; otherwise a pixel column.
    """
    rows = rect_join(pixels, rois)
    if label == "roi":
        return rows.withColumn("class", F.col("ord"))
    if label == "dominant":
        return rows.join(checked_broadcast(roi_mapping(rois, truth, check=False).select("roi_id", "class")), "roi_id")
    return rows.withColumn("class", F.col(label))


def training_classes_filter(spectra: DataFrame, excluded: list[str], column: str = "roi_name") -> DataFrame:
    """Rows whose region name contains none of the excluded words."""
    hit = F.lit(False)
    for word in excluded:
        hit = hit | F.col(column).contains(word)
    return spectra.where(~hit)


# -- nearest neighbours ----------------------------------------------------------------------------

def votes(k: int, weights: str = "uniform") -> Column:
    """Neighbour arrays -> array of (class, weight) over the first k, classes ascending.

    ``distance`` weighs by 1/d; exact matches then take all the weight.
    """
    d, c = F.slice("nn_d", 1, k), F.slice("nn_class", 1, k)
    if weights == "uniform":
        w = F.transform(d, lambda v: F.lit(1.0))
    else:
        w = let(F.exists(d, lambda v: v == 0), lambda hit: F.transform(
            d, lambda v: F.when(hit, (v == 0).cast("double")).otherwise(1.0 / F.nullif(v, F.lit(0.0)))))
    pairs = F.zip_with(c, w, lambda a, b: F.struct(a.alias("c"), b.alias("w")))
    return let(pairs, lambda p: F.transform(
        F.array_sort(F.array_distinct(F.transform(p, lambda e: e["c"]))),
        lambda cls: F.struct(cls.alias("class"), F.aggregate(F.filter(p, lambda e: e["c"] == cls), F.lit(0.0), lambda a, e: a + e["w"]).alias("weight"))))


def vote_label(v: Column) -> Column:
    """Heaviest class; the smallest label wins ties."""
    return F.array_min(F.transform(v, lambda e: F.struct((-e["weight"]).alias("w"), e["class"].alias("class"))))["class"]


def knn_classify(pixels: DataFrame, train: DataFrame, k: int = 5, weights: str = "uniform", metric: str = "euclidean",
                 scale: bool = True, key: str = "pixel_id") -> DataFrame:
    """Label every pixel; scaling is fitted on the training rows."""
    return neighbors(pixels, train, k, metric, scale, key).withColumn("cluster", vote_label(votes(k, weights))).drop("nn_d", "nn_id", "nn_class")


def knn_proba(pixels: DataFrame, train: DataFrame, classes: list[int], k: int = 5, weights: str = "uniform", scale: bool = True,
              key: str = "pixel_id") -> DataFrame:
    """Long ``key, class, proba`` with a row for every class."""
    v = neighbors(pixels.select(key, "spectrum"), train, k, "euclidean", scale, key).select(key, votes(k, weights).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, e: a + e["weight"])
    share = lambda c: F.aggregate(F.filter("v", lambda e: e["class"] == c), F.lit(0.0), lambda a, e: a + e["weight"])
    return v.select(key, total.alias("t"), "v", F.explode(F.lit([int(c) for c in classes])).alias("class")).select(
        key, "class", (share(F.col("class")) / F.col("t")).alias("proba"))


def threshold_class_mask(proba: DataFrame, threshold: float = 0.5) -> DataFrame:
    return proba.withColumn("keep", F.col("proba") > threshold)


def stratified_folds(rows: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """``fold`` = position within the class (by key) modulo ``folds``; classes of any size stay distributed."""
    placed = cut(ordinal(rows, ["class", key], "__o"))
    first = placed.groupBy("class").agg(F.min("__o").alias("__f"))
    return placed.join(checked_broadcast(first), "class").withColumn("fold", ((F.col("__o") - F.col("__f")) % folds).cast("int")).drop("__o", "__f")


def knn_cv(rows: DataFrame, ks: list[int], key: str = "pixel_id", folds: int = 5, weights: tuple[str, ...] = ("uniform",),
           metrics: tuple[str, ...] = ("euclidean",), scoring: str = "accuracy") -> DataFrame:
    """Score per (metric, weights, k, fold).  One search per metric serves all folds and every k: a row's neighbours come from outside its fold."""
    rows, out = cut(stratified_folds(rows, key, folds)), None
    for metric in metrics:
        nn = neighbors(rows, rows, max(ks), metric, False, key, outside="fold")
        grid = F.array(*[F.struct(F.lit(w).alias("weights"), F.lit(k).alias("k"), vote_label(votes(k, w)).alias("pred")) for w in weights for k in ks])
        part = nn.select("fold", "class", F.inline(grid)).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy("metric", "weights", "k", "fold", "class").agg(
        F.sum(F.when(F.col("class") == F.col("pred"), 1).otherwise(0)).alias("ok"), F.count("*").alias("n"))
    score = {"accuracy": F.sum("ok") / F.sum("n"), "balanced_accuracy": F.avg(F.col("ok") / F.col("n"))}[scoring]
    return per.groupBy("metric", "weights", "k", "fold").agg(score.alias("score"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds with the minimum rank of the mean."""
    s = scores.groupBy("metric", "weights", "k").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round("mean", 12)))))  # one row per setting


def best_params(summary: DataFrame) -> DataFrame:
    return summary.orderBy("rank", "metric", "weights", "k").limit(1)


# -- cross-validation tables -----------------------------------------------------------------------

def cv_rank_table(scores: DataFrame) -> DataFrame:
    """Mean, deviation and rank of every k within its cube."""
    s = scores.groupBy("cube", "k").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy("cube").orderBy(F.desc(F.round("mean", 12)))))


def cv_pivot(table: DataFrame, ks: list[int], value: str = "mean") -> DataFrame:
    wide = table.groupBy("cube").pivot("k", ks).agg(F.first(value))
    return wide.select("cube", *[F.col(f"`{k}`").alias(f"k_{k}") for k in ks])


def consensus_k(table: DataFrame) -> DataFrame:
    """Means over cubes of score, rank and deviation, each divided by its maximum over k."""
    m = table.groupBy("k").agg(F.avg("mean").alias("score"), F.avg("rank").alias("rank"), F.avg("std").alias("std"))
    w = Window.partitionBy(F.lit(0))  # one row per k
    return m.select("k", "score", *[(F.col(c) / F.max(c).over(w)).alias(f"{c}_norm") for c in ("score", "rank", "std")])


def best_ks(consensus: DataFrame, n: int = 5) -> DataFrame:
    return consensus.orderBy(F.desc("score"), "k").limit(n)


def cv_split_long(results: DataFrame, splits: list[str], by: str = "cube") -> DataFrame:
    """Statistics of the fold scores of rank-1 settings."""
    long = results.where(F.col("rank") == 1).unpivot([by], [F.col(s).cast("double").alias(s) for s in splits], "split", "score")
    return long.groupBy(by).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.stddev_samp("score").alias("std"), F.percentile("score", 0.5).alias("median"))


def class_mean_spectrum(pixels: DataFrame, by: str = "class") -> DataFrame:
    return pixels.select(by, F.posexplode("spectrum").alias("band_id", "value")).groupBy(by, "band_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def union_spectra_files(spark, path: str, schema: str) -> DataFrame:
    """All spectra CSVs as one table; the explicit schema keeps cube names text."""
    return spark.read.option("header", True).schema(schema).csv(path)


# -- K-means ---------------------------------------------------------------------------------------

def kmeans(pixels: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, starts: DataFrame | None = None) -> tuple[DataFrame, Run]:
    """Best of ``n_init`` seeded starts by cost, all fitted in the same passes: pixels with ``cluster``, and the run.

    ``starts`` (``cluster, center``; k rows) gives the starting centres instead.
    """
    if starts is not None:
        best = _from_starts(pixels, starts, max_iter, tol, _as_is)
    else:
        best = _fits(pixels, [k], n_init, seed, max_iter, tol)[k]
    return nearest_label(pixels, best, _as_is), best


def _from_starts(pixels: DataFrame, starts: DataFrame, max_iter: int, tol: float, shape) -> Run:
    """One run from given centres, which are shaped like the spectra."""
    given = np.array([r["center"] for r in require_bounded(starts.select("cluster", "center").orderBy("cluster"), "starting centres").to_dict("records")], dtype=float)
    given = shape(given)
    data = pixels.select("spectrum").persist()
    try:
        return lockstep(data, [Run(np.arange(given.shape[1]), len(given), 0, given)], shape, max_iter, tol)[0]
    finally:
        data.unpersist()


def _as_is(x: np.ndarray) -> np.ndarray:
    return x


def _fits(pixels: DataFrame, ks: list[int], n_init: int, seed: int, max_iter: int, tol: float = 1e-4, shape=_as_is) -> dict[int, Run]:
    """The best run per k; runs of all k advance together over the cached pixels."""
    data = pixels.select("spectrum").persist()
    try:
        width = len(data.first()[0])
        runs = lockstep(data, [Run(np.arange(width), k, seed + i) for k in ks for i in range(n_init)], shape, max_iter, tol)
    finally:
        data.unpersist()
    return {k: best_of([r for r in runs if r.k == k]) for k in ks}


def kmeans_large(pixels: DataFrame, k: int, sample: int | None = None, n_init: int = 10, seed: int = 42, use_pca: bool = True,
                 key: str = "pixel_id", starts: DataFrame | None = None, max_iter: int = 300) -> DataFrame:
    """Optional reduction to 50 axes, scaling on all rows, fit on all rows (or, on request, on a reproducible sample), predict everywhere.

    Fewer clusters than asked for lead to one more search over all rows with twice the starts.  ``starts`` as in ``kmeans``.
    """
    _, mean, cov, _ = moments(pixels)
    values, vectors = np.linalg.eigh(cov)
    width = len(mean)
    axes = vectors[:, np.argsort(values)[::-1][:min(50, width - 1)]] if use_pca and width > 50 else np.eye(width)
    spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", axes, cov, axes), 0.0))
    spread = np.where(spread > 0, spread, 1.0)

    def shape(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ axes / spread

    if starts is not None:
        return nearest_label(pixels, _from_starts(pixels, starts, max_iter, 1e-4, shape), shape)

    def fit(rows: DataFrame, tries: int, first: int, rounds: int) -> Run:
        data = rows.select("spectrum").persist()
        try:
            return best_of(lockstep(data, [Run(np.arange(axes.shape[1]), k, first + i) for i in range(tries)], shape, rounds, 1e-4))
        finally:
            data.unpersist()

    chosen = pixels if sample is None else cut(pixels.orderBy(hash_order_key(key, seed), key).limit(sample))
    run = fit(chosen, n_init, seed, max_iter)
    if run.filled < k:  # counts of the last round
        run = fit(pixels, 2 * n_init, seed + 1, 500)
    return nearest_label(pixels, run, shape)


def kmeans_k_sweep(pixels: DataFrame, ks: list[int], truth_col: str | None = None, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Inertia, size and (squared-distance) silhouette per k, with purity where a truth column is given."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    fits = _fits(pixels, ks, n_init, seed, 300)
    out = nearest_labels(pixels.select("spectrum", *([truth_col] if truth_col else [])), {f"__k{k}": run for k, run in fits.items()}, _as_is).persist()
    rows = []
    for k, run in fits.items():
        sil = ClusteringEvaluator(featuresCol="__v", predictionCol=f"__k{k}").evaluate(out.withColumn("__v", array_to_vector("spectrum")))
        pur = None
        if truth_col:
            c = out.groupBy(f"__k{k}", truth_col).agg(F.count("*").alias("n")).groupBy(f"__k{k}").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
            pur = c.agg((F.sum("m") / F.sum("n")).alias("p")).first()[0]
        rows.append((k, run.cost, float(sil), pur))
    out.unpersist()
    return pixels.sparkSession.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette DOUBLE, purity DOUBLE")


def best_k(sweep: DataFrame, by: str = "silhouette") -> DataFrame:
    """The k of the largest score; the smaller k wins ties."""
    return sweep.agg(F.min_by("k", F.struct(-F.col(by), F.col("k"))).alias("k"), F.max(by).alias("score"))


def assign_nearest_center(pixels: DataFrame, centers: DataFrame) -> DataFrame:
    """Nearest of the (few) centres ``cluster, center ARRAY``; the smaller id wins ties."""
    rows = bounded_pandas(centers, 4096)
    if rows is None:
        raise ValueError("more than 4096 centres")
    rows = rows.sort_values("cluster")
    c = F.lit([[float(v) for v in row] for row in rows["center"]])
    ids = F.lit([int(v) for v in rows["cluster"]])
    sq = lambda ctr: F.aggregate(F.zip_with("spectrum", ctr, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.zip_with(c, ids, lambda ctr, i: F.struct(sq(ctr).alias("d"), i.alias("i"))))
    return pixels.withColumn("__b", best).withColumns({"cluster": F.col("__b.i"), "distance": F.sqrt("__b.d")}).drop("__b")


# -- cluster tables --------------------------------------------------------------------------------

def mask_labels(pred: DataFrame, mask: DataFrame) -> DataFrame:
    """Labels of masked pixels become -1."""
    return pred.join(mask, PIXEL, "left").withColumn("cluster", F.when(F.coalesce("keep", F.lit(False)), F.col("cluster")).otherwise(-1)).drop("keep")


def cluster_profile(cells: DataFrame) -> DataFrame:
    """Mean, population deviation and pixel count per (cluster, excitation, band); NULL cells are skipped."""
    return cells.groupBy("cluster", "excitation", "em_idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def cluster_profile_by_excitation(profile: DataFrame) -> DataFrame:
    return profile.groupBy("cluster", "excitation").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def cluster_ex_em_matrix(cells: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean intensity per (excitation, band) inside the largest cluster."""
    sizes = pred.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.count("*").alias("n"))
    big = scalars(sizes.agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("c"))).getField("c")
    keep = pred.where(F.col("cluster") == big).select(*PIXEL)
    return cells.join(keep, PIXEL, "left_semi").groupBy("excitation", "em_idx").agg(F.avg("value").alias("mean"))


def cluster_sizes(pred: DataFrame) -> DataFrame:
    n = pred.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per cluster


def cluster_pattern_groups(objres: DataFrame, band_counts: list[int], k: int = 4, seed: int = 42) -> DataFrame:
    """Objects grouped by their accuracy curve: pivot (missing 0), scale, K-means, join back."""
    wide = objres.groupBy("object_id").pivot("n_bands", band_counts).agg(F.max("accuracy")).na.fill(0.0)
    vec = wide.select("object_id", array_to_vector(F.array(*[F.col(f"`{n}`") for n in band_counts])).alias("__v"))
    scaled = StandardScaler(inputCol="__v", outputCol="__f", withMean=True).fit(vec).transform(vec)
    groups = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="pattern").fit(scaled).transform(scaled).select("object_id", "pattern")
    return objres.join(groups, "object_id")
