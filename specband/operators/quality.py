"""Internal cluster quality and spatial coherence."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.columns import PIXEL, hash_order_key
from specband.functions.blocks import Blocks, matrix, write_blocks
from specband.functions.scale import checked_broadcast, cut, rank_rows, require_bounded, scalars
from specband.operators.knn import BLOCK_ROWS
from specband.operators.reshape import cluster_map


CELLS = 262_144  # pairs measured at once: they stay in the cache
NEAR = 1e-4  # share of the squared sizes below which a squared distance is not left to a matrix product
TASK_ROWS = 8192


def silhouette(pixels: DataFrame, sample: int | None = None, key: str = "pixel_id", seed: int = 42, approx: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette with Euclidean distances over all rows, or on request over a reproducible sample.

    The rows are written once as blocks of one cluster each; every task adds up, block against block, the distances of its own rows to each
    cluster, so one pass yields the value and no row passes the driver.  The work grows with the square of the rows, whatever the machine;
    tasks hold at most ``TASK_ROWS`` rows on average, so that it spreads.  ``approx`` uses squared distances, which need the cluster sums only.
    """
    pts = pixels.select(key, F.col("cluster").cast("int").alias("cluster"), "spectrum")
    if approx:
        feats = pts.withColumn("features", array_to_vector("spectrum"))
        value = ClusteringEvaluator(predictionCol="cluster").evaluate(feats)
        return pixels.sparkSession.createDataFrame([(float(value),)], "silhouette DOUBLE")
    if sample is not None:
        pts = pts.orderBy(hash_order_key(key, seed), key).limit(sample)
    pts = cut(pts)
    order = F.xxhash64(key)
    placed = pts.select(F.col("cluster").alias("part"), F.lit(0.0).alias("at"), order.alias("id"), F.lit(0).alias("tag"), F.col("cluster").alias("label"), "spectrum")
    folder = write_blocks(placed.repartitionByRange("part", "id").sortWithinPartitions("part", "id"), block_rows, "silhouette")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        blocks = None
        for batch in batches:
            if blocks is None:
                blocks = Blocks(folder)
                ranges = blocks.ranges()
                ids, part = np.unique(ranges["part"], return_inverse=True)
                counts = np.bincount(part, ranges["n"], len(ids))
            x, cls = matrix(batch.column(1)), np.searchsorted(ids, batch.column(0).to_numpy())
            sums = np.zeros((len(x), len(ids)))
            for block, c in zip(ranges["block"], part):
                t = blocks.read(int(block))[0]
                step = max(1, CELLS // len(t))
                for lo in range(0, len(x), step):
                    sums[lo:lo + step, c] += exact_distances(x[lo:lo + step], t).sum(1)
            rows, n = np.arange(len(x)), counts[cls]
            if len(ids) < 2:
                value = np.zeros(len(x))
            else:
                a = sums[rows, cls] / np.maximum(n - 1, 1)
                mean = sums / counts
                mean[rows, cls] = np.inf
                b = mean.min(1, initial=np.inf)
                top = np.maximum(a, b)
                value = np.where((n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(value)], names=["v"])

    own, tasks = pts.select("cluster", "spectrum"), -(-pts.count() // TASK_ROWS)
    if tasks > own.rdd.getNumPartitions():
        own = own.repartition(tasks)
    return own.mapInArrow(run, "v double").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("silhouette"))


def exact_distances(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product; pairs near enough for cancellation (or too large for squares) are measured by their differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = (x * x).sum(1)[:, None] + (t * t).sum(1)[None, :]
        total = x @ (-2 * t).T
        total += size
        size *= NEAR
        r, c = np.nonzero(~(total > size))
        step = max(1, CELLS // max(1, x.shape[1]))
        for lo in range(0, len(r), step):
            d = x[r[lo:lo + step]] - t[c[lo:lo + step]]
            total[r[lo:lo + step], c[lo:lo + step]] = (d * d).sum(1)
        return np.sqrt(total, out=total)


def centroids(pixels: DataFrame) -> DataFrame:
    """``cluster, center, n``."""
    per = pixels.select("cluster", F.posexplode("spectrum").alias("b", "v")).groupBy("cluster", "b").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return per.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda e: e["m"]).alias("center"), F.max("n").alias("n"))


def _sq(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def dispersion(pixels: DataFrame) -> DataFrame:
    """Per cluster: centre, size, mean distance to and squared distance around the centre."""
    c = centroids(pixels)
    j = pixels.select("cluster", "spectrum").join(checked_broadcast(c), "cluster").withColumn("__sq", _sq("spectrum", "center"))
    d = j.groupBy("cluster").agg(F.avg(F.sqrt("__sq")).alias("s"), F.sum("__sq").alias("w"))
    return c.join(d, "cluster")


def davies_bouldin(pixels: DataFrame) -> DataFrame:
    d = dispersion(pixels).select("cluster", "center", "s")
    other = d.select(F.col("cluster").alias("o"), F.col("center").alias("oc"), F.col("s").alias("os"))
    pairs = d.join(checked_broadcast(other), F.col("cluster") != F.col("o"))  # clusters x clusters
    ratio = (F.col("s") + F.col("os")) / F.nullif(F.sqrt(_sq("center", "oc")), F.lit(0.0))
    worst = pairs.groupBy("cluster").agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(pixels: DataFrame) -> DataFrame:
    d = dispersion(pixels)
    m = scalars(pixels.select(F.posexplode("spectrum").alias("b", "v")).groupBy("b").agg(F.avg("v").alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda e: e["m"]).alias("mean")))
    j = d.withColumn("mean", m.getField("mean")).withColumn("b", F.col("n") * _sq("center", "mean"))
    k, n = F.count("*"), F.sum("n")
    return j.agg(F.when(F.sum("w") == 0, 1.0).otherwise((F.sum("b") / F.nullif(k - 1, F.lit(0))) / F.nullif(F.sum("w") / F.nullif(n - k, F.lit(0)), F.lit(0.0))).alias("calinski_harabasz"))


def inertia(pixels: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    c = centers if centers is not None else centroids(pixels).select("cluster", "center")
    return pixels.join(checked_broadcast(c), "cluster").agg(F.sum(_sq("spectrum", "center")).alias("inertia"))


def degenerate_guard(scores: DataFrame, db_when_single: float = float("inf")) -> DataFrame:
    """Scores of a labelling with fewer than two clusters: silhouette 0, CH 0, DB infinite (or 0)."""
    single = F.col("n_clusters") < 2
    fix = {"silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": db_when_single}
    return scores.withColumns({c: F.when(single, F.lit(v)).otherwise(F.col(c)) for c, v in fix.items() if c in scores.columns})


# -- space -----------------------------------------------------------------------------------------

def neighbour_labels(dense: DataFrame) -> DataFrame:
    """Dense label grids with arrays of the 4 straight and 4 diagonal neighbour labels (NULL outside).

    Two windows, along rows and along columns, move the labels; a group is one line of one scan.
    """
    def beside(col: str, along: str, across: str, step: int) -> Column:
        w = Window.partitionBy("scan_id", across).orderBy(along)
        return F.when(F.lag(along, step).over(w) == F.col(along) - step, F.lag(col, step).over(w))

    row = dense.withColumns({"l": beside("cluster", "x", "y", 1), "r": beside("cluster", "x", "y", -1)})
    row = row.withColumn("s", F.struct("l", F.col("cluster").alias("c"), "r"))
    both = row.withColumns({"u": beside("s", "y", "x", 1), "d": beside("s", "y", "x", -1)})
    return both.select(*PIXEL, "cluster", F.array("u.c", "d.c", "l", "r").alias("straight"), F.array("u.l", "u.r", "d.l", "d.r").alias("diagonal"))


def _same(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda n: n == F.col("cluster")))


def spatial_coherence_8(pred: DataFrame, shape: tuple[int, int] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Share of equal labels among 8 neighbours (outside counts as different), averaged over the labelled pixels of a scan."""
    n = neighbour_labels(cluster_map(pred, shape)).where(F.col("cluster") >= 0)
    v = _same(F.concat("straight", "diagonal")) / 8.0
    if mask is not None:
        n = n.join(mask.select(*PIXEL, "keep"), PIXEL, "left")
        v = v * F.coalesce(F.col("keep").cast("double"), F.lit(0.0))
    return n.groupBy("scan_id").agg(F.avg(v).alias("spatial_coherence"))


def spatial_coherence_4(pred: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Map of equal labels among 4 neighbours / 4; border and unlabelled pixels are 0."""
    n = neighbour_labels(cluster_map(pred, shape))
    on_border = F.exists("straight", lambda v: v.isNull())  # the grid is dense, so NULL means outside
    return n.select(*PIXEL, F.when(~on_border & (F.col("cluster") >= 0), _same(F.col("straight")) / 4.0).otherwise(0.0).alias("coherence"))


def relabel_consecutive(pred: DataFrame) -> DataFrame:
    """Labels in sorted order become 0..k-1."""
    labels = rank_rows(pred.select("cluster").distinct(), ["cluster"], "label")
    return pred.join(checked_broadcast(labels), "cluster").withColumn("label", F.col("label").cast("int"))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def smoothed_difference(diff: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Gaussian filter (reflected edges) of dense ``scan_id, y, x, value`` images, one axis after the other.

    Each image line is one array; the kernel runs over it in place.
    """
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2

    def along(img: DataFrame, axis: str, line: str) -> DataFrame:
        rows = img.groupBy("scan_id", line).agg(F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("__s"))
        rows = rows.select("scan_id", line, F.transform("__s", lambda e: e["value"]).alias("__v"), F.size("__s").alias("__n"),
                           F.transform("__s", lambda e: e[axis]).alias("__a"))
        n = F.col("__n")

        def at(i: Column) -> Column:
            j = F.pmod(i, 2 * n)
            return F.get("__v", F.when(j < n, j).otherwise(2 * n - 1 - j).cast("int"))

        out = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.aggregate(
            F.sequence(F.lit(0), F.lit(len(kernel) - 1)), F.lit(0.0), lambda s, q: s + F.get(F.lit(kernel), q) * at(p + q - radius)))
        return rows.select("scan_id", line, F.inline(F.arrays_zip(F.col("__a").alias(axis), out.alias("value"))))

    return along(along(diff, "x", "y"), "y", "x").select(*PIXEL, "value")
