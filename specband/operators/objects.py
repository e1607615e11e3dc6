"""Connected objects of label images and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.columns import PIXEL
from specband.functions.scale import checked_broadcast, cut, quantiles, rank_rows
from specband.operators.compare import apply_mapping, confusion, hungarian_mapping, rect_join, scores

ROW = 1 << 31  # raster key = y * ROW + x
OBJ = ["scan_id", "object_id"]
METRICS = ["accuracy", "precision", "recall", "f1", "cohen_kappa", "mcc"]


AREA = 256  # side in pixels of the areas whose tiles are labelled in one call


def label_tile(y: np.ndarray, x: np.ndarray, connectivity: int, *split: np.ndarray) -> np.ndarray:
    """Smallest raster key of every pixel's component inside one area (array form of min-label hooking); pixels touch where every ``split`` is equal."""
    y0, x0 = y.min(), x.min()
    h, w = int(y.max() - y0) + 1, int(x.max() - x0) + 1
    at = np.full((h, w), -1, dtype=np.int64)
    at[y - y0, x - x0] = np.arange(len(y))
    u, v = [], []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 2 if connectivity == 4 else 4]:
        a = at[: h - dy, max(0, -dx): w - max(0, dx)]
        b = at[dy:, max(0, dx): w + min(0, dx)]
        both = (a >= 0) & (b >= 0)
        u.append(a[both])
        v.append(b[both])
    u, v = np.concatenate(u), np.concatenate(v)
    for part in split:
        same = part[u] == part[v]
        u, v = u[same], v[same]
    order = np.argsort(y * ROW + x, kind="stable")
    rank = np.empty(len(y), dtype=np.int64)
    rank[order] = np.arange(len(y))
    ru, rv = rank[u], rank[v]
    parent = np.arange(len(y))
    while True:
        a, b = parent[ru], parent[rv]
        low = np.minimum(a, b)
        nxt = parent.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        nxt = nxt[nxt]
        if (nxt == parent).all():
            break
        parent = nxt
    key = (y * ROW + x)[order]
    return key[parent][rank]


def graph_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (root = smallest reachable id) for an undirected edge list ``u, v``.

    Every round hooks parents onto the smallest grandparent seen over an edge and shortcuts pointers, so
    the rounds grow with the logarithm of the diameter.  All minima combine map-side; popular parents do
    not gather their children.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    f = cut(both.select(F.col("u").alias("node")).distinct().withColumn("parent", F.col("node")))
    while True:
        up = f.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        g = f.join(up, "parent")
        seen = both.join(g.select(F.col("node").alias("v"), "grand"), "v").groupBy("u").agg(F.min("grand").alias("low"))
        h = g.join(seen.withColumnRenamed("u", "node"), "node")
        low = F.least("low", "grand")
        offers = h.select(F.inline(F.array(F.struct(F.col("node").alias("node"), low.alias("parent")), F.struct(F.col("parent").alias("node"), low.alias("parent")))))
        nxt = cut(f.union(offers.select("node", "parent")).groupBy("node").agg(F.min("parent").alias("parent")))
        changed = nxt.join(f.withColumnRenamed("parent", "was"), "node").where(F.col("parent") != F.col("was"))
        if changed.isEmpty():
            return nxt.select("node", F.col("parent").alias("root"))
        f = nxt


def connected_components(foreground: DataFrame, connectivity: int = 8, tile: int = 256, split_by: str | None = None) -> DataFrame:
    """Foreground pixels with ``object_id`` 1.. in raster order of each object's first pixel.

    Touching classes merge unless ``split_by`` names a label column.  Tiles are labelled on their own, small
    ones many at a time (a group is an area of whole tiles, at most 256 x 256 or tile x tile pixels); only
    pixels along tile borders then link the tile parts.
    """
    cols = [*PIXEL] + ([split_by] if split_by else [])
    area = max(1, AREA // tile) * tile
    px = foreground.select(*cols).withColumns({"__ty": F.floor(F.col("y") / area), "__tx": F.floor(F.col("x") / area)})
    types = dict(px.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", node BIGINT"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[cols].copy()
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        split = [y // tile, x // tile] + ([pdf[split_by].to_numpy()] if split_by else [])
        out["node"] = label_tile(y, x, connectivity, *split)
        return out

    parts = cut(px.groupBy("scan_id", "__ty", "__tx").applyInPandas(run, schema))
    edge = parts.where((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    steps = ((0, 1), (1, 0), (1, 1), (1, -1))[: 2 if connectivity == 4 else 4]
    arr = F.array(*[F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for dy, dx in steps])
    reach = edge.select("scan_id", F.col("node").alias("__a"), *([F.col(split_by).alias("__sa")] if split_by else []), "y", "x", F.inline(arr))
    reach = reach.where((F.floor(F.col("y") / tile) != F.floor(F.col("ny") / tile)) | (F.floor(F.col("x") / tile) != F.floor(F.col("nx") / tile))).drop("y", "x")
    links = reach.join(edge.withColumnsRenamed({"y": "ny", "x": "nx", "node": "__b"}), ["scan_id", "ny", "nx"])
    if split_by:
        links = links.where(F.col("__sa") == F.col(split_by))
    node = lambda c: F.struct("scan_id", F.col(c).alias("k"))
    links = cut(links.select(node("__a").alias("u"), node("__b").alias("v")).where("u <> v").distinct())
    nodes = parts.select("scan_id", "node").distinct()
    if links.isEmpty():
        rooted = nodes.withColumn("root", F.col("node"))
    else:
        roots = graph_components(links).select(F.col("node.scan_id").alias("scan_id"), F.col("node.k").alias("node"), F.col("root.k").alias("__r"))
        rooted = nodes.join(roots, ["scan_id", "node"], "left").withColumn("root", F.coalesce("__r", "node")).drop("__r")
    rooted = cut(rooted)
    ids = rank_rows(rooted.select("scan_id", "root").distinct(), ["scan_id", "root"], "__o")
    first = ids.groupBy("scan_id").agg(F.min("__o").alias("__f"))
    ids = ids.join(first, "scan_id").select("scan_id", "root", (F.col("__o") - F.col("__f") + 1).cast("bigint").alias("object_id"))
    named = rooted.join(ids, ["scan_id", "root"]).select("scan_id", "node", "object_id")
    return parts.join(named, ["scan_id", "node"]).select(*PIXEL, "object_id")


def filter_small(objects: DataFrame, min_size: int = 50) -> DataFrame:
    """Drop objects below ``min_size`` pixels and renumber the others per scan."""
    sizes = objects.groupBy("scan_id", "object_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("scan_id", "object_id")
    ids = rank_rows(sizes, ["scan_id", "object_id"], "__o")
    first = ids.groupBy("scan_id").agg(F.min("__o").alias("__f"))
    ids = ids.join(first, "scan_id").select("scan_id", "object_id", (F.col("__o") - F.col("__f") + 1).cast("bigint").alias("__new"))
    return objects.join(checked_broadcast(ids), ["scan_id", "object_id"]).select(*PIXEL, F.col("__new").alias("object_id"))


def object_summary(objects: DataFrame, truth: DataFrame) -> DataFrame:
    """Size, centroid, inclusive bounding box and most frequent non-background class (lowest wins ties)."""
    j = objects.join(truth.select(*PIXEL, "class"), PIXEL, "left")
    c = j.groupBy("scan_id", "object_id", "class").agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("x").alias("sx"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    cls = F.min_by("class", F.struct(F.when(F.col("class") >= 0, -F.col("n")).otherwise(1), F.col("class")))
    return c.groupBy("scan_id", "object_id").agg(
        F.sum("n").alias("pixel_count"), (F.sum("sy") / F.sum("n")).alias("centroid_y"), (F.sum("sx") / F.sum("n")).alias("centroid_x"),
        F.min("y0").alias("y_min"), F.min("x0").alias("x_min"), F.max("y1").alias("y_max"), F.max("x1").alias("x_max"), cls.alias("class_label"))


def object_size_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("total_objects"), F.avg("pixel_count").alias("mean_size"), F.stddev_pop("pixel_count").alias("std_size"),
                       F.min("pixel_count").alias("min_size"), F.max("pixel_count").alias("max_size"))


def objects_per_class(summary: DataFrame) -> DataFrame:
    n = summary.groupBy("class_label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per class


def object_pixels(objects: DataFrame, layer: DataFrame, object_id: int, scan_id: str | None = None) -> DataFrame:
    """Values of any pixel layer inside the object of that number, of one scan or of every scan."""
    mine = objects.where(F.col("object_id") == object_id)
    return layer.join(mine if scan_id is None else mine.where(F.col("scan_id") == scan_id), PIXEL)


def objects_by_class(summary: DataFrame, label: int) -> DataFrame:
    return summary.where(F.col("class_label") == label)


def assign_roi_to_objects(summary: DataFrame, rois: DataFrame) -> DataFrame:
    """First region (in ``ord``) given as half-open x, y, w, h that contains the centroid."""
    rect = rois.select("roi_id", "ord", F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    pts = summary.withColumns({"y": F.col("centroid_y"), "x": F.col("centroid_x")})
    hit = rect_join(pts, rect).groupBy("scan_id", "object_id").agg(F.min_by("roi_id", "ord").alias("roi_id"))
    return summary.join(hit, ["scan_id", "object_id"], "left")


# -- scores per object -----------------------------------------------------------------------------

def object_contingency(objects: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    j = objects.join(truth.select(*PIXEL, "class"), PIXEL).join(pred.select(*PIXEL, "cluster"), PIXEL)
    return j.groupBy(*OBJ, "class", "cluster").agg(F.count("*").alias("n"))


def object_mapped_contingency(oc: DataFrame, fraction: bool = False) -> DataFrame:
    """Per-object table after one mapping over all objects (``fraction``: by share of the cluster)."""
    total = oc.groupBy("class", "cluster").agg(F.sum("n").alias("n"))
    return apply_mapping(oc, hungarian_mapping(total, fraction=fraction)).groupBy(*OBJ, "class", "cluster").agg(F.sum("n").alias("n"))


def object_metrics(oc: DataFrame, average: str = "macro") -> DataFrame:
    """Accuracy, counts, averaged precision / recall / F1, kappa, MCC, the single true class (or -1), the class of most pixels
    (the smaller one on a tie) and the distribution of predictions."""
    rows = F.collect_list(F.struct("class", "cluster", F.col("n").cast("bigint").alias("n")))  # classes x clusters of one object
    total = lambda field, label: F.aggregate(F.filter("__r", lambda e: e[field] == label), F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])
    labels = lambda field: F.array_sort(F.array_distinct(F.transform("__r", lambda e: e[field])))
    per = oc.groupBy(*OBJ).agg(rows.alias("__r")).select(
        *OBJ, F.when(F.size(labels("class")) == 1, labels("class")[0]).otherwise(-1).alias("true_class"),
        F.array_min(F.transform(labels("class"), lambda c: F.struct((-total("class", c)).alias("n"), c.alias("c"))))["c"].alias("class_label"),
        F.map_from_entries(F.transform(labels("cluster"), lambda c: F.struct(c, total("cluster", c)))).alias("prediction_distribution"))
    return scores(oc, OBJ).join(per, OBJ).select(
        *OBJ, "true_class", "class_label", F.col("total").alias("total_pixels"), F.col("correct").alias("correct_pixels"), (F.col("total") - F.col("correct")).alias("incorrect_pixels"),
        "accuracy", *[F.col(f"{m}_{average}").alias(m) for m in ("precision", "recall", "f1")], "cohen_kappa", F.col("matthews_corrcoef").alias("mcc"), "prediction_distribution")


def object_accuracy(objects: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy over labelled pixels of each object; objects of background only are left out."""
    j = objects.join(truth.select(*PIXEL, "class"), PIXEL).join(pred.select(*PIXEL, "cluster"), PIXEL, "left")
    inside = F.col("class") >= 0
    c = j.groupBy(*OBJ).agg(F.count("*").alias("num_pixels"), F.count_if(inside).alias("labelled"), F.count_if(inside & (F.col("class") == F.col("cluster"))).alias("ok"),
                                   F.min(F.when(inside, F.col("class"))).alias("lo"), F.max(F.when(inside, F.col("class"))).alias("hi"))
    return c.where("labelled > 0").select(*OBJ, "num_pixels", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("true_class"),
                                          (F.col("ok") / F.col("labelled")).alias("accuracy"))


def aggregate_by_class(metrics: DataFrame, by: str = "class_label") -> DataFrame:
    """Counts, means, population deviations and extremes of the scores of each class's objects."""
    aggs = [F.count("*").alias("num_objects"), F.sum("total_pixels").alias("total_pixels")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return metrics.groupBy(by).agg(*aggs)


def best_worst_objects(metrics: DataFrame, metric: str = "accuracy", n: int = 5) -> DataFrame:
    best = metrics.orderBy(F.desc(metric), *OBJ).limit(n).select(F.lit("best").alias("kind"), *OBJ, metric)
    return best.unionByName(metrics.orderBy(F.asc(metric), *OBJ).limit(n).select(F.lit("worst").alias("kind"), *OBJ, metric))


def performance_matrix(metrics: DataFrame) -> DataFrame:
    return metrics.select(*OBJ, *METRICS).orderBy(*OBJ)


def object_global_summary(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and median of every score over the objects."""
    long = metrics.unpivot(OBJ, [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value").where("value IS NOT NULL")
    q = quantiles(long, "value", {"median": 0.5}, ["metric"])
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")).join(q, "metric")


def object_confusion(oc: DataFrame, object_id: int, scan_id: str | None = None) -> DataFrame:
    mine = oc.where(F.col("object_id") == object_id)
    return confusion((mine if scan_id is None else mine.where(F.col("scan_id") == scan_id)).groupBy("class", "cluster").agg(F.sum("n").alias("n")))


def object_metric_map(objects: DataFrame, metrics: DataFrame, metric: str = "accuracy") -> DataFrame:
    return objects.join(checked_broadcast(metrics.select(*OBJ, metric)), OBJ).select(*PIXEL, "object_id", metric)


def multi_config_object_compare(metrics: DataFrame, configs: list[str], metric: str = "accuracy") -> DataFrame:
    """One row per object (of its scan, where the table has scans), one column per configuration."""
    by = [c for c in OBJ if c in metrics.columns]
    return metrics.groupBy(*by).pivot("config_name", configs).agg(F.max(metric)).orderBy(*by)
