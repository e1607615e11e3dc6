"""Label comparison.  Pixels meet once, in the contingency table; every score is computed from its few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.columns import PIXEL, ratio
from specband.functions.linalg import assign, expected_mi_term
from specband.functions.scale import checked_broadcast, cut, scalars

TILE = 64


# -- pixel-level joins -----------------------------------------------------------------------------

def label_pairs(pred: DataFrame, truth: DataFrame, mask: DataFrame | None = None, keep_background: bool = False,
                how: str = "inner", by: list[str] = ()) -> DataFrame:
    """Pixels with both labels; ``keep_background`` also keeps negative labels."""
    pairs = truth.select(*PIXEL, "class").join(pred.select(*PIXEL, *by, "cluster"), PIXEL, how)
    if mask is not None:
        pairs = pairs.join(mask.where("keep"), PIXEL, "left_semi")
    return pairs if keep_background else pairs.where((F.col("class") >= 0) & (F.col("cluster") >= 0))


def contingency(pred: DataFrame, truth: DataFrame, mask: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    return label_pairs(pred, truth, mask, by=by).groupBy(*by, "class", "cluster").agg(F.count("*").alias("n"))


def rect_join(points: DataFrame, rects: DataFrame, how: str = "inner") -> DataFrame:
    """Points with every half-open rectangle (y0, y1, x0, x1) that contains them.

    Rectangles are listed under the coarse tiles they touch, so the join is an equality on the tile
    and works for any number of rectangles.
    """
    touched = rects.withColumn("__ty", F.explode(F.sequence(F.floor(F.col("y0") / TILE), F.floor((F.col("y1") - 1) / TILE))))
    touched = touched.withColumn("__tx", F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor((F.col("x1") - 1) / TILE))))
    keyed = points.withColumns({"__ty": F.floor(F.col("y") / TILE), "__tx": F.floor(F.col("x") / TILE)})
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    side = checked_broadcast(touched.withColumnsRenamed({"__ty": "__ry", "__tx": "__rx"}))
    cond = (F.col("__ty") == F.col("__ry")) & (F.col("__tx") == F.col("__rx")) & inside
    return keyed.join(side, cond, how).drop("__ty", "__tx", "__ry", "__rx")


# -- mappings --------------------------------------------------------------------------------------

def majority_mapping(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """cluster -> class with the largest overlap; the lowest class wins ties."""
    return ct.groupBy(*by, "cluster").agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("mapped"))


def purity(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    best = ct.groupBy(*by, "cluster").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.groupBy(*by).agg((F.sum("m") / F.sum("n")).alias("purity"))


def hungarian_mapping(ct: DataFrame, by: list[str] = (), fraction: bool = False) -> DataFrame:
    """One-to-one mapping of largest total overlap; surplus clusters keep their own id.

    ``fraction`` weighs a cell by its share of the cluster instead of its count.
    """
    by = list(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="cluster", columns="class", values="n", aggfunc="sum", fill_value=0)
        w = m.to_numpy(dtype=float)
        if fraction:
            w = w / w.sum(axis=1, keepdims=True)
        out = {int(c): int(c) for c in m.index}
        out.update({int(m.index[i]): int(m.columns[j]) for i, j in assign(-w)})
        res = pd.DataFrame({"cluster": list(out), "mapped": list(out.values())})
        for b in by:
            res[b] = pdf[b].iloc[0]
        return res[[*by, "cluster", "mapped"]]

    types = dict(ct.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["cluster INT", "mapped INT"])
    return ct.groupBy(*by).applyInPandas(solve, schema)  # a group is one clusters x classes table


def permutation_mapping(ct: DataFrame, k: int = 4) -> DataFrame:
    """Best of all k! relabelings by matched pixels: one row per cluster 0..k-1; of equal ones the first in lexicographic order.

    Dynamic programming over the sets of classes given away so far, 2^k * k steps instead of k! * k.
    """
    if k > 20:
        raise ValueError("more than 20 clusters: use hungarian_mapping")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((k, k))
        own = pdf[pdf["cluster"].between(0, k - 1) & pdf["class"].between(0, k - 1)]
        np.add.at(w, (own["cluster"].to_numpy(int), own["class"].to_numpy(int)), own["n"].to_numpy(float))
        sets = np.arange(1 << k)
        taken = sum((sets >> t) & 1 for t in range(k))
        rest, pick = np.zeros(1 << k), np.zeros(1 << k, np.int64)  # best of the clusters from popcount on, and the smallest class that gives it
        for c in range(k - 1, -1, -1):
            m = sets[taken == c]
            value = np.stack([np.where((m >> t) & 1, -np.inf, w[c, t] + rest[m | (1 << t)]) for t in range(k)])
            pick[m] = value.argmax(0)
            rest[m] = value.max(0)
        mapped, m = [], 0
        for _ in range(k):
            mapped.append(int(pick[m]))
            m |= 1 << mapped[-1]
        return pd.DataFrame({"cluster": np.arange(k, dtype=np.int32), "mapped": np.array(mapped, np.int32), "accuracy": rest[0] / max(float(pdf["n"].sum()), 1.0)})

    return ct.groupBy().applyInPandas(solve, "cluster INT, mapped INT, accuracy DOUBLE")  # the contingency table: one row per pair of labels


def apply_mapping(df: DataFrame, mapping: DataFrame, by: list[str] = ()) -> DataFrame:
    """Replace cluster ids by mapped classes; also merges the rows of a contingency table."""
    out = df.join(checked_broadcast(mapping), [*by, "cluster"], "left").withColumn(
        "cluster", F.coalesce("mapped", "cluster")).drop("mapped")
    if set(out.columns) == {*by, "class", "cluster", "n"}:
        out = out.groupBy(*by, "class", "cluster").agg(F.sum("n").alias("n"))
    return out


# -- scores from contingency -----------------------------------------------------------------------

def _pairs2(c: Column) -> Column:
    return c.cast("double") * (c - 1) / 2


def _marginals(ct: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    return (ct.groupBy(*by, "class").agg(F.sum("n").alias("n")), ct.groupBy(*by, "cluster").agg(F.sum("n").alias("n")))


def _join(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Combine one-row-per-group frames."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by)) if by else out.crossJoin(F.broadcast(p))  # one row each
    return out


def pair_scores(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adjusted Rand index and Fowlkes-Mallows index."""
    by = list(by)
    rows, cols = _marginals(ct, by)
    p = _join([
        ct.groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("same"), F.sum("n").alias("total")),
        rows.groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("in_class")),
        cols.groupBy(*by).agg(F.sum(_pairs2(F.col("n"))).alias("in_cluster"))], by)
    expected = F.col("in_class") * F.col("in_cluster") / F.nullif(_pairs2(F.col("total")), F.lit(0.0))
    top = (F.col("in_class") + F.col("in_cluster")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("same") - expected) / F.nullif(top - expected, F.lit(0.0)))
    fm = F.when(F.col("same") == 0, 0.0).otherwise(F.sqrt(F.col("same") / F.nullif(F.col("in_cluster"), F.lit(0.0)))
                                                   * F.sqrt(F.col("same") / F.nullif(F.col("in_class"), F.lit(0.0))))
    return p.select(*by, F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(fm, F.lit(0.0)).alias("fowlkes_mallows"))


def _entropy(m: DataFrame, by: list[str], name: str) -> DataFrame:
    """H = ln N - sum(n ln n) / N."""
    n = F.col("n").cast("double")
    return m.groupBy(*by).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias(name))


def information_scores(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mutual information (nats), NMI, homogeneity, completeness and V-measure."""
    by = list(by)
    rows, cols = _marginals(ct, by)
    p = _join([_entropy(ct, by, "h_joint"), _entropy(rows, by, "h_class"), _entropy(cols, by, "h_cluster")], by)
    mi = F.greatest(F.lit(0.0), F.col("h_class") + F.col("h_cluster") - F.col("h_joint"))
    p = p.withColumn("mi", mi)
    hom = F.when(F.col("h_class") < 1e-15, 1.0).otherwise(F.col("mi") / F.nullif(F.col("h_class"), F.lit(0.0)))
    com = F.when(F.col("h_cluster") < 1e-15, 1.0).otherwise(F.col("mi") / F.nullif(F.col("h_cluster"), F.lit(0.0)))
    p = p.withColumns({"homogeneity": hom, "completeness": com})
    both = F.col("homogeneity") + F.col("completeness")
    v = F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / F.nullif(both, F.lit(0.0)))
    mean_h = (F.col("h_class") + F.col("h_cluster")) / 2
    nmi = F.when(mean_h < 1e-15, 1.0).otherwise(F.col("mi") / F.nullif(mean_h, F.lit(0.0)))
    return p.select(*by, F.col("mi").alias("mutual_information"), nmi.alias("nmi"), "homogeneity", "completeness", v.alias("v_measure"))


def adjusted_mutual_info(ct: DataFrame) -> DataFrame:
    """Mutual information corrected for chance (arithmetic mean)."""
    rows, cols = _marginals(ct, [])
    r, c = rows.select(F.col("n").alias("a")), cols.select(F.col("n").alias("b"))
    n = scalars(ct.agg(F.sum("n").alias("n"))).getField("n")
    pairs = r.crossJoin(checked_broadcast(c)).withColumn("n", n)  # classes x clusters marginals

    def term(batches):
        for pdf in batches:
            yield pd.DataFrame({"emi": [expected_mi_term(int(a), int(b), int(t)) for a, b, t in pdf[["a", "b", "n"]].itertuples(index=False)]})

    emi = pairs.repartition("a", "b").mapInPandas(term, "emi DOUBLE").agg(F.sum("emi").alias("emi"))
    h = _join([_entropy(rows, [], "h_class"), _entropy(cols, [], "h_cluster"), information_scores(ct).select("mutual_information"), emi], [])
    top = (F.col("h_class") + F.col("h_cluster")) / 2 - F.col("emi")
    ami = F.when(F.abs(top) < 2.3e-16, 1.0).otherwise((F.col("mutual_information") - F.col("emi")) / F.nullif(top, F.lit(0.0)))
    return h.select(ami.alias("ami"))


def confusion(ct: DataFrame) -> DataFrame:
    """Long matrix over the union of both label sets, zeros included."""
    labels = ct.select(F.explode(F.array("class", "cluster")).alias("label")).distinct()
    t, p = labels.select(F.col("label").alias("class")), labels.select(F.col("label").alias("cluster"))
    grid = t.crossJoin(checked_broadcast(p))  # labels x labels
    return grid.join(ct, ["class", "cluster"], "left").select("class", "cluster", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_normalized(ct: DataFrame) -> DataFrame:
    cm = confusion(ct)
    row = F.sum("n").over(Window.partitionBy("class"))
    return cm.select("class", "cluster", ratio(F.col("n"), row).alias("share"))


def label_counts(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per label over both sides: true positives, support and predicted count."""
    diag = F.when(F.col("class") == F.col("cluster"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    parts = F.array(F.struct(F.col("class").alias("label"), diag.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
                    F.struct(F.col("cluster").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
    return ct.select(*by, F.inline(parts)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def per_class_full(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1, specificity, support and class name per label."""
    lc = label_counts(ct, by)
    total = F.sum("support").over(Window.partitionBy(*by, F.lit(0)))  # one row per label
    lc = lc.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    lc = lc.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
    return lc.select(
        *by, "label", "tp", "fp", "fn", "tn", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), "support",
        F.concat(F.lit("Class_"), "label").alias("class_name"))


def per_class_prf(ct: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 by diagonal position; without ``mapping`` the raw cluster ids are compared."""
    full = per_class_full(ct if mapping is None else apply_mapping(ct, mapping))
    pos = F.row_number().over(Window.orderBy("label")) - 1  # one row per label
    return full.select(pos.alias("position"), "precision", "recall", "f1")


def scores(ct: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy family, averaged precision / recall / F1, Cohen's kappa and Matthews coefficient."""
    by = list(by)
    c = per_class_full(ct, by)
    sup, pred = F.col("support").cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    total = F.sum("support")
    aggs = [F.sum("tp").alias("correct"), total.alias("total"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
            F.sum(sup * pred).alias("__tp"), F.sum(sup * sup).alias("__tt"), F.sum(pred * pred).alias("__pp")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / total).alias(f"{m}_weighted")]
    s = c.groupBy(*by).agg(*aggs)
    t = F.col("total").cast("double")
    acc = F.col("correct") / F.col("total")
    pe = F.col("__tp") / (t * t)
    kappa = (acc - pe) / F.nullif(1 - pe, F.lit(0.0))
    den = F.sqrt((t * t - F.col("__pp")) * (t * t - F.col("__tt")))
    mcc = F.when(den == 0, 0.0).otherwise((F.col("correct") * t - F.col("__tp")) / F.nullif(den, F.lit(0.0)))
    return s.select(*by, acc.alias("accuracy"), "balanced_accuracy", (1 - acc).alias("error_rate"), "correct", "total",
                    *[acc.alias(f"{m}_micro") for m in ("precision", "recall", "f1")],
                    *[f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted")],
                    kappa.alias("cohen_kappa"), mcc.alias("matthews_corrcoef"))


def compare_methods_table(preds: DataFrame, truth: DataFrame, by: str = "method") -> DataFrame:
    """All external scores, one row per method, from stacked predictions."""
    ct = contingency(preds, truth, by=[by])
    out = purity(ct, [by]).join(pair_scores(ct, [by]), by).join(information_scores(ct, [by]), by)
    mapped = apply_mapping(ct, majority_mapping(ct, [by]), [by])
    return out.join(scores(mapped, [by]), by)


def classification_report(ct: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Per-class rows followed by the macro and weighted averages."""
    t = ct if mapping is None else apply_mapping(ct, mapping)
    rows = per_class_full(t).select(F.col("class_name").alias("name"), "precision", "recall", "f1", "support")
    s = scores(t)
    avg = [s.select(F.lit(f"{a} avg").alias("name"), *[F.col(f"{m}_{a}").alias(m) for m in ("precision", "recall", "f1")],
                    F.col("total").alias("support")) for a in ("macro", "weighted")]
    return rows.unionByName(avg[0]).unionByName(avg[1])


def metrics_long(ct: DataFrame) -> DataFrame:
    """Overall row and per-class rows in one table with the union of their columns."""
    overall = scores(ct).select(F.lit("overall").alias("scope"), "accuracy", "balanced_accuracy", "cohen_kappa", "f1_weighted")
    per = per_class_full(ct).select(F.col("class_name").alias("scope"), "precision", "recall", "f1", "support")
    return overall.unionByName(per, allowMissingColumns=True)


def metrics_summary(ct: DataFrame) -> DataFrame:
    """Confusion totals: sum, trace, off-diagonal sum, number of labels, and accuracy."""
    cm = confusion(ct)
    trace = F.sum(F.when(F.col("class") == F.col("cluster"), F.col("n")).otherwise(0))
    return cm.agg(F.sum("n").alias("total"), trace.alias("trace"), (F.sum("n") - trace).alias("off_diagonal"),
                  F.countDistinct("class").alias("n_labels"), (trace / F.sum("n")).alias("accuracy"))


def confusion_row_sums(ct: DataFrame) -> DataFrame:
    return confusion(ct).groupBy("class").agg(F.sum("n").alias("row_sum"))


# -- pixel-level scores ----------------------------------------------------------------------------

def pixel_accuracy(pred: DataFrame, truth: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Unmapped accuracy over labelled pixels; missing predictions are wrong."""
    t = truth.where(F.col("class") >= 0)
    if mask is not None:
        t = t.join(mask.where("keep"), PIXEL, "left_semi")
    j = t.select(*PIXEL, "class").join(pred.select(*PIXEL, "cluster"), PIXEL, "left")
    ok = F.sum(F.when(F.col("class") == F.col("cluster"), 1).otherwise(0))
    return j.agg(F.coalesce(ok, F.lit(0)).alias("correct_pixels"), F.count("*").alias("total_pixels")).select(
        ratio(F.col("correct_pixels"), F.col("total_pixels")).alias("accuracy"), "correct_pixels", "total_pixels",
        (1 - ratio(F.col("correct_pixels"), F.col("total_pixels"))).alias("error_rate"))


def class_distribution(truth: DataFrame) -> DataFrame:
    """Counts; a class as % of labelled pixels, background as % of all."""
    counts = truth.groupBy("class").agg(F.count("*").alias("pixel_count"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    labelled = F.sum(F.when(F.col("class") >= 0, F.col("pixel_count"))).over(w)
    every = F.sum("pixel_count").over(w)
    name = F.when(F.col("class") < 0, "Background").otherwise(F.concat(F.lit("Class_"), "class"))
    return counts.select("class", name.alias("name"), "pixel_count",
                         (F.col("pixel_count") / F.when(F.col("class") >= 0, labelled).otherwise(every) * 100).alias("percentage"))


def class_distribution_compare(pred: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.where(F.col("class") >= 0).groupBy(F.col("class").alias("label")).agg(F.count("*").alias("true_count"))
    p = pred.where(F.col("cluster") >= 0).groupBy(F.col("cluster").alias("label")).agg(F.count("*").alias("pred_count"))
    return t.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("true_count", "pred_count")])


def roi_mapping(rois: DataFrame, truth: DataFrame, check: bool = True) -> DataFrame:
    """Dominant class, classes present, purity and labelled pixels per region; background-only regions are an error."""
    counts = rect_join(truth.where(F.col("class") >= 0), rois).groupBy("roi_id", "class").agg(F.count("*").alias("n"))
    if check:
        missing = rois.join(counts, "roi_id", "left_anti").select("roi_id").limit(10).collect()
        if missing:
            raise ValueError(f"regions with background only: {[m[0] for m in missing]}")
    return counts.groupBy("roi_id").agg(
        F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("class"), F.sort_array(F.collect_set("class")).alias("all_classes"),
        (F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("pixel_count"))


def roi_statistics(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("n_rois"), F.avg("purity").alias("average_purity"),
                       F.count_if(F.col("purity") == 1).alias("perfect_rois"), F.count_if(F.col("purity") != 1).alias("mixed_rois"))


def rois_per_class(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("class").agg(F.count("*").alias("n_rois"))


def roi_metrics(rois: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy of unmapped labels inside each region, dominant prediction and whether it is the region's class."""
    labelled = label_pairs(pred, truth, keep_background=True).where(F.col("class") >= 0)
    cells = rect_join(labelled, rois).groupBy("roi_id", "class", "cluster").agg(F.count("*").alias("n"))
    by_cluster = cells.groupBy("roi_id", "cluster").agg(F.sum("n").alias("n"))
    dom = by_cluster.groupBy("roi_id").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("dominant_prediction"),
                                           F.count("*").alias("n_predictions"))
    by_class = cells.groupBy("roi_id", "class").agg(F.sum("n").alias("n"))
    cls = by_class.groupBy("roi_id").agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("class"))
    ok = F.sum(F.when(F.col("class") == F.col("cluster"), F.col("n")).otherwise(0))
    acc = cells.groupBy("roi_id").agg(F.sum("n").alias("pixel_count"), ok.alias("correct_pixels"), (ok / F.sum("n")).alias("accuracy"))
    return acc.join(dom, "roi_id").join(cls, "roi_id").withColumn("class_match", F.col("dominant_prediction") == F.col("class"))


def roi_cluster_report(rois: DataFrame, pred: DataFrame) -> DataFrame:
    n = rect_join(pred.where(F.col("cluster") >= 0), rois).groupBy("roi_id", "cluster").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("roi_id")))


def prediction_mask(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """0 background, 1 correct, 2 wrong."""
    j = truth.select(*PIXEL, "class").join(pred.select(*PIXEL, "cluster"), PIXEL, "left")
    return j.select(*PIXEL, F.when(F.col("class") < 0, 0).when(F.col("class") == F.col("cluster"), 1).otherwise(2).alias("state"))


def per_class_error_map(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per labelled pixel 1 where the prediction is right, 0 where it is wrong."""
    j = truth.where(F.col("class") >= 0).select(*PIXEL, "class").join(pred.select(*PIXEL, "cluster"), PIXEL, "left")
    return j.select(*PIXEL, "class", F.when(F.col("class") == F.col("cluster"), 1).otherwise(0).alias("correct"))


def per_class_accuracy(error_map: DataFrame) -> DataFrame:
    return error_map.groupBy("class").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))


def misclassification_rate(ct: DataFrame) -> DataFrame:
    """Share of wrong pixels after the one-to-one mapping."""
    return scores(apply_mapping(ct, hungarian_mapping(ct))).select(F.col("error_rate").alias("misclassification_rate"), "total")


def compare_labelings(a: DataFrame, b: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Agreement of two label maps and the number of clusters on each side."""
    j = a.select(*PIXEL, F.col("cluster").alias("a")).join(b.select(*PIXEL, F.col("cluster").alias("b")), PIXEL)
    j = j.where((F.col("a") >= 0) & (F.col("b") >= 0))
    if mask is not None:
        j = j.join(mask.where("keep"), PIXEL, "left_semi")
    cells = j.groupBy("a", "b").agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    return cells.agg((100.0 * same / F.sum("n")).alias("agreement_pct"), (F.sum("n") - same).alias("differing"),
                     F.sum("n").alias("total"), F.countDistinct("a").alias("clusters_a"), F.countDistinct("b").alias("clusters_b"))


def improvement_map(truth: DataFrame, base: DataFrame, opt: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Per labelled pixel after majority mapping: 0 still right, 1 improved, 2 degraded, 3 still wrong."""
    base_m = apply_mapping(base, majority_mapping(contingency(base, truth, mask)))
    opt_m = apply_mapping(opt, majority_mapping(contingency(opt, truth, mask)))
    t = truth.where(F.col("class") >= 0).select(*PIXEL, "class")
    if mask is not None:
        t = t.join(mask.where("keep"), PIXEL, "left_semi")
    j = t.join(base_m.select(*PIXEL, F.col("cluster").alias("b")), PIXEL, "left").join(
        opt_m.select(*PIXEL, F.col("cluster").alias("o")), PIXEL, "left")
    was = F.coalesce(F.col("class") == F.col("b"), F.lit(False))
    now = F.coalesce(F.col("class") == F.col("o"), F.lit(False))
    return j.select(*PIXEL, F.when(~was & now, 1).when(was & ~now, 2).when(~was & ~now, 3).otherwise(0).alias("state"))


def improvement_stats(states: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    wrong, now_wrong = n(1, 3), n(2, 3)
    return states.agg(n(0, 2).alias("baseline_correct"), wrong.alias("baseline_wrong"), n(0, 1).alias("optimized_correct"),
                      now_wrong.alias("optimized_wrong"), (wrong - now_wrong).alias("noise_reduction"),
                      F.when(wrong > 0, (wrong - now_wrong) * 100.0 / F.nullif(wrong, F.lit(0))).otherwise(0.0).alias("noise_reduction_pct"),
                      n(1).alias("improved_pixels"), n(2).alias("degraded_pixels"), n(3).alias("still_wrong_pixels"))


def image_difference_stats(a: DataFrame, b: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, root mean square and largest absolute difference of cells with equal keys, one row per ``by``."""
    keys = [c for c in a.columns if c != value]
    d = F.col("__a") - F.col("__b")
    j = a.withColumnRenamed(value, "__a").join(b.withColumnRenamed(value, "__b"), keys)
    return j.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs"))


def roc_auc_ovr(scores_long: DataFrame) -> DataFrame:
    """Macro one-vs-rest area from long ``class`` (true), ``label``, ``score`` rows.

    Scores collapse to counts per distinct value first; ranks come from running counts over those
    values, so ties get their average rank.
    """
    pos = F.sum(F.when(F.col("class") == F.col("label"), 1).otherwise(0))
    levels = scores_long.groupBy("label", "score").agg(F.count("*").alias("n"), pos.alias("pos"))
    placed = _running_before(levels, "label", "score", "n")
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    s = placed.groupBy("label").agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    auc = (F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))
    return s.select(auc.alias("auc")).agg(F.avg("auc").alias("roc_auc"))


def _running_before(levels: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """Number of rows with a smaller value in the group, from range-partitioned distinct values."""
    placed = cut(levels.repartitionByRange(by, value).sortWithinPartitions(by, value)
                 .withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = placed.groupBy(by, "__p").agg(F.sum(n).alias("__t"))
    w = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "__p", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("__p", by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("__in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
            .join(parts, [by, "__p"]).withColumn("before", F.col("__off") + F.col("__in")).drop("__p", "__in", "__off"))
