"""Analytics over result tables: one row per configuration, per object or per timing."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.scale import (
    argmax_rows, checked_broadcast, melt, prefix_max, quantiles, scalars,
)

# The name of the baseline, the number of all bands.
BASELINE = "BASELINE_FULL_DATA"
TOTAL_BANDS = 204


# -- configurations --------------------------------------------------------------------------------

def parse_n_bands(results: DataFrame, total: int = TOTAL_BANDS) -> DataFrame:
    """Number in front of ``bands`` in the configuration name; the baseline has all bands."""
    digits = F.regexp_extract("config_name", r"(\d+)bands", 1)
    n = F.when(F.col("config_name").contains("BASELINE"), F.lit(total)).when(digits != "", digits.cast("int"))
    return results.withColumn("n_bands", n)


def baseline_value(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    return results.where(F.col("config_name") == BASELINE).agg(F.max(metric).alias("baseline"))


def exclude_baseline(results: DataFrame) -> DataFrame:
    return results.where(F.col("config_name") != BASELINE)


def _baseline(results: DataFrame, metric: str = "accuracy"):
    return scalars(baseline_value(results, metric)).getField("baseline")


def summary_by_dim(results: DataFrame) -> DataFrame:
    r4 = lambda c: F.round(c, 4)
    return exclude_baseline(results).groupBy("perturbation_dim").agg(
        F.count("accuracy").alias("n"), r4(F.avg("accuracy")).alias("acc_mean"), r4(F.stddev_samp("accuracy")).alias("acc_std"),
        r4(F.min("accuracy")).alias("acc_min"), r4(F.max("accuracy")).alias("acc_max"), r4(F.avg("n_features")).alias("feat_mean"),
        F.min("n_features").alias("feat_min"), F.max("n_features").alias("feat_max"), r4(F.avg("data_reduction_pct")).alias("reduction_mean"))


def best_per_group(results: DataFrame, by: list[str], metric: str = "accuracy", tie: str = "config_name") -> DataFrame:
    return argmax_rows(results, by, [-F.col(metric), F.col(tie)])


def tolerance_min_bands(results: DataFrame, levels: Iterable[float] = (0.95, 0.97, 0.99)) -> DataFrame:
    """Per dimension and level the fewest bands whose accuracy reaches level * baseline; NULL when none does.

    One conditional aggregate per level over a single grouping, so configurations are read once.
    """
    base = _baseline(results)
    key = F.struct("n_bands", (-F.col("accuracy")).alias("na"), "config_name")
    levels = list(levels)
    wide = exclude_baseline(results).groupBy("perturbation_dim").agg(
        *[F.min(F.when(F.col("accuracy") >= base * lv, key)).alias(f"k{i}") for i, lv in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.col(f"k{i}").alias("k")) for i, lv in enumerate(levels)])
    return wide.select("perturbation_dim", F.inline(rows)).select(
        "perturbation_dim", "level", (base * F.col("level")).alias("threshold"), F.col("k.n_bands").alias("min_bands"),
        (-F.col("k.na")).alias("achieved_accuracy"), F.col("k.config_name").alias("config_name"))


def tolerance_region_counts(results: DataFrame) -> DataFrame:
    """Configurations per half-open region 0 / 95 / 97 / 99 / 100 % of the baseline."""
    base = _baseline(results)
    region = (F.when(F.col("accuracy") < base * 0.95, "<95%").when(F.col("accuracy") < base * 0.97, "95-97%").when(F.col("accuracy") < base * 0.99, "97-99%")
              .when(F.col("accuracy") < base, "99-100%"))
    return exclude_baseline(results).withColumn("region", region).where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"))


def difference_from_baseline(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    base = _baseline(results, metric)
    d = F.col(metric) - base
    return exclude_baseline(results).withColumns({"difference": d, "difference_pct": d / base * 100})


def distribution_by_dim(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Box statistics: quartiles and the outermost values within 1.5 interquartile ranges."""
    r = exclude_baseline(results)
    q = quantiles(r, metric, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["perturbation_dim"])
    j = r.join(checked_broadcast(q), "perturbation_dim")
    iqr, v = F.col("q3") - F.col("q1"), F.col(metric)
    return j.groupBy("perturbation_dim", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_high"))


def pareto_frontier(results: DataFrame, perf: str = "accuracy", cost: str = "n_bands") -> DataFrame:
    """Rows no other row beats: best at their cost and strictly better than everything cheaper."""
    best = results.groupBy(cost).agg(F.max(perf).alias("__best"))
    front = prefix_max(best, [cost], "__best", "__before").where("__before IS NULL OR __best > __before")
    return results.join(front.select(cost, "__best"), cost).where(F.col(perf) == F.col("__best")).drop("__best")


def efficiency(results: DataFrame, total: int = TOTAL_BANDS) -> DataFrame:
    base = _baseline(results)
    return exclude_baseline(results).withColumns({
        "accuracy_per_band": F.col("accuracy") / F.col("n_bands"), "pct_per_band": F.col("accuracy") / base * 100 / F.col("n_bands"), "relative_quality": F.col("accuracy") / (F.col("n_bands") / float(total))})


# Edges of the band-count bins.
BIN_EDGES = [0, 10, 20, 30, 50, 75, 100, 125, 150, 175, 204]


def band_bin_heatmap(results: DataFrame, dims: list[int], edges: list[int] = BIN_EDGES) -> DataFrame:
    """Best accuracy per right-closed band-count bin and dimension, as a matrix."""
    label = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        label = F.when((F.col("n_bands") > lo) & (F.col("n_bands") <= hi), f"({lo}, {hi}]").otherwise(label)
    binned = exclude_baseline(results).withColumn("bin", label).where("bin IS NOT NULL")
    wide = binned.groupBy("bin").pivot("perturbation_dim", dims).agg(F.max("accuracy"))
    return wide.select("bin", *[F.col(f"`{d}`").alias(f"dim_{d}") for d in dims])


def stability_by_dim(results: DataFrame) -> DataFrame:
    m, s = F.avg("accuracy"), F.stddev_samp("accuracy")
    return exclude_baseline(results).groupBy("perturbation_dim").agg(
        m.alias("mean"), s.alias("std"), (s / m * 100).alias("cv_pct"), (F.max("accuracy") - F.min("accuracy")).alias("range"), F.count("*").alias("n"))


def least_stable(stability: DataFrame) -> DataFrame:
    return stability.orderBy(F.desc("cv_pct"), "perturbation_dim").limit(1)


# -- objects ---------------------------------------------------------------------------------------

def object_baseline_join(objres: DataFrame, baseline_bands: int = TOTAL_BANDS) -> DataFrame:
    base = objres.where(F.col("n_bands") == baseline_bands).groupBy("object_id").agg(F.max("accuracy").alias("baseline_accuracy"))
    j = objres.join(base, "object_id", "left")
    return j.withColumns({"accuracy_diff": F.col("accuracy") - F.col("baseline_accuracy"), "accuracy_ratio": F.col("accuracy") / F.nullif(F.col("baseline_accuracy"), F.lit(0.0))})


def object_stats(joined: DataFrame) -> DataFrame:
    """Spread of accuracy over configurations and best improvement over the baseline, per object."""
    first = lambda c: F.min_by(c, F.struct("n_bands", "config_name")).alias(c)
    s = joined.groupBy("object_id").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"), F.min("accuracy").alias("accuracy_min"),
        F.max("accuracy").alias("accuracy_max"), first("true_class"), first("num_pixels"), F.max("baseline_accuracy").alias("baseline_accuracy"))
    gain = F.col("accuracy_max") - F.col("baseline_accuracy")
    return s.withColumns({"accuracy_range": F.col("accuracy_max") - F.col("accuracy_min"), "accuracy_cv": F.col("accuracy_std") / F.col("accuracy_mean") * 100,
                          "best_improvement": gain, "best_improvement_pct": gain / F.nullif(F.col("baseline_accuracy"), F.lit(0.0)) * 100})


def interesting_objects(stats: DataFrame, n: int = 5) -> DataFrame:
    """Most stable, most variable, best improvers and best baselines as one labelled list."""
    def pick(kind: str, col: str, desc: bool) -> DataFrame:
        o = F.desc(col) if desc else F.asc(col)
        return stats.orderBy(o, "object_id").limit(n).select(F.lit(kind).alias("kind"), "object_id", F.col(col).alias("value"))

    out = pick("most_stable", "accuracy_cv", False)
    for kind, col in (("most_variable", "accuracy_cv"), ("best_improvers", "best_improvement"), ("best_baseline", "baseline_accuracy")):
        out = out.unionByName(pick(kind, col, True))
    return out


def class_stats_by_bands(objres: DataFrame) -> DataFrame:
    return objres.groupBy("n_bands", "true_class").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"),
                                                       F.min("accuracy").alias("min"), F.max("accuracy").alias("max"))


def optimal_and_efficient_bands(joined: DataFrame, within: float = 0.99, total: int = TOTAL_BANDS) -> DataFrame:
    """Per object its best row and the fewest bands within 1 % of the best."""
    best = joined.groupBy("object_id").agg(
        F.max("accuracy").alias("best_accuracy"), F.min_by("n_bands", F.struct(-F.col("accuracy"), F.col("n_bands"))).alias("best_n_bands"), F.max("baseline_accuracy").alias("baseline_accuracy"))
    near = joined.select("object_id", "n_bands", "accuracy").join(best, "object_id").where(F.col("accuracy") >= F.col("best_accuracy") * within)
    eff = near.groupBy("object_id").agg(F.min("n_bands").alias("efficient_n_bands"), F.min_by("accuracy", F.struct(F.col("n_bands"), -F.col("accuracy"))).alias("efficient_accuracy"))
    return best.join(eff, "object_id").withColumns({
        "improvement": F.col("best_accuracy") - F.col("baseline_accuracy"), "band_reduction_pct": (1 - F.col("efficient_n_bands") / float(total)) * 100})


def object_accuracy_pivot(joined: DataFrame, band_counts: list[int]) -> DataFrame:
    wide = joined.groupBy("object_id", "baseline_accuracy").pivot("n_bands", band_counts).agg(F.max("accuracy"))
    return wide.orderBy(F.desc("baseline_accuracy"), "object_id").select(
        "object_id", "baseline_accuracy", *[F.col(f"`{n}`").alias(f"bands_{n}") for n in band_counts])


def overall_object_summary(joined: DataFrame) -> DataFrame:
    """Mean baseline, mean of per-object maxima and improvement: overall (class -1) and per class."""
    per = joined.groupBy("true_class", "object_id").agg(F.max("accuracy").alias("best"), F.max("baseline_accuracy").alias("base"))
    out = per.groupBy("true_class").agg(F.avg("base").alias("baseline_mean"), F.avg("best").alias("best_mean"))
    total = per.agg(F.lit(-1).alias("true_class"), F.avg("base").alias("baseline_mean"), F.avg("best").alias("best_mean"))
    return out.unionByName(total).withColumn("improvement", F.col("best_mean") - F.col("baseline_mean"))


def object_rollup(objres: DataFrame) -> DataFrame:
    """Per configuration and overall: mean, sample deviation, pixel-weighted mean and count."""
    out = objres.rollup("config_name").agg(
        F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"),
        (F.sum(F.col("accuracy") * F.col("num_pixels")) / F.nullif(F.sum("num_pixels"), F.lit(0))).alias("weighted_mean"), F.count("*").alias("n"))
    return out.withColumn("config_name", F.coalesce("config_name", F.lit("ALL")))


# -- assembling and comparing ----------------------------------------------------------------------

def results_assemble(baseline: DataFrame, configs: DataFrame) -> DataFrame:
    """Baseline and configurations with the union of their columns, failed rows kept, best first."""
    return baseline.unionByName(configs, allowMissingColumns=True).orderBy(F.desc_nulls_last("accuracy"), "config_name")


def improvement_ranking(results: DataFrame, metric: str = "purity") -> DataFrame:
    base = _baseline(results, metric)
    return exclude_baseline(results).withColumn("change_pct", (F.col(metric) - base) / base * 100).orderBy(F.desc("change_pct"), "config_name")


def metric_correlation(results: DataFrame, metrics: list[str]) -> DataFrame:
    """All pairwise Pearson coefficients from one aggregation, in long form."""
    names = sorted(metrics)
    row = results.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a in names for b in names if a <= b])
    cell = lambda a, b: F.col(f"{min(a, b)}__{max(a, b)}")
    cells = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), cell(a, b).alias("corr")) for a in metrics for b in metrics])
    return row.select(F.inline(cells))


def pair_frequency(selection: DataFrame) -> DataFrame:
    """How often a band pair was chosen and by how many configurations."""
    per = selection.groupBy("excitation", "emission", "config").agg(F.count("*").alias("n"))
    return per.groupBy("excitation", "emission").agg(F.sum("n").alias("n"), F.count("*").alias("n_configs"))


def pair_configs(selection: DataFrame) -> DataFrame:
    return selection.select("excitation", "emission", "config").distinct()


def popularity(selection: DataFrame, column: str, n: int | None = None) -> DataFrame:
    out = selection.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out if n is None else out.limit(n)


def method_performance(results: DataFrame, metric: str = "purity") -> DataFrame:
    return results.groupBy("method").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).orderBy(F.desc("mean"), "method")


def top_results(results: DataFrame, n: int = 10, metric: str = "purity") -> DataFrame:
    return results.orderBy(F.desc(metric), "config_name").limit(n)


def describe_numeric(results: DataFrame, metrics: list[str]) -> DataFrame:
    long = melt(results, [], metrics, "metric", "value")
    q = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["metric"])
    agg = long.groupBy("metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                     F.min("value").alias("min"), F.max("value").alias("max"))
    return agg.join(q, "metric")


def compare_selection_methods(results: DataFrame, a: str, b: str, metric: str = "accuracy") -> DataFrame:
    """Best, worst, mean and count of two methods with their differences."""
    def side(m: str, s: str):
        v = F.when(F.col("method") == m, F.col(metric))
        return [F.max(v).alias(f"best_{s}"), F.min(v).alias(f"worst_{s}"), F.avg(v).alias(f"mean_{s}"), F.count(v).alias(f"n_{s}")]

    row = results.where(F.col("method").isin(a, b)).agg(*side(a, "a"), *side(b, "b"))
    return row.withColumns({"best_diff": F.col("best_b") - F.col("best_a"), "mean_diff": F.col("mean_b") - F.col("mean_a")})


def trend_fit(results: DataFrame, x: str = "n_bands", y: str = "accuracy") -> DataFrame:
    """Least-squares curve y = c2*(x-m)^2 + c1*(x-m) + c0 (m = mean of x); a line below three distinct x.

    Rows collapse to one per distinct x, then to nine sums; the 3 x 3 system is solved as an expression.
    """
    per = results.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("t"))
    m = scalars(per.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))).getField("m")
    d, n, t = F.col("x") - m, F.col("n"), F.col("t")
    s = per.agg(*[F.sum(n * F.pow(d, F.lit(float(k)))).alias(f"s{k}") for k in range(5)], *[F.sum(t * F.pow(d, F.lit(float(k)))).alias(f"t{k}") for k in range(3)],
                F.count("*").alias("levels"), F.max(m).alias("m"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c, d_, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d_ * i - f * g) + c * (d_ * h - e * g)

    full = det(s4, s3, s2, s3, s2, s1, s2, s1, s0)
    quad = [det(t2, s3, s2, t1, s2, s1, t0, s1, s0) / F.nullif(full, F.lit(0.0)), det(s4, t2, s2, s3, t1, s1, s2, t0, s0) / F.nullif(full, F.lit(0.0)),
            det(s4, s3, t2, s3, s2, t1, s2, s1, t0) / F.nullif(full, F.lit(0.0))]
    line = s0 * s2 - s1 * s1
    lin = [F.lit(0.0), (s0 * t1 - s1 * t0) / F.nullif(line, F.lit(0.0)), (s2 * t0 - s1 * t1) / F.nullif(line, F.lit(0.0))]
    use = F.col("levels") >= 3
    return s.select(F.when(use, 2).otherwise(1).alias("degree"), "m", *[F.when(use, q).otherwise(w).alias(f"c{2 - i}") for i, (q, w) in enumerate(zip(quad, lin))])


def progression_best(results: DataFrame, x: str = "n_bands", metric: str = "accuracy") -> DataFrame:
    """Curve over the band count with the best value reached so far."""
    kept = results.select("config_name", x, metric).where(F.col(metric).isNotNull())
    return prefix_max(kept, [x, "config_name"], metric, "best_so_far", inclusive=True)


# -- robustness ------------------------------------------------------------------------------------

def rank_key(total: int, seed: int) -> tuple[int, int]:
    """Factor and shift of the permutation ``i -> (factor * i + shift) mod total``; the factor has no divisor in common with ``total``."""
    number = lambda name: int.from_bytes(hashlib.sha256(f"{name}|{seed}".encode()).digest(), "big") % total
    factor = max(1, number("factor"))
    while math.gcd(factor, total) != 1:
        factor += 1
    return factor, number("shift")


def unranked(rank: int, size: int, columns: list[list[int]]) -> list[int]:
    """The subset with this number in colexicographic order; ``columns[j][c]`` is the number of (j + 1)-subsets below c."""
    out = []
    for j in range(size - 1, -1, -1):
        c = bisect_right(columns[j], rank) - 1
        out.append(c)
        rank -= columns[j][c]
    return out[::-1]


def robustness_sample(bands: DataFrame, n_bands: int, max_n: int = 10_000, seed: int = 42) -> DataFrame:
    """All subsets of ``n_bands`` bands when there are at most ``max_n``, else that many distinct random ones.

    The i-th subset is the one whose number is the i-th of a keyed permutation of all subset numbers: subsets are distinct by
    construction, any two of them are (nearly) independent, and each row makes its own from its number.
    """
    ids = sorted(r["band_id"] for r in bands.select("band_id").distinct().collect())  # the band dimension
    total = math.comb(len(ids), n_bands)
    factor, shift = rank_key(total, seed) if total > max_n else (1, 0)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [[math.comb(c, j + 1) for c in range(len(ids))] for j in range(n_bands)]
        for f in frames:
            yield pd.DataFrame({"subset": [[ids[c] for c in unranked((factor * int(i) + shift) % total, n_bands, columns)] for i in f["id"]]})

    return bands.sparkSession.range(min(total, max_n)).mapInPandas(draw, "subset array<int>")


def robustness_report(scored: DataFrame, metric: str = "accuracy") -> DataFrame:
    ps = {f"p{p}": p / 100 for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    q = scalars(quantiles(scored, metric, ps))
    s = scored.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(metric).alias("n"))
    return s.select("*", q.getField("p50").alias("median"), *[q.getField(p).alias(p) for p in ps])


def percentile_of_score(scored: DataFrame, score: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Rank percentile of one score in a sample; one extra rank when the score itself occurs."""
    s = scalars(score.select(F.col(score.columns[0]).alias("s"))).getField("s")
    v = F.col(metric)
    below, upto, better = F.count_if(v < s), F.count_if(v <= s), F.count_if(v > s)
    extra = F.when(upto > below, 1).otherwise(0)
    return scored.where(v.isNotNull()).agg((50.0 * (below + upto + extra) / F.count("*")).alias("percentile"), better.alias("n_better"),
                                           (100.0 * better / F.count("*")).alias("pct_better"))


# -- timings ---------------------------------------------------------------------------------------

def timing_summary(timings: DataFrame) -> DataFrame:
    return timings.groupBy("stage").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"), F.min("seconds").alias("min"),
                                        F.max("seconds").alias("max"), F.sum("seconds").alias("total"), F.count("*").alias("n"))


def timing_per_config(timings: DataFrame) -> DataFrame:
    return timings.groupBy("config").agg(F.sum("seconds").alias("total"))


def speedup(timings: DataFrame, full: str, subset: str) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("stage") == s, F.col("seconds")))
    row = timings.agg(mean(full).alias("full_mean"), mean(subset).alias("subset_mean"))
    saved = F.col("full_mean") - F.col("subset_mean")
    return row.withColumns({"speedup": F.when(F.col("subset_mean") > 0, F.col("full_mean") / F.nullif(F.col("subset_mean"), F.lit(0.0))).otherwise(0.0),
                            "saved": saved, "saved_pct": saved / F.nullif(F.col("full_mean"), F.lit(0.0)) * 100})


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    m, s, n = F.avg(d), F.stddev_samp(d), F.count(d)
    return pairs.agg(m.alias("mean_diff"), (m / F.nullif(s / F.sqrt(n), F.lit(0.0))).alias("t"), (n - 1).alias("df"))


def two_sample_t(df: DataFrame, group: str, value: str) -> DataFrame:
    """Student's t with pooled variance between every two groups (``a`` < ``b``), with degrees of freedom and two-sided p.

    Groups are aggregated first, so pairs are pairs of (few) groups.  p is NULL where t is.
    """
    s = df.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    side = lambda x: s.select(*[F.col(c).alias(f"{c}_{x}") for c in s.columns])
    pairs = side("a").join(side("b"), F.col("g_a") < F.col("g_b"))
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / F.nullif(dof, F.lit(0)) * (1 / F.nullif(F.col("n_a"), F.lit(0)) + 1 / F.nullif(F.col("n_b"), F.lit(0)))
    diff = F.col("m_a") - F.col("m_b")
    out = pairs.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), dof.alias("df"), diff.alias("mean_diff"), (diff / F.nullif(F.sqrt(pooled), F.lit(0.0))).alias("t"))
    kind = dict(out.dtypes)["a"]

    def with_p(frames):
        for f in frames:
            f["p"] = [None if t is None or t != t else two_sided_p(float(t), int(d)) for t, d in zip(f["t"], f["df"])]
            yield f

    return out.mapInPandas(with_p, f"a {kind}, b {kind}, df BIGINT, mean_diff DOUBLE, t DOUBLE, p DOUBLE")


def two_sided_p(t: float, df: int) -> float:
    """P(|T| >= |t|) of Student's distribution: the regularized incomplete beta function as a continued fraction."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    f = c = 1.0
    d = 0.0
    for i in range(400):  # modified Lentz steps
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + step * d) or 1e-300)
        c = (1.0 + step / c) or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = front * (f - 1.0)
    return 1.0 - value if flip else value


def confidence_interval(df: DataFrame, metric: str, z: float = 1.96) -> DataFrame:
    m, half = F.avg(metric), z * F.stddev_samp(metric) / F.sqrt(F.count(metric))
    return df.agg(m.alias("mean"), (m - half).alias("low"), (m + half).alias("high"))


# -- sweeps ----------------------------------------------------------------------------------------

def finished_configs(spark, path: str) -> set[str]:
    """Names whose result was committed without an error; a failed or half-written one runs again."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/config=*/_SUCCESS"))
    if not found:
        return set()
    done = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*[str(f.getPath().getParent()) for f in found])
    return {r[0] for r in done.where(F.col("error").isNull()).select("config_name").distinct().collect()}  # one name per configuration


def config_sweep_runner(spark, configs: Iterable[dict], run: Callable[[dict], DataFrame], path: str, workers: int = 4) -> DataFrame:
    """Run ``run(config)`` (one result row) per configuration; each outcome is written under ``path`` with a commit of its own.

    Up to ``workers`` configurations run at once, each in a scheduler pool of its own, so that small jobs fill what large ones leave
    free (with the fair scheduler they share evenly).  A failing configuration becomes a row with its error text; already written names
    are skipped, so a restarted sweep continues where it stopped.
    """
    done = finished_configs(spark, path)

    def one(cfg: dict, pool: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        out = f"{path}/config={cfg['name']}"
        try:
            row = run(cfg).withColumn("error", F.lit(None).cast("string"))
            row.withColumn("config_name", F.lit(cfg["name"])).write.mode("overwrite").parquet(out)
        except Exception as exc:  # noqa: BLE001 - the sweep must survive any failing configuration
            failed = spark.createDataFrame([(cfg["name"], f"{type(exc).__name__}: {exc}")], "config_name STRING, error STRING")
            failed.write.mode("overwrite").parquet(out)

    with ThreadPoolExecutor(max_workers=max(1, workers)) as threads:
        waiting = [threads.submit(inheritable_thread_target(spark)(one), cfg, f"sweep-{i % max(1, workers)}") for i, cfg in enumerate(configs) if cfg["name"] not in done]
        for w in waiting:
            w.result()
    return spark.read.option("mergeSchema", True).option("basePath", path).parquet(f"{path}/config=*").drop("config")


def best_by_each_metric(results: DataFrame, metrics: list[str]) -> DataFrame:
    long = melt(results, ["config_name"], metrics, "metric", "value").where("value IS NOT NULL")
    return argmax_rows(long, ["metric"], [-F.col("value"), F.col("config_name")])


def parameter_effect(results: DataFrame, params: list[str], metric: str = "purity") -> DataFrame:
    """Per parameter value: mean, sample deviation, count, and mean minus the overall mean."""
    overall = scalars(results.agg(F.avg(metric).alias("m"))).getField("m")
    long = results.select(F.col(metric).alias("__v"), *[F.col(p).cast("string").alias(p) for p in params]).unpivot("__v", params, "param", "level")
    return long.groupBy("param", "level").agg(F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"), F.count("__v").alias("n")).withColumn(
        "effect", F.col("mean") - overall)


def sweep_status(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def successes(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull())


def k_comparison_sizes(assignments: DataFrame) -> DataFrame:
    n = assignments.groupBy("k", "cluster").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("k")))
