"""Experiment analytics queries."""

import math

from pyspark.sql import functions as F

from specband.plans import experiments as ex
from workload.compare_queries import rd
from workload.registry import case

NB = "config_name <> 'BASELINE_FULL_DATA'"
BASE = "(SELECT max({m}) FROM results WHERE config_name = 'BASELINE_FULL_DATA')"
B = BASE.format(m="accuracy")


@case("k01_parse_n_bands", """SELECT config_name, CASE WHEN config_name LIKE '%BASELINE%' THEN 204 ELSE CAST(regexp_extract(config_name, '(\\d+)bands', 1) AS INT) END AS n_bands FROM results""")
def _(t):
    return ex.parse_n_bands(t.results.select("config_name"))


@case("k02_baseline_value", f"SELECT round(max(accuracy), 6) AS baseline FROM results WHERE NOT ({NB})")
def _(t):
    return rd(ex.baseline_value(t.results))


@case("k02_exclude_baseline", f"SELECT config_name FROM results WHERE {NB}")
def _(t):
    return ex.exclude_baseline(t.results).select("config_name")


@case("k03_summary_by_dim", f"""SELECT perturbation_dim, count(accuracy) AS n, round(avg(accuracy), 4) AS acc_mean, round(stddev_samp(accuracy), 4) AS acc_std, round(min(accuracy), 4) AS acc_min, round(max(accuracy), 4) AS acc_max,
    round(avg(n_features), 4) AS feat_mean, min(n_features) AS feat_min, max(n_features) AS feat_max, round(avg(data_reduction_pct), 4) AS reduction_mean FROM results WHERE {NB} GROUP BY perturbation_dim""")
def _(t):
    return ex.summary_by_dim(t.results)


@case("k04_best_per_group", f"""SELECT perturbation_dim, config_name, round(accuracy, 6) AS accuracy, n_bands FROM (SELECT *, row_number() OVER (PARTITION BY perturbation_dim ORDER BY accuracy DESC, config_name) AS rn FROM results WHERE {NB}) q WHERE rn = 1""")
def _(t):
    return rd(ex.best_per_group(ex.exclude_baseline(t.results), ["perturbation_dim"]).select("perturbation_dim", "config_name", "accuracy", "n_bands"))


@case("k05_tolerance_min_bands", f"""WITH lv AS (SELECT 0.95 AS level UNION ALL SELECT 0.97 UNION ALL SELECT 0.99 UNION ALL SELECT 9), d AS (SELECT DISTINCT perturbation_dim FROM results),
    j AS (SELECT d.perturbation_dim, CAST(lv.level AS DOUBLE) AS level, r.n_bands, r.accuracy, r.config_name, row_number() OVER (PARTITION BY d.perturbation_dim, lv.level ORDER BY r.n_bands, r.accuracy DESC, r.config_name) AS rn
      FROM d CROSS JOIN lv LEFT JOIN results r ON r.perturbation_dim = d.perturbation_dim AND r.{NB} AND r.accuracy >= {B} * CAST(lv.level AS DOUBLE))
    SELECT perturbation_dim, level, round({B} * level, 6) AS threshold, n_bands AS min_bands, round(accuracy, 6) AS achieved_accuracy, config_name FROM j WHERE rn = 1""")
def _(t):
    return rd(ex.tolerance_min_bands(t.results, (0.95, 0.97, 0.99, 9)))


@case("k06_tolerance_region_counts", f"""SELECT CASE WHEN accuracy < {B} * 0.95 THEN '<95%' WHEN accuracy < {B} * 0.97 THEN '95-97%' WHEN accuracy < {B} * 0.99 THEN '97-99%' ELSE '99-100%' END AS region, count(*) AS n
    FROM results WHERE {NB} AND accuracy < {B} GROUP BY 1""")
def _(t):
    return ex.tolerance_region_counts(t.results)


@case("k07_difference_from_baseline", f"SELECT config_name, round(accuracy - {B}, 6) + 0.0 AS difference, round((accuracy - {B}) / {B} * 100, 6) + 0.0 AS difference_pct FROM results WHERE {NB}")
def _(t):
    return rd(ex.difference_from_baseline(t.results).select("config_name", "difference", "difference_pct"))


@case("k08_distribution_by_dim", f"""WITH q AS (SELECT perturbation_dim, quantile_cont(accuracy, 0.25) AS q1, quantile_cont(accuracy, 0.5) AS median, quantile_cont(accuracy, 0.75) AS q3 FROM results WHERE {NB} GROUP BY 1)
    SELECT q.perturbation_dim, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN accuracy >= q1 - 1.5 * (q3 - q1) THEN accuracy END), 6) AS whisker_low,
    round(max(CASE WHEN accuracy <= q3 + 1.5 * (q3 - q1) THEN accuracy END), 6) AS whisker_high FROM q JOIN results r ON r.perturbation_dim = q.perturbation_dim AND {NB} GROUP BY ALL""")
def _(t):
    return rd(ex.distribution_by_dim(t.results))


@case("k09_pareto_frontier", """WITH g AS (SELECT n_bands, max(accuracy) AS a FROM results GROUP BY n_bands), f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.n_bands < g.n_bands AND h.a >= g.a))
    SELECT r.config_name, r.n_bands, round(r.accuracy, 6) AS accuracy FROM results r JOIN f ON r.n_bands = f.n_bands AND r.accuracy = f.a""")
def _(t):
    return rd(ex.pareto_frontier(t.results).select("config_name", "n_bands", "accuracy"))


@case("k10_efficiency", f"SELECT config_name, round(accuracy / n_bands, 8) AS accuracy_per_band, round(accuracy / {B} * 100 / n_bands, 6) AS pct_per_band, round(accuracy / (n_bands / CAST(204 AS DOUBLE)), 6) AS relative_quality FROM results WHERE {NB}")
def _(t):
    e = ex.efficiency(t.results)
    return e.select("config_name", F.round("accuracy_per_band", 8).alias("accuracy_per_band"), F.round("pct_per_band", 6).alias("pct_per_band"), F.round("relative_quality", 6).alias("relative_quality"))


def _heat():
    e = ex.BIN_EDGES
    bins = " ".join(f"WHEN n_bands > {a} AND n_bands <= {b} THEN '({a}, {b}]'" for a, b in zip(e, e[1:]))
    cols = ", ".join(f"round(max(CASE WHEN perturbation_dim = {d} THEN accuracy END), 6) AS dim_{d}" for d in range(1, 8))
    return f"SELECT CASE {bins} END AS bin, {cols} FROM results WHERE {NB} GROUP BY 1"


@case("k11_band_bin_heatmap", _heat())
def _(t):
    return rd(ex.band_bin_heatmap(t.results, list(range(1, 8))))


@case("k12_stability_by_dim", f"""SELECT perturbation_dim, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(stddev_samp(accuracy) / avg(accuracy) * 100, 6) AS cv_pct, round(max(accuracy) - min(accuracy), 6) AS range, count(*) AS n FROM results WHERE {NB} GROUP BY 1""")
def _(t):
    return rd(ex.stability_by_dim(t.results))


@case("k12_least_stable", f"SELECT perturbation_dim, round(stddev_samp(accuracy) / avg(accuracy) * 100, 6) AS cv_pct FROM results WHERE {NB} GROUP BY 1 ORDER BY stddev_samp(accuracy) / avg(accuracy) DESC LIMIT 1")
def _(t):
    return rd(ex.least_stable(ex.stability_by_dim(t.results)).select("perturbation_dim", "cv_pct"))


OJ = "oj AS (SELECT o.*, b.accuracy AS baseline_accuracy FROM objres o LEFT JOIN (SELECT object_id, accuracy FROM objres WHERE n_bands = 70) b ON o.object_id = b.object_id)"


def oj(t):
    return ex.object_baseline_join(t.objres, 70)


@case("k13_object_baseline_join", "WITH " + OJ + " SELECT config_name, object_id, round(accuracy, 6) AS accuracy, round(baseline_accuracy, 6) AS baseline_accuracy, round(accuracy - baseline_accuracy, 6) AS accuracy_diff, round(accuracy / baseline_accuracy, 6) AS accuracy_ratio FROM oj")
def _(t):
    return rd(oj(t).select("config_name", "object_id", "accuracy", "baseline_accuracy", "accuracy_diff", "accuracy_ratio"))


OS = OJ + """, os AS (SELECT object_id, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_std, min(accuracy) AS accuracy_min, max(accuracy) AS accuracy_max, min_by(true_class, n_bands) AS true_class,
    min_by(num_pixels, n_bands) AS num_pixels, max(baseline_accuracy) AS baseline_accuracy, max(accuracy) - min(accuracy) AS accuracy_range, stddev_samp(accuracy) / avg(accuracy) * 100 AS accuracy_cv,
    max(accuracy) - max(baseline_accuracy) AS best_improvement, (max(accuracy) - max(baseline_accuracy)) / max(baseline_accuracy) * 100 AS best_improvement_pct FROM oj GROUP BY object_id)"""
OSC = ["accuracy_mean", "accuracy_std", "accuracy_min", "accuracy_max", "baseline_accuracy", "accuracy_range", "accuracy_cv", "best_improvement", "best_improvement_pct"]


@case("k14_object_stats", "WITH " + OS + " SELECT object_id, true_class, num_pixels, " + ", ".join(f"round({c}, 6) AS {c}" for c in OSC) + " FROM os")
def _(t):
    return rd(ex.object_stats(oj(t)))


def _pick(kind, col, d):
    return f"(SELECT '{kind}' AS kind, object_id, round({col}, 6) AS value FROM os ORDER BY {col} {d}, object_id LIMIT 5)"


@case("k15_interesting_objects", "WITH " + OS + " SELECT * FROM (" + " UNION ALL ".join([_pick("most_stable", "accuracy_cv", ""), _pick("most_variable", "accuracy_cv", "DESC"), _pick("best_improvers", "best_improvement", "DESC"), _pick("best_baseline", "baseline_accuracy", "DESC")]) + ") q")
def _(t):
    return rd(ex.interesting_objects(ex.object_stats(oj(t))))


@case("k16_class_stats_by_bands", "SELECT n_bands, true_class, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max FROM objres GROUP BY n_bands, true_class")
def _(t):
    return rd(ex.class_stats_by_bands(t.objres))


@case("k17_optimal_and_efficient_bands", "WITH " + OJ + """, b AS (SELECT object_id, accuracy AS best_accuracy, n_bands AS best_n_bands, baseline_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY accuracy DESC, n_bands) AS rn FROM oj) q WHERE rn = 1),
    e AS (SELECT * FROM (SELECT o.object_id, o.n_bands, o.accuracy, row_number() OVER (PARTITION BY o.object_id ORDER BY o.n_bands, o.accuracy DESC) AS rn FROM oj o JOIN b ON o.object_id = b.object_id WHERE o.accuracy >= b.best_accuracy * 0.99) q WHERE rn = 1)
    SELECT b.object_id, round(best_accuracy, 6) AS best_accuracy, best_n_bands, round(baseline_accuracy, 6) AS baseline_accuracy, e.n_bands AS efficient_n_bands, round(e.accuracy, 6) AS efficient_accuracy,
    round(best_accuracy - baseline_accuracy, 6) AS improvement, round((1 - e.n_bands / CAST(204 AS DOUBLE)) * 100, 6) AS band_reduction_pct FROM b JOIN e ON b.object_id = e.object_id""")
def _(t):
    return rd(ex.optimal_and_efficient_bands(oj(t)))


@case("k18_object_accuracy_pivot", "WITH " + OJ + " SELECT object_id, round(max(baseline_accuracy), 6) AS baseline_accuracy, " + ", ".join(f"round(max(CASE WHEN n_bands = {n} THEN accuracy END), 6) AS bands_{n}" for n in range(10, 80, 10)) + " FROM oj GROUP BY object_id")
def _(t):
    return rd(ex.object_accuracy_pivot(oj(t), list(range(10, 80, 10))))


@case("k19_overall_object_summary", "WITH " + OJ + """, p AS (SELECT true_class, object_id, max(accuracy) AS best, max(baseline_accuracy) AS base FROM oj GROUP BY 1, 2)
    SELECT true_class, round(avg(base), 6) AS baseline_mean, round(avg(best), 6) AS best_mean, round(avg(best) - avg(base), 6) AS improvement FROM p GROUP BY 1
    UNION ALL SELECT -1, round(avg(base), 6), round(avg(best), 6), round(avg(best) - avg(base), 6) FROM p""")
def _(t):
    return rd(ex.overall_object_summary(oj(t)))


@case("k20_object_rollup", """SELECT coalesce(config_name, 'ALL') AS config_name, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(sum(accuracy * num_pixels) / sum(num_pixels), 6) AS weighted_mean, count(*) AS n FROM objres GROUP BY ROLLUP (config_name)""")
def _(t):
    return rd(ex.object_rollup(t.objres))


@case("k21_results_assemble", f"""SELECT config_name, CASE WHEN {NB} THEN method END AS method, round(accuracy, 6) AS accuracy, error FROM results""")
def _(t):
    r = t.results
    base = r.where("config_name = 'BASELINE_FULL_DATA'").select("config_name", "accuracy", "error")
    return rd(ex.results_assemble(base, ex.exclude_baseline(r).select("config_name", "method", "accuracy", "error")))


@case("k22_improvement_ranking", f"SELECT config_name, round((purity - {BASE.format(m='purity')}) / {BASE.format(m='purity')} * 100, 6) AS change_pct FROM results WHERE {NB}")
def _(t):
    return rd(ex.improvement_ranking(t.results).select("config_name", "change_pct"))


MET = ["accuracy", "purity", "ari", "nmi", "n_bands"]


@case("k23_metric_correlation", " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS corr FROM results" for a in MET for b in MET))
def _(t):
    return rd(ex.metric_correlation(t.results, MET))


@case("k24_pair_frequency", "SELECT excitation, emission, count(*) AS n, count(DISTINCT config) AS n_configs FROM picks GROUP BY excitation, emission")
def _(t):
    return ex.pair_frequency(t.picks)


@case("k24_pair_configs", "SELECT DISTINCT excitation, emission, config FROM picks")
def _(t):
    return ex.pair_configs(t.picks)


@case("k25_excitation_popularity", "SELECT excitation, count(*) AS n FROM picks GROUP BY excitation")
def _(t):
    return ex.popularity(t.picks, "excitation")


@case("k25_top_emissions", "SELECT emission, count(*) AS n FROM picks GROUP BY emission ORDER BY n DESC, emission LIMIT 15")
def _(t):
    return ex.popularity(t.picks, "emission", 15)


@case("k26_method_performance", "SELECT method, round(avg(purity), 6) AS mean, round(stddev_samp(purity), 6) AS std FROM results GROUP BY method")
def _(t):
    return rd(ex.method_performance(t.results))


@case("k27_top_results", "SELECT config_name, round(purity, 6) AS purity FROM results ORDER BY results.purity DESC, config_name LIMIT 10")
def _(t):
    return rd(ex.top_results(t.results).select("config_name", "purity"))


@case("k28_describe_numeric", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS count, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(CAST(min({m}) AS DOUBLE), 6) AS min, round(CAST(max({m}) AS DOUBLE), 6) AS max, round(quantile_cont({m}, 0.25), 6) AS q25, round(quantile_cont({m}, 0.5), 6) AS q50, round(quantile_cont({m}, 0.75), 6) AS q75 FROM results" for m in MET))
def _(t):
    return rd(ex.describe_numeric(t.results, MET))


@case("k29_compare_selection_methods", "WITH r AS (SELECT " + ", ".join(f"max(accuracy) FILTER (method = '{m}') AS best_{s}, min(accuracy) FILTER (method = '{m}') AS worst_{s}, avg(accuracy) FILTER (method = '{m}') AS mean_{s}, count(accuracy) FILTER (method = '{m}') AS n_{s}" for m, s in (("pca", "a"), ("mmr", "b"))) + """ FROM results)
    SELECT round(best_a, 6) AS best_a, round(worst_a, 6) AS worst_a, round(mean_a, 6) AS mean_a, n_a, round(best_b, 6) AS best_b, round(worst_b, 6) AS worst_b, round(mean_b, 6) AS mean_b, n_b, round(best_b - best_a, 6) AS best_diff, round(mean_b - mean_a, 6) AS mean_diff FROM r""")
def _(t):
    return rd(ex.compare_selection_methods(t.results, "pca", "mmr"))


@case("k30_trend_fit", """WITH m AS (SELECT avg(n_bands) AS m FROM results), d AS (SELECT n_bands - m AS d, accuracy - 0.3 * pow((n_bands - m) / 100, 2) + 0.02 * n_bands AS y, m FROM results, m),
    s AS (SELECT max(m) AS m, CAST(count(*) AS DOUBLE) AS s0, sum(d) AS s1, sum(d*d) AS s2, sum(d*d*d) AS s3, sum(d*d*d*d) AS s4, sum(y) AS t0, sum(d*y) AS t1, sum(d*d*y) AS t2 FROM d),
    dd AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS det FROM s)
    SELECT 2 AS degree, round(m, 6) AS m, round((t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / det, 8) AS c2, round((s4*(t1*s0 - s1*t0) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / det, 6) AS c1,
    round((s4*(s2*t0 - t1*s1) - s3*(s3*t0 - t1*s2) + t2*(s3*s1 - s2*s2)) / det, 6) AS c0 FROM dd""")
def _(t):
    from specband.functions.scale import scalars

    m = scalars(t.results.agg(F.avg("n_bands").alias("m"))).getField("m")
    r = t.results.withColumn("y", F.col("accuracy") - 0.3 * F.pow((F.col("n_bands") - m) / 100, F.lit(2)) + 0.02 * F.col("n_bands"))
    f = ex.trend_fit(r, "n_bands", "y")
    return f.select("degree", F.round("m", 6).alias("m"), F.round("c2", 8).alias("c2"), F.round("c1", 6).alias("c1"), F.round("c0", 6).alias("c0"))


@case("k31_progression_best", "SELECT config_name, n_bands, round(accuracy, 6) AS accuracy, round(max(accuracy) OVER (ORDER BY n_bands, config_name ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM results")
def _(t):
    return rd(ex.progression_best(t.results))


@case("k32_robustness_sample_pairs", "SELECT CAST(a.band_id AS INT) AS a, CAST(b.band_id AS INT) AS b FROM influence a JOIN influence b ON a.band_id < b.band_id")
def _(t):
    return ex.robustness_sample(t.influence, 2, 10**6).select(F.col("subset")[0].alias("a"), F.col("subset")[1].alias("b"))


TOTAL = math.comb(64, 13)
FACTOR, SHIFT = ex.rank_key(TOTAL, 42)


@case("k32_robustness_sample_random", f"""WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY band_id) - 1 AS c, band_id FROM bands),
    bin AS (SELECT 0 AS j, c, CAST(1 AS HUGEINT) AS v FROM (SELECT unnest(range(64)) AS c) q
      UNION ALL SELECT j + 1, c, coalesce(sum(v) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT FROM bin WHERE j < 13),
    l AS (SELECT j, list(v ORDER BY c) AS vs FROM bin GROUP BY j),
    u AS (SELECT i, 13 AS j, ({FACTOR}::HUGEINT * i + {SHIFT}::HUGEINT) % {TOTAL}::HUGEINT AS r, CAST([] AS BIGINT[]) AS s FROM (SELECT unnest(range(10000)) AS i) q
      UNION ALL SELECT i, j - 1, r - list_max(w), list_prepend(CAST(len(w) - 1 AS BIGINT), s)
      FROM (SELECT i, u.j, r, s, list_filter(l.vs, lambda v: v <= u.r) AS w FROM u JOIN l ON l.j = u.j WHERE u.j > 0) q)
    SELECT string_agg(CAST(band_id AS VARCHAR), ',' ORDER BY band_id) AS subset FROM (SELECT i, unnest(s) AS c FROM u WHERE j = 0) q JOIN b ON b.c = q.c GROUP BY i""")
def _(t):
    return ex.robustness_sample(t.bands, 13).select(F.concat_ws(",", F.col("subset").cast("array<string>")).alias("subset"))


PCT = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@case("k34_robustness_report", "SELECT round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max, count(accuracy) AS n, round(median(accuracy), 6) AS median, " + ", ".join(f"round(quantile_cont(accuracy, {p / 100}), 6) AS p{p}" for p in PCT) + " FROM results")
def _(t):
    return rd(ex.robustness_report(t.results))


@case("k34_top_subsets", "SELECT config_name, round(accuracy, 6) AS accuracy FROM results ORDER BY results.accuracy DESC, config_name LIMIT 10")
def _(t):
    return rd(ex.top_results(t.results, 10, "accuracy").select("config_name", "accuracy"))


@case("k35_percentile_of_score", f"""SELECT 50.0 * (CAST(sum(CASE WHEN accuracy < {B} THEN 1 ELSE 0 END) AS DOUBLE) + sum(CASE WHEN accuracy <= {B} THEN 1 ELSE 0 END) + max(CASE WHEN accuracy = {B} THEN 1 ELSE 0 END)) / count(*) AS percentile,
    CAST(sum(CASE WHEN accuracy > {B} THEN 1 ELSE 0 END) AS BIGINT) AS n_better, 100.0 * CAST(sum(CASE WHEN accuracy > {B} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pct_better FROM results""")
def _(t):
    return ex.percentile_of_score(t.results, ex.baseline_value(t.results))


@case("k36_timing_summary", "SELECT stage, round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS std, round(min(seconds), 6) AS min, round(max(seconds), 6) AS max, round(sum(seconds), 4) AS total, count(*) AS n FROM timings GROUP BY stage")
def _(t):
    return rd(ex.timing_summary(t.timings)).withColumn("total", F.round("total", 4))


@case("k36_timing_per_config", "SELECT config, round(sum(seconds), 4) AS total FROM timings GROUP BY config")
def _(t):
    return rd(ex.timing_per_config(t.timings), 4)


@case("k37_speedup", """WITH m AS (SELECT avg(seconds) FILTER (stage = 'view') AS f, avg(seconds) FILTER (stage = 'click') AS s FROM timings) SELECT round(f, 6) AS full_mean, round(s, 6) AS subset_mean, round(f / s, 6) AS speedup, round(f - s, 6) AS saved, round((f - s) / f * 100, 6) AS saved_pct FROM m""")
def _(t):
    return rd(ex.speedup(t.timings, "view", "click"))


@case("k38_two_sample_t", """WITH s AS (SELECT event_type AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type),
    p AS (SELECT a.g AS a, b.g AS b, a.n + b.n - 2 AS df, a.m - b.m AS d, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n) AS e FROM s a JOIN s b ON a.g < b.g)
    SELECT a, b, df, round(d, 6) AS mean_diff, round(d / sqrt(e), 5) AS t FROM p""")
def _(t):
    out = ex.two_sample_t(t.raw("events"), "event_type", "value")
    return rd(out.drop("t", "p")).join(out.select("a", "b", F.round("t", 5).alias("t")), ["a", "b"])


@case("k38_paired_t", "SELECT round(avg(purity - accuracy), 6) AS mean_diff, round(avg(purity - accuracy) / (stddev_samp(purity - accuracy) / sqrt(count(*))), 5) AS t, count(*) - 1 AS df FROM results")
def _(t):
    return rd(ex.paired_t(t.results, "purity", "accuracy")).withColumn("t", F.round("t", 5))


@case("k38_confidence_interval", "SELECT round(avg(accuracy), 6) AS mean, round(avg(accuracy) - 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS low, round(avg(accuracy) + 1.96 * stddev_samp(accuracy) / sqrt(count(*)), 6) AS high FROM results")
def _(t):
    return rd(ex.confidence_interval(t.results, "accuracy"))


@case("k40_best_by_each_metric", " UNION ALL ".join(f"(SELECT '{m}' AS metric, config_name, round({m}, 6) AS value FROM results ORDER BY results.{m} DESC, config_name LIMIT 1)" for m in ("purity", "ari", "nmi", "data_reduction_pct")))
def _(t):
    return rd(ex.best_by_each_metric(t.results, ["purity", "ari", "nmi", "data_reduction_pct"]))


@case("k41_parameter_effect", " UNION ALL ".join(f"SELECT '{p}' AS param, CAST({p} AS VARCHAR) AS level, round(avg(purity), 6) AS mean, round(stddev_samp(purity), 6) AS std, count(purity) AS n, round(avg(purity) - (SELECT avg(purity) FROM results), 6) AS effect FROM results GROUP BY {p}" for p in ("method", "perturbation_dim")))
def _(t):
    return rd(ex.parameter_effect(t.results, ["method", "perturbation_dim"]))


@case("k42_sweep_status", "SELECT count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed FROM results")
def _(t):
    return ex.sweep_status(t.results)


@case("k42_successes", "SELECT config_name FROM results WHERE error IS NULL")
def _(t):
    return ex.successes(t.results).select("config_name")


@case("k43_k_comparison_sizes", "WITH a AS (SELECT CAST(k AS INT) AS k, CAST(ck % k AS INT) AS cluster FROM grid, (SELECT unnest(range(3, 7)) AS k) q) SELECT k, cluster, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM grid), 6) AS pct FROM a GROUP BY k, cluster")
def _(t):
    a = t.grid.select("ck", F.explode(F.sequence(F.lit(3), F.lit(6))).alias("k")).select("k", (F.col("ck") % F.col("k")).cast("int").alias("cluster"))
    return rd(ex.k_comparison_sizes(a))


@case("k33_robustness_evaluate")
def _(t):
    from specband.plans.robustness import robustness_evaluate

    subsets = ex.robustness_sample(t.bands.select("band_id"), 5, 12)
    px = t.pixels.select("pixel_id", "spectrum", (F.col("label") % 4).alias("class"))
    return robustness_evaluate(px, subsets)


def _scan_truth(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(F.lit("s").alias("scan_id"), (k % 200).cast("int").alias("y"), F.floor(k / 200).cast("int").alias("x"),
                                  (F.col("o_custkey") % 5 - 1).cast("int").alias("class"))


CUT = "emission >= excitation + 40 AND (emission < 2 * excitation - 40 OR emission > 2 * excitation + 40)"


def _flagship(n):
    return f"""WITH k AS (SELECT * FROM cubes WHERE {CUT}), cc AS (SELECT k.excitation, k.em_idx, k.y, k.x, k.value * CASE WHEN e.exposure > 0 THEN
      (SELECT max(exposure) FROM exposure WHERE excitation IN (SELECT excitation FROM k)) / e.exposure ELSE 1 END AS value FROM k LEFT JOIN exposure e ON k.excitation = e.excitation),
    v AS (SELECT excitation, em_idx, var_pop(value) AS v FROM cc GROUP BY 1, 2 ORDER BY v DESC, excitation DESC, em_idx DESC LIMIT {n}),
    b AS (SELECT *, row_number() OVER (ORDER BY excitation, em_idx) - 1 AS b FROM v),
    tr AS (SELECT o_orderkey % 200 AS y, floor(o_orderkey / 200) AS x, CAST(o_custkey % 5 - 1 AS INT) AS class FROM orders),
    c10 AS (SELECT cc.y, cc.x, b.b, cc.value FROM cc JOIN b ON cc.excitation = b.excitation AND cc.em_idx = b.em_idx),
    pxs AS (SELECT DISTINCT y, x FROM c10), al AS (SELECT p.y, p.x, b.b, coalesce(c.value, 0) AS value FROM pxs p CROSS JOIN b LEFT JOIN c10 c ON c.y = p.y AND c.x = p.x AND c.b = b.b),
    px AS (SELECT al.y, al.x, tr.class, list(al.value ORDER BY al.b) AS s, al.y * 2147483648 + al.x AS id FROM al JOIN tr ON al.y = tr.y AND al.x = tr.x GROUP BY al.y, al.x, tr.class),
    tn AS (SELECT DISTINCT px.* FROM px JOIN rois AS r ON px.y >= r.y0 AND px.y < r.y1 AND px.x >= r.x0 AND px.x < r.x1 WHERE class >= 0),
    mo AS (SELECT i, avg(s[i]) AS m, CASE WHEN stddev_pop(s[i]) = 0 THEN 1 ELSE stddev_pop(s[i]) END AS d FROM tn, (SELECT unnest(range(1, {n} + 1)) AS i) q GROUP BY i),
    ml AS (SELECT list(m ORDER BY i) AS m, list(d ORDER BY i) AS d FROM mo),
    zp AS (SELECT id, class, list_transform(range(1, {n} + 1), lambda i: (s[i] - m[i]) / d[i]) AS z FROM px, ml), zt AS (SELECT id, class, list_transform(range(1, {n} + 1), lambda i: (s[i] - m[i]) / d[i]) AS z FROM tn, ml),
    ds AS (SELECT p.id, p.class, t.id AS tid, t.class AS tc, round(list_distance(p.z, t.z), 10) AS d FROM zp p, zt t WHERE p.class >= 0),
    nn AS (SELECT id, class, tc FROM ds QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, tid) <= 5),
    vo AS (SELECT id, class, tc, count(*) AS w FROM nn GROUP BY ALL), pr AS (SELECT id, class, tc AS cluster FROM vo QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, tc) = 1),
    ctt AS (SELECT class, cluster, count(*) AS n FROM pr GROUP BY ALL),
    pu AS (SELECT CAST(sum(m) AS DOUBLE) / sum(n) AS purity FROM (SELECT max(n) AS m, sum(n) AS n FROM ctt GROUP BY cluster) q)
    SELECT round(max(purity), 6) AS purity, round(CAST(sum(CASE WHEN class = cluster THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n_pixels, {n} AS n_bands FROM ctt, pu"""


@case("k39_flagship_selection", _flagship(10))
def _(t):
    from specband.plans.band_selection import select_and_score

    return rd(select_and_score(t.cubes, t.exposure, _scan_truth(t), t.rois, manifest=t.scan_bands))


@case("k39_config_sweep", f"""SELECT 'variance_3bands' AS config_name, a.*, CAST(NULL AS VARCHAR) AS error FROM ({_flagship(3)}) a
    UNION ALL SELECT 'variance_6bands', b.*, NULL FROM ({_flagship(6)}) b UNION ALL SELECT 'variance_broken', NULL, NULL, NULL, NULL, concat('KeyError: ', chr(39), 'k', chr(39))""")
def _(t):
    from specband.plans import band_selection as bs
    from workload.sources_queries import scratch

    cells = bs.calibrated_cells(t.cubes, t.exposure, manifest=t.scan_bands).persist()

    def run(cfg):
        return bs.classify_and_score(cells, bs.varied_bands(cells, cfg["n"]), cfg["n"], _scan_truth(t), t.rois, cfg["k"]).withColumn("n_bands", F.lit(cfg["n"]))

    configs = [{"name": "variance_3bands", "n": 3, "k": 5}, {"name": "variance_6bands", "n": 6, "k": 5}, {"name": "variance_broken", "n": 6}]
    out = ex.config_sweep_runner(t.spark, configs, run, scratch(t.spark))
    cells.unpersist()
    return rd(out)
