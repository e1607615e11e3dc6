"""Latent space and influence queries."""

from pyspark.sql import functions as F

from specband.operators import influence as inf, stats as st
from workload.compare_queries import rd
from workload.registry import case


@case("e01_dim_importance_variance", "SELECT dim_id, round(var_samp(value), 6) AS importance FROM latent GROUP BY dim_id")
def _(t):
    return rd(inf.dim_importance(t.latent, "variance"))


@case("e02_dim_importance_activation", "SELECT dim_id, round(avg(abs(value)), 6) AS importance FROM latent GROUP BY dim_id")
def _(t):
    return rd(inf.dim_importance(t.latent, "activation"))


@case("e03_dim_importance_pca")
def _(t):
    return inf.dim_importance_pca(t.pixels, 15)


@case("e04_dim_importance_ablation", "SELECT plan_id AS dim_id, round(sum(m), 8) AS importance FROM (SELECT plan_id, excitation, avg(pow(perturbed - baseline, 2)) AS m FROM recon GROUP BY 1, 2) q GROUP BY 1")
def _(t):
    return rd(inf.dim_importance_ablation(t.recon.withColumnRenamed("plan_id", "dim_id")), 8)


IMP = "im AS (SELECT dim_id, var_samp(value) AS importance FROM latent GROUP BY dim_id)"


@case("e05_top_dims", "WITH " + IMP + """, r AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, dim_id) AS INT) AS rank FROM im)
    SELECT rank, dim_id, round(importance, 6) AS importance, CAST(floor(dim_id / 32) AS INT) AS c, CAST(floor(dim_id / 16) % 2 AS INT) AS l, CAST(floor(dim_id / 4) % 4 AS INT) AS h, CAST(dim_id % 4 AS INT) AS w FROM r WHERE rank <= 15""")
def _(t):
    return rd(inf.top_dims(inf.dim_importance(t.latent), 15, (2, 2, 4, 4)))


STATS = "ls AS (SELECT dim_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, " + ", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in inf.STORED) + " FROM latent GROUP BY dim_id)"
SC = ["mean", "std", "min", "max"] + [f"p{p}" for p in inf.STORED]


@case("e06_latent_stats", "WITH " + STATS + " SELECT dim_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in SC) + " FROM ls")
def _(t):
    return rd(inf.latent_stats(t.latent))


PLAN = IMP + """, td AS (SELECT dim_id, importance FROM im ORDER BY importance DESC, dim_id LIMIT 15),
    pl AS (SELECT dim_id, importance, CAST(m AS DOUBLE) AS magnitude, s AS sign, CAST(0.5 AS DOUBLE) AS weight FROM td, (SELECT unnest([10, 20, 30]) AS m) a, (SELECT unnest([-1, 1]) AS s) b)"""
NEAR = "CASE " + " ".join(f"WHEN least({', '.join(f'abs({q} - tg)' for q in inf.STORED)}) = abs({p} - tg) THEN p{p}" for p in inf.STORED) + " END"
DELTA = {"percentile": f"(SELECT {NEAR} - mean FROM (SELECT 50 + sign * magnitude / 2 AS tg) z)", "standard_deviation": "sign * (magnitude / 100) * std", "absolute_range": "sign * (magnitude / 100) * (max - min)"}


def _plan(t):
    dims = inf.top_dims(inf.dim_importance(t.latent), 15).select("dim_id", "importance")
    return inf.perturbation_plan(dims)


for _i, _m in enumerate(DELTA):
    @case(f"e0{7 + _i}_delta_{_m}", "WITH " + PLAN + ", " + STATS + f" SELECT pl.dim_id, magnitude, sign, round({DELTA[_m]}, 6) AS delta FROM pl JOIN ls ON pl.dim_id = ls.dim_id")
    def _(t, m=_m):
        return rd(inf.perturbation_deltas(_plan(t), inf.latent_stats(t.latent), m).select("dim_id", "magnitude", "sign", "delta"))


@case("e10_perturbation_plan", "WITH " + PLAN + " SELECT dim_id, magnitude, sign, weight FROM pl")
def _(t):
    return _plan(t).select("dim_id", "magnitude", "sign", "weight")


@case("e11_band_influence", "SELECT plan_id, excitation, em_idx, round(avg(abs(perturbed - baseline)) * plan_id * 0.5, 8) AS influence FROM recon GROUP BY plan_id, excitation, em_idx")
def _(t):
    imp = t.recon.select("plan_id").distinct().withColumn("importance", F.col("plan_id") * 0.5)
    return rd(inf.band_influence(t.recon, imp), 8)


ACC = "(SELECT excitation, em_idx, sum(i * w) AS influence FROM (SELECT plan_id, excitation, em_idx, avg(abs(perturbed - baseline)) AS i, CASE WHEN plan_id % 2 = 0 THEN 0.5 ELSE 1 END AS w FROM recon GROUP BY plan_id, excitation, em_idx) q GROUP BY excitation, em_idx)"


def _acc(t):
    return inf.accumulate_influence(inf.band_influence(t.recon).withColumn("weight", F.when(F.col("plan_id") % 2 == 0, 0.5).otherwise(1.0)))


@case("e12_accumulate_influence", f"SELECT excitation, em_idx, round(influence, 8) AS influence FROM {ACC} a")
def _(t):
    return rd(_acc(t), 8)


@case("e13_gradient_influence", """WITH s AS (SELECT plan_id AS dim_id, stddev_samp(baseline) AS std, plan_id * 0.1 AS score FROM recon GROUP BY plan_id),
    g AS (SELECT plan_id, excitation, em_idx, avg(abs((perturbed - (2 * baseline - perturbed) * 0.9) / (2 * 0.1 * (std + 1e-8)))) * score AS m FROM recon JOIN s ON s.dim_id = plan_id GROUP BY plan_id, excitation, em_idx, score)
    SELECT excitation, em_idx, round(sum(m), 6) AS influence FROM g GROUP BY excitation, em_idx""")
def _(t):
    stats = t.recon.groupBy(F.col("plan_id").alias("dim_id")).agg(F.stddev_samp("baseline").alias("std")).withColumn("score", F.col("dim_id") * 0.1)
    pairs = t.recon.select(F.col("plan_id").alias("dim_id"), "excitation", "em_idx", F.col("perturbed").alias("plus"), ((2 * F.col("baseline") - F.col("perturbed")) * 0.9).alias("minus"))
    return rd(inf.gradient_influence(pairs, stats))


@case("e14_normalize_influence_variance", f"""WITH v AS (SELECT excitation, em_idx, var_pop(baseline) AS variance FROM recon GROUP BY 1, 2)
    SELECT a.excitation, a.em_idx, round(influence / CASE WHEN variance = 0 THEN 1 ELSE variance END, 6) AS influence FROM {ACC} a JOIN v ON a.excitation = v.excitation AND a.em_idx = v.em_idx""")
def _(t):
    var = st.band_variance(t.recon.withColumn("value", F.col("baseline")))
    return rd(inf.normalize_influence(_acc(t), "variance", var))


@case("e14_normalize_influence_max", f"SELECT excitation, em_idx, round(influence / max(influence) OVER (PARTITION BY excitation), 6) AS influence FROM {ACC} a")
def _(t):
    return rd(inf.normalize_influence(_acc(t), "max_per_excitation"))


@case("e15_linear_latent")
def _(t):
    m = inf.linear_latent(t.pixels, 8)
    return m.encode(t.pixels).select("pixel_id", F.posexplode("scores").alias("dim_id", "score"))


@case("e15_linear_latent_full_rank", "SELECT pixel_id, CAST(bi AS INT) AS band_id, round(value, 6) AS value FROM (SELECT pixel_id, unnest(spectrum) AS value, unnest(range(len(spectrum))) AS bi FROM pixels) q")
def _(t):
    m = inf.linear_latent(t.pixels, 64)
    back = m.decode(m.encode(t.pixels.select("pixel_id", "spectrum")))
    return rd(back.select("pixel_id", F.posexplode("reconstruction").alias("band_id", "value")))


@case("e15_linear_influence")
def _(t):
    m = inf.linear_latent(t.pixels, 8)
    lat = m.encode(t.pixels).select(F.col("pixel_id").alias("sample_id"), F.posexplode("scores").alias("dim_id", "value"))
    dims = inf.top_dims(inf.dim_importance(lat), 5).select("dim_id", "importance")
    deltas = inf.perturbation_deltas(inf.perturbation_plan(dims), inf.latent_stats(lat), "standard_deviation")
    return inf.linear_influence(deltas, m.loadings(t.spark))


@case("e16_reconstruction_error", """WITH e AS (SELECT excitation, avg(pow(perturbed - baseline, 2)) AS mse, avg(abs(perturbed - baseline)) AS mae, count(*) AS n FROM recon WHERE valid GROUP BY excitation),
    u AS (SELECT * FROM e UNION ALL SELECT NULL, avg(mse), avg(mae), CAST(sum(n) AS BIGINT) FROM e)
    SELECT excitation, round(mse, 9) AS mse, round(mae, 9) AS mae, n, round(10 * log10(1 / mse), 9) AS psnr FROM u""")
def _(t):
    return rd(inf.reconstruction_error(t.recon), 9)


@case("e17_error_map", "SELECT sample_id, round(sqrt(avg(pow(perturbed - baseline, 2))), 8) AS rmse FROM recon GROUP BY sample_id")
def _(t):
    return rd(inf.error_map(t.recon, ["sample_id"]), 8)


SSIM = "((2 * avg(baseline) * avg(perturbed) + 0.0001) * (2 * covar_pop(baseline, perturbed) + 0.0009)) / ((avg(baseline) * avg(baseline) + avg(perturbed) * avg(perturbed) + 0.0001) * (var_pop(baseline) + var_pop(perturbed) + 0.0009))"


@case("e18_global_ssim", f"SELECT round({SSIM}, 8) AS ssim FROM recon")
def _(t):
    return rd(inf.global_ssim(t.recon), 8)


@case("e19_quality_by_method", f"SELECT plan_id, round(20 * log10(max(baseline) / (sqrt(avg(pow(perturbed - baseline, 2))) + 1e-10)), 6) AS psnr, round({SSIM}, 6) AS ssim, round(avg(abs(perturbed - baseline)), 6) AS mae, round(corr(baseline, perturbed), 6) AS r FROM recon GROUP BY plan_id")
def _(t):
    return rd(inf.quality_by_method(t.recon, "plan_id"))


@case("e20_impact_by_perturbation", "SELECT plan_id, round(avg(abs(perturbed - baseline)), 8) AS mae, round(sqrt(avg(pow(perturbed - baseline, 2))), 8) AS rmse, round(max(abs(perturbed - baseline)), 8) AS max_error, round(corr(baseline, perturbed), 8) AS r FROM recon GROUP BY plan_id")
def _(t):
    return rd(inf.impact_by_perturbation(t.recon, "plan_id"), 8)


@case("e21_importance_profile", """SELECT band_id, round(avg(value), 6) AS importance, round((SELECT avg(value) FROM longpix), 6) AS overall_mean, round((SELECT median(value) FROM longpix), 6) AS overall_median
    FROM (SELECT CAST(band_id AS INT) AS band_id, value FROM longpix) q GROUP BY band_id ORDER BY avg(value) DESC, band_id LIMIT 20""")
def _(t):
    return rd(inf.importance_profile(t.longpix, 20))


@case("e22_sparsity_kl", """WITH h AS (SELECT dim_id, avg(1 / (1 + exp(-value))) AS h FROM latent GROUP BY dim_id)
    SELECT round(sum(0.05 * ln((0.05 + 1e-8) / (h + 1e-8)) + 0.95 * ln((0.95 + 1e-8) / (1 - h + 1e-8))), 6) AS sparsity FROM h""")
def _(t):
    return rd(inf.sparsity_kl(t.latent.withColumn("value", 1 / (1 + F.exp(-F.col("value"))))))
