"""Normalization and band statistics queries."""

from pyspark.sql import functions as F

from specband.operators import stats as st
from workload.registry import case


def r(c, n=6):
    return F.round(c, n).alias(c)


CELL = ["excitation", "em_idx", "y", "x"]
HEAD = "SELECT excitation, em_idx, y, x, "
LIM = "(SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd FROM cells)"


@case("d01_normalize_global_minmax", HEAD + f"round((value - lo) / (hi - lo), 7) AS value FROM cells, {LIM} q")
def _(t):
    return st.normalize_global_minmax(t.cells).select(*CELL, r("value", 7))


@case("d02_normalize_global_percentile", HEAD + """round(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, (value - lo) / (hi - lo + 1e-10))) END, 7) AS value FROM cells,
    (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM cells WHERE value > 0) q""")
def _(t):
    return st.normalize_global_percentile(t.cells).select(*CELL, r("value", 7))


@case("d02_normalize_percentile_by_excitation", HEAD.replace("excitation,", "c.excitation,") + """round(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, (value - lo) / (hi - lo + 1e-10))) END, 7) AS value FROM cells c JOIN
    (SELECT excitation AS e, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM cells WHERE value > 0 GROUP BY 1) q ON c.excitation = q.e""")
def _(t):
    return st.normalize_global_percentile(t.cells, by=["excitation"]).select(*CELL, r("value", 7))


@case("d03_normalize_minmax", HEAD + f"round((value - lo) / (hi - lo + 1e-10), 7) AS value FROM cells, {LIM} q")
def _(t):
    return st.normalize_minmax(t.cells).select(*CELL, r("value", 7))


@case("d04_normalize_standard", HEAD + f"round((value - m) / (sd + 1e-10), 7) AS value FROM cells, {LIM} q")
def _(t):
    return st.normalize_standard(t.cells).select(*CELL, r("value", 7))


@case("d05_standardize_bands", """SELECT excitation, em_idx, y, x, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 7) AS value
    FROM cells WINDOW w AS (PARTITION BY excitation, em_idx)""")
def _(t):
    return st.standardize_bands(t.cells).select(*CELL, r("value", 7))


@case("d05_standardize_spectra", """SELECT pixel_id, CAST(band_id AS INT) AS band_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 7) AS value
    FROM longpix WINDOW w AS (PARTITION BY band_id)""")
def _(t):
    return st.standardize_spectra(t.pixels).select("pixel_id", F.posexplode("spectrum").alias("band_id", "value")).withColumn("value", F.round("value", 7))


@case("d06_snv", """SELECT pixel_id, CAST(band_id AS INT) AS band_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 7) AS value
    FROM longpix WINDOW w AS (PARTITION BY pixel_id)""")
def _(t):
    d = t.pixels.withColumn("spectrum", st.snv(F.col("spectrum")))
    return d.select("pixel_id", F.posexplode("spectrum").alias("band_id", "value")).withColumn("value", F.round("value", 7))


@case("d07_l2_normalize_band", """SELECT excitation, em_idx, y, x, round(value / sqrt(sum(value * value) OVER (PARTITION BY excitation, em_idx)), 7) AS value FROM cells""")
def _(t):
    return st.l2_normalize_band(t.cells).select(*CELL, r("value", 7))


@case("d08_mean_spectrum", "SELECT excitation, em_idx, round(avg(value), 6) AS mean FROM cells WHERE y >= 20 AND y < 150 AND x >= 2 AND x < 60 GROUP BY excitation, em_idx")
def _(t):
    return st.mean_spectrum(t.cells, region=(20, 150, 2, 60)).select("excitation", "em_idx", r("mean"))


@case("d09_band_variance", "SELECT excitation, em_idx, round(var_pop(value), 5) AS variance FROM cells GROUP BY excitation, em_idx")
def _(t):
    return st.band_variance(t.cells).select("excitation", "em_idx", r("variance", 5))


@case("d10_band_correlation", """SELECT a.band_id AS band_a, b.band_id AS band_b, round(corr(a.value, b.value), 6) AS corr
    FROM longpix a JOIN longpix b ON a.pixel_id = b.pixel_id GROUP BY a.band_id, b.band_id""")
def _(t):
    return st.band_correlation(t.pixels).withColumn("corr", F.round("corr", 6))


@case("d11_band_cosine", """SELECT a.band_id AS band_a, b.band_id AS band_b, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) AS cosine
    FROM longpix a JOIN longpix b ON a.pixel_id = b.pixel_id GROUP BY a.band_id, b.band_id""")
def _(t):
    return st.band_cosine(t.pixels).withColumn("cosine", F.round("cosine", 6))


@case("d12_band_cv_high_variability", """WITH c AS (SELECT excitation, em_idx, stddev_pop(value) / (avg(value) + 1e-10) * 100 AS cv FROM cells GROUP BY excitation, em_idx)
    SELECT excitation, em_idx, round(cv, 6) AS cv, cv > (SELECT quantile_cont(cv, 0.75) FROM c) AS high FROM c""")
def _(t):
    return st.band_cv_high_variability(t.cells).withColumn("cv", F.round("cv", 6))


@case("d13_outlier_rate", """SELECT round(avg(CASE WHEN abs(z) > 1.7 THEN 1.0 ELSE 0.0 END), 8) AS outlier_rate FROM (SELECT (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
    FROM cubes WINDOW w AS (PARTITION BY excitation, em_idx)) q""")
def _(t):
    return st.outlier_rate(t.cubes, 1.7).withColumn("outlier_rate", F.round("outlier_rate", 8))


@case("d14_distribution_summary", f"""WITH m AS {LIM} SELECT round(max(m), 6) AS mean, round(max(sd), 6) AS std, round(avg(pow((value - m) / sd, 3)), 6) AS skew,
    round(avg(pow((value - m) / sd, 4)) - 3, 6) AS kurtosis, round(median(value), 6) AS median FROM cells, m""")
def _(t):
    d = st.distribution_summary(t.cells)
    return d.select(*[r(c) for c in ("mean", "std", "skew", "kurtosis", "median")])


@case("d15_ecdf", "SELECT value, event_id, round(CAST(row_number() OVER (ORDER BY value, event_id) AS DOUBLE) / count(*) OVER (), 8) AS ecdf FROM events")
def _(t):
    return st.ecdf(t.raw("events"), "value", ["event_id"]).withColumn("ecdf", F.round("ecdf", 8))


@case("d16_histogram", """SELECT CAST(least(floor((value - lo) / (hi - lo) * 40), 39) AS INT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) q GROUP BY 1""")
def _(t):
    return st.histogram(t.raw("events"), "value", 40)
