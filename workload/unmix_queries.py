"""Factorization queries."""

from pyspark.sql import functions as F

from specband.operators import select as sel, unmix as um
from workload.compare_queries import rd
from workload.registry import case


def positive(t):
    return t.pixels.withColumn("spectrum", F.transform("spectrum", lambda v: F.abs(v)))


@case("m01_unfold_fold", "SELECT y, x, CAST((excitation - 320) / 20 * 31 + em_idx AS INT) AS component, round(value, 6) AS value FROM cubes WHERE value <> 0")
def _(t):
    u = um.unfold(t.cubes, t.influence.select("excitation", "em_idx", "band_id"), 217)
    return rd(um.fold(u, "spectrum").where("value <> 0").drop("scan_id"))


@case("m02_mcr_clean_zero", "SELECT excitation, em_idx, y, x, round(coalesce(value, 0), 6) AS value FROM cells")
def _(t):
    return rd(um.mcr_clean(t.cells).select("excitation", "em_idx", "y", "x", "value"))


@case("m02_mcr_clean_median", "WITH m AS (SELECT excitation, em_idx, median(value) AS m FROM cells GROUP BY 1, 2) SELECT c.excitation, c.em_idx, y, x, round(coalesce(value, m), 6) AS value FROM cells c JOIN m ON c.excitation = m.excitation AND c.em_idx = m.em_idx")
def _(t):
    return rd(um.mcr_clean(t.cells, "median").select("excitation", "em_idx", "y", "x", "value"))


@case("m03_mcr_init")
def _(t):
    rows = [(m, c, b, float(v)) for m in ("pca", "svd", "random", "nmf", "farthest") for c, row in enumerate(um.mcr_init(positive(t), 3, m)) for b, v in enumerate(row)]
    return t.spark.createDataFrame(rows, "method STRING, component INT, band_id INT, value DOUBLE")


for _id, _method in (("m04_als_step_clip", "clip"), ("m05_als_step_ridge", "ridge"), ("m06_als_step_nnls", "nnls")):
    @case(_id)
    def _(t, method=_method):
        px = positive(t)
        s, fit = um.als_step(px, um.mcr_init(px, 3, "farthest"), method)
        return um.Mcr(s, fit["mse"], fit["explained_variance"]).profile_table(t.spark)


def _pair(method, a, b, c, h1, h2):
    """Closed form of the two-component least squares in SQL: G = ((a, b), (b, c)), H = (h1, h2)."""
    if method == "ridge":
        a, c = f"({a} + 1e-6)", f"({c} + 1e-6)"
    x1, x2 = f"(({c} * {h1} - {b} * {h2}) / ({a} * {c} - {b} * {b}))", f"(({a} * {h2} - {b} * {h1}) / ({a} * {c} - {b} * {b}))"
    if method != "nnls":
        return f"greatest(0, {x1})", f"greatest(0, {x2})"
    inside = f"{x1} >= 0 AND {x2} >= 0"
    first = f"pow(greatest(0, {h1}), 2) / {a} >= pow(greatest(0, {h2}), 2) / {c}"  # on the edge, the component that explains more
    return (f"CASE WHEN {inside} THEN {x1} WHEN {first} THEN greatest(0, {h1}) / {a} ELSE 0 END", f"CASE WHEN {inside} THEN {x2} WHEN {first} THEN 0 ELSE greatest(0, {h2}) / {c} END")


def _two(method):
    """One alternation with two components in SQL: the longest spectrum and the one farthest from its line, concentrations, new profiles."""
    c1, c2 = _pair(method, "a", "b", "c", "h1", "h2")
    n1, n2 = _pair(method, "ga", "gb", "gc", "x1", "x2")
    return f"""WITH px AS (SELECT pixel_id, band_id, abs(value) AS v FROM longpix), sq AS (SELECT pixel_id, sum(v * v) AS n FROM px GROUP BY pixel_id),
    s1 AS (SELECT band_id, v FROM px WHERE pixel_id = (SELECT pixel_id FROM sq ORDER BY n DESC LIMIT 1)),
    d1 AS (SELECT px.pixel_id, sum(px.v * s1.v) AS h1 FROM px JOIN s1 ON s1.band_id = px.band_id GROUP BY px.pixel_id),
    far AS (SELECT d1.pixel_id FROM d1 JOIN sq ON sq.pixel_id = d1.pixel_id ORDER BY n - h1 * h1 / (SELECT sum(v * v) FROM s1) DESC LIMIT 1),
    s2 AS (SELECT band_id, v FROM px WHERE pixel_id = (SELECT pixel_id FROM far)),
    g AS (SELECT sum(s1.v * s1.v) AS a, sum(s1.v * s2.v) AS b, sum(s2.v * s2.v) AS c FROM s1 JOIN s2 ON s1.band_id = s2.band_id),
    d2 AS (SELECT px.pixel_id, sum(px.v * s2.v) AS h2 FROM px JOIN s2 ON s2.band_id = px.band_id GROUP BY px.pixel_id),
    cc AS (SELECT d1.pixel_id, {c1} AS c1, {c2} AS c2 FROM d1 JOIN d2 ON d1.pixel_id = d2.pixel_id, g),
    gg AS (SELECT sum(c1 * c1) AS ga, sum(c1 * c2) AS gb, sum(c2 * c2) AS gc FROM cc),
    cx AS (SELECT band_id, sum(c1 * v) AS x1, sum(c2 * v) AS x2 FROM px JOIN cc ON cc.pixel_id = px.pixel_id GROUP BY band_id),
    ns AS (SELECT band_id, {n1} AS n1, {n2} AS n2 FROM cx, gg), nn AS (SELECT sqrt(sum(n1 * n1)) AS m1, sqrt(sum(n2 * n2)) AS m2 FROM ns)
    SELECT CAST(0 AS INT) AS component, CAST(band_id AS INT) AS band_id, round(n1 / m1, 6) AS value FROM ns, nn UNION ALL SELECT 1, CAST(band_id AS INT), round(n2 / m2, 6) FROM ns, nn"""


for _id, _method in (("m04_als_step_clip_two", "clip"), ("m05_als_step_ridge_two", "ridge"), ("m06_als_step_nnls_two", "nnls")):
    @case(_id, _two(_method))
    def _(t, method=_method):
        px = positive(t)
        s, fit = um.als_step(px, um.mcr_init(px, 2, "farthest"), method)
        return rd(um.Mcr(s, fit["mse"], fit["explained_variance"]).profile_table(t.spark))


def _rounds(method, n):
    """``n`` alternations with two components in SQL, one block of tables per round, then the concentrations on the last profiles."""
    c1, c2 = _pair(method, "a", "b", "c", "h1", "h2")
    n1, n2 = _pair(method, "ga", "gb", "gc", "x1", "x2")
    start = _two(method).split("g AS (")[0].rstrip().rstrip(",")
    text = start + ", t0 AS (SELECT s1.band_id, s1.v AS v1, s2.v AS v2 FROM s1 JOIN s2 ON s1.band_id = s2.band_id)"
    for r in range(n + 1):
        text += f""", g{r} AS (SELECT sum(v1 * v1) AS a, sum(v1 * v2) AS b, sum(v2 * v2) AS c FROM t{r}),
    k{r} AS (SELECT px.pixel_id, sum(px.v * v1) AS h1, sum(px.v * v2) AS h2 FROM px JOIN t{r} ON t{r}.band_id = px.band_id GROUP BY px.pixel_id),
    c{r} AS (SELECT pixel_id, {c1} AS c1, {c2} AS c2 FROM k{r}, g{r})"""
        if r < n:
            text += f""", gg{r} AS (SELECT sum(c1 * c1) AS ga, sum(c1 * c2) AS gb, sum(c2 * c2) AS gc FROM c{r}),
    cx{r} AS (SELECT band_id, sum(c1 * v) AS x1, sum(c2 * v) AS x2 FROM px JOIN c{r} ON c{r}.pixel_id = px.pixel_id GROUP BY band_id),
    n{r} AS (SELECT band_id, {n1} AS n1, {n2} AS n2 FROM cx{r}, gg{r}),
    t{r + 1} AS (SELECT band_id, n1 / (SELECT sqrt(sum(n1 * n1)) FROM n{r}) AS v1, n2 / (SELECT sqrt(sum(n2 * n2)) FROM n{r}) AS v2 FROM n{r})"""
    return text + f""" SELECT c.pixel_id, i AS component, round(CASE WHEN i = 0 THEN c1 ELSE c2 END, 5) AS value FROM c{n} c, (SELECT CAST(unnest([0, 1]) AS INT) AS i) q"""


for _id, _method in (("m07_fit_mcr_two_clip", "clip"), ("m07_fit_mcr_two_nnls", "nnls")):  # the fit alone, round by round; m07_fit_mcr runs to its end
    @case(_id, _rounds(_method, 3))
    def _(t, method=_method):
        px = positive(t)
        fit = um.fit_mcr(px, 2, max_iter=3, tol=0.0, init="farthest", method=method, normalize=True)
        return fit.concentrations(px).select("pixel_id", F.posexplode("concentration").alias("component", "value")).withColumn("value", F.round("value", 5))


M3 = """WITH px AS (SELECT pixel_id, band_id, abs(value) AS v FROM longpix), sq AS (SELECT pixel_id, sum(v * v) AS n FROM px GROUP BY pixel_id),
    s1 AS (SELECT band_id, v FROM px WHERE pixel_id = (SELECT pixel_id FROM sq ORDER BY n DESC LIMIT 1)),
    d1 AS (SELECT px.pixel_id, sum(px.v * s1.v) AS h1 FROM px JOIN s1 ON s1.band_id = px.band_id GROUP BY px.pixel_id),
    far AS (SELECT d1.pixel_id FROM d1 JOIN sq ON sq.pixel_id = d1.pixel_id ORDER BY n - h1 * h1 / (SELECT sum(v * v) FROM s1) DESC LIMIT 1)
    SELECT CAST(0 AS INT) AS component, CAST(band_id AS INT) AS band_id, round(v, 6) AS value FROM s1
    UNION ALL SELECT 1, CAST(band_id AS INT), round(v, 6) FROM px WHERE pixel_id = (SELECT pixel_id FROM far)"""


@case("m03_mcr_init_farthest", M3)
def _(t):
    return rd(um.Mcr(um.mcr_init(positive(t), 2, "farthest"), 0.0, 0.0).profile_table(t.spark))


@case("m07_fit_mcr")
def _(t):
    px = positive(t)
    return um.fold(um.fit_mcr(px, 3, init="farthest").concentrations(px))


@case("m07_fit_mcr_patience")
def _(t):
    return um.profile_blocks(um.fit_mcr(positive(t), 2, method="nnls", patience=2), t.bands)


@case("m08_mcr_metrics", "SELECT round(avg(pow(baseline - perturbed, 2)), 8) AS mse, round(1 - var_pop(baseline - perturbed) / var_pop(baseline), 8) AS explained_variance FROM recon")
def _(t):
    return rd(um.mcr_metrics(t.recon), 8)


@case("m09_component_stats", "SELECT dim_id AS component, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max FROM latent GROUP BY dim_id")
def _(t):
    return rd(um.component_stats(t.latent.withColumnRenamed("dim_id", "component")))


SC = """WITH c AS (SELECT sample_id, dim_id AS component, abs(value) AS value FROM latent), m AS (SELECT component, max(value) AS m FROM c GROUP BY component)"""


def _cs(t):
    c = t.latent.select("sample_id", F.col("dim_id").alias("component"), F.abs("value").alias("value"))
    s = t.influence.select((F.col("band_id") % 64).cast("int").alias("component"), F.floor(F.col("band_id") / 64).cast("int").alias("em_idx"), F.col("influence").alias("value"))
    return um.scale_components(c, s)


PROFILES = ", s AS (SELECT CAST(band_id % 64 AS INT) AS component, CAST(floor(band_id / 64) AS INT) AS em_idx, influence AS value FROM influence)"


@case("m10_scale_components_c", SC + PROFILES + """ SELECT sample_id, c.component, round(CASE WHEN c.component IN (SELECT component FROM s) THEN value / m ELSE value END, 6) AS value
    FROM c JOIN m ON c.component = m.component""")
def _(t):
    return rd(_cs(t)[0])


@case("m10_scale_components_s", SC + PROFILES + " SELECT s.component, em_idx, round(value * m, 6) AS value FROM s JOIN m ON s.component = m.component")
def _(t):
    return rd(_cs(t)[1])


@case("m11_mcr_over_combinations")
def _(t):
    return um.mcr_over_combinations(positive(t), t.bands, sel.excitation_combinations(t.bands), 2, init="svd")


M12 = "WITH s AS (SELECT config_name AS name, perturbation_dim AS n_excitations, accuracy AS explained_variance FROM results)"


@case("m12_best_combinations_report", M12 + """ (SELECT 'top' AS kind, n_excitations, name, round(explained_variance, 6) AS explained_variance FROM s ORDER BY s.explained_variance DESC, name LIMIT 5)
    UNION ALL SELECT 'best_of_count', n_excitations, name, round(explained_variance, 6) FROM (SELECT *, row_number() OVER (PARTITION BY n_excitations ORDER BY explained_variance DESC, name) AS rn FROM s) q WHERE rn = 1""")
def _(t):
    return rd(um.best_combinations_report(t.results.select(F.col("config_name").alias("name"), F.col("perturbation_dim").alias("n_excitations"), F.col("accuracy").alias("explained_variance"))))


@case("m12_performance_by_count", M12 + " SELECT n_excitations, round(avg(explained_variance), 6) AS mean, round(stddev_pop(explained_variance), 6) AS std, count(*) AS n FROM s GROUP BY n_excitations")
def _(t):
    return rd(um.performance_by_count(t.results.select(F.col("perturbation_dim").alias("n_excitations"), F.col("accuracy").alias("explained_variance"))))


@case("m13_nmf")
def _(t):
    return um.nmf(t.pixels, 3).profile_table(t.spark)


@case("m13_fast_ica")
def _(t):
    mean, unmixing, _ = um.fast_ica(t.pixels, 3)
    return um.ica_sources(t.pixels.select("pixel_id", "spectrum"), mean, unmixing).select("pixel_id", F.posexplode("sources").alias("component", "value"))
