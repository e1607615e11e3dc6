"""Selection queries."""

from pyspark.sql import functions as F

from specband.operators import select as sel
from workload.compare_queries import rd
from workload.registry import case
from workload.sources_queries import RANKED

WK = "k AS (" + RANKED + ")"


def ranked(t):
    return sel.rank_bands(t.influence)


def px_influence(t):
    return t.longpix.groupBy("band_id").agg(F.avg(F.abs("value")).alias("influence"))


@case("f01_rank_bands", "WITH " + WK + " SELECT rank, excitation, em_idx, influence FROM k")
def _(t):
    return ranked(t).select("rank", "excitation", "em_idx", "influence")


@case("f02_top_n", "WITH " + WK + " SELECT rank, excitation, em_idx FROM k WHERE rank <= 30")
def _(t):
    return sel.top_n(ranked(t), 30).select("rank", "excitation", "em_idx")


@case("f03_select_mmr_two", """WITH i AS (SELECT band_id, avg(abs(value)) AS v FROM longpix GROUP BY band_id), f AS (SELECT band_id, v FROM i ORDER BY v DESC, band_id LIMIT 1),
    c AS (SELECT a.band_id, abs(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))) AS c FROM longpix a JOIN longpix b ON a.pixel_id = b.pixel_id JOIN f ON b.band_id = f.band_id GROUP BY a.band_id),
    s AS (SELECT i.band_id FROM i JOIN c ON i.band_id = c.band_id, f WHERE i.band_id <> f.band_id ORDER BY i.v / f.v - 0.5 * c.c DESC, i.v DESC, i.band_id LIMIT 1)
    SELECT 1 AS rank, CAST(band_id AS INT) AS band_id FROM f UNION ALL SELECT 2, CAST(band_id AS INT) FROM s""")
def _(t):
    return sel.select_mmr(t.pixels, px_influence(t), 2).select("rank", "band_id")


@case("f03_select_mmr_ten", """WITH i AS (SELECT band_id, avg(abs(value)) AS v FROM longpix GROUP BY band_id), m AS (SELECT max(v) AS m FROM i),
    g AS (SELECT a.band_id AS a, b.band_id AS b, sum(a.value * b.value) AS g FROM longpix a JOIN longpix b ON a.pixel_id = b.pixel_id GROUP BY 1, 2),
    c AS (SELECT g.a, g.b, abs(g.g / sqrt(x.g * y.g)) AS c FROM g JOIN g x ON x.a = g.a AND x.b = g.a JOIN g y ON y.a = g.b AND y.b = g.b),
    st AS (SELECT 1 AS step, (SELECT band_id FROM i ORDER BY v DESC, band_id LIMIT 1) AS pick, [(SELECT band_id FROM i ORDER BY v DESC, band_id LIMIT 1)] AS s
      UNION ALL SELECT step + 1, nxt, list_append(s, nxt) FROM (SELECT st.step, st.s, arg_max(i.band_id, i.v / m.m - 0.5 * q.sim) AS nxt FROM st, i, m,
        (SELECT c.a, st2.step, max(c.c) AS sim FROM c, st st2 WHERE list_contains(st2.s, c.b) GROUP BY 1, 2) q
        WHERE q.a = i.band_id AND q.step = st.step AND NOT list_contains(st.s, i.band_id) AND st.step < 10 GROUP BY st.step, st.s) z)
    SELECT CAST(step AS INT) AS rank, CAST(pick AS INT) AS band_id FROM st""")
def _(t):
    return sel.select_mmr(t.pixels, px_influence(t), 10).select("rank", "band_id")


@case("f04_select_min_distance", "WITH " + WK + """, w AS (SELECT *, row_number() OVER (PARTITION BY excitation ORDER BY rank) AS rn FROM k),
    rc AS (SELECT excitation, rn, rank, em_idx, [emission] AS taken, true AS keep FROM w WHERE rn = 1
      UNION ALL SELECT w.excitation, w.rn, w.rank, w.em_idx, CASE WHEN len(list_filter(rc.taken, lambda s: abs(s - w.emission) < 25)) = 0 THEN list_append(rc.taken, w.emission) ELSE rc.taken END,
        len(list_filter(rc.taken, lambda s: abs(s - w.emission) < 25)) = 0 FROM rc JOIN w ON w.excitation = rc.excitation AND w.rn = rc.rn + 1)
    SELECT excitation, em_idx, rank, CAST(row_number() OVER (ORDER BY rank) AS INT) AS position FROM rc WHERE keep ORDER BY rank LIMIT 40""")
def _(t):
    return sel.select_min_distance(ranked(t), 25.0, 40).select("excitation", "em_idx", "rank", "position")


@case("f05_select_pca_loadings_seq")
def _(t):
    return sel.select_pca_loadings_seq(t.pixels, 10)


@case("f06_select_pca_loadings_top5")
def _(t):
    return sel.select_pca_loadings_top5(t.pixels, 10)


@case("f07_select_variance", "SELECT CAST(band_id AS INT) AS band_id, round(variance, 6) AS variance FROM (SELECT band_id, var_pop(value) AS variance FROM longpix GROUP BY band_id ORDER BY 2 DESC LIMIT 10) q")
def _(t):
    return rd(sel.select_variance(t.longpix, 10))


@case("f08_select_greedy_diversity", """WITH v AS (SELECT band_id, var_pop(value) AS v FROM longpix GROUP BY band_id), n AS (SELECT band_id, v, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-8) AS r FROM v),
    f AS (SELECT band_id FROM v ORDER BY v DESC, band_id LIMIT 1),
    c AS (SELECT a.band_id AS a, b.band_id AS b, abs(corr(a.value, b.value)) AS c FROM longpix a JOIN longpix b ON a.pixel_id = b.pixel_id GROUP BY 1, 2),
    s AS (SELECT n.band_id FROM n JOIN c ON c.a = n.band_id JOIN f ON c.b = f.band_id WHERE n.band_id <> f.band_id ORDER BY 0.5 * r + 0.5 * (1 - c.c) DESC, n.band_id LIMIT 1),
    g AS (SELECT band_id FROM f UNION ALL SELECT band_id FROM s),
    h AS (SELECT n.band_id, any_value(r) AS r, avg(c.c) AS c FROM n JOIN c ON c.a = n.band_id JOIN g ON c.b = g.band_id WHERE n.band_id NOT IN (SELECT band_id FROM g) GROUP BY n.band_id),
    z AS (SELECT band_id FROM g UNION ALL (SELECT band_id FROM h ORDER BY 0.5 * r + 0.5 * (1 - c) DESC, band_id LIMIT 1))
    SELECT CAST(row_number() OVER (ORDER BY band_id) AS INT) AS position, CAST(band_id AS INT) AS band_id FROM z""")
def _(t):
    return sel.select_greedy_diversity(t.pixels, 3)


@case("f09_dedupe_pairs", "SELECT excitation, emission, min(ord) AS ord, min_by(config, ord) AS config FROM picks GROUP BY excitation, emission")
def _(t):
    return sel.dedupe_pairs(t.picks)


@case("f10_selection_stats", "WITH " + WK + """ SELECT (SELECT count(*) FROM k) AS n_available, count(*) AS n_selected, round(CAST((SELECT count(*) FROM k) AS DOUBLE) / count(*), 6) AS compression_ratio,
    round((1 - CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM k)) * 100, 6) AS reduction_pct, max(influence) AS max_influence, min(influence) AS min_influence FROM k WHERE rank <= 30""")
def _(t):
    return rd(sel.selection_stats(t.influence, sel.top_n(ranked(t), 30)))


@case("f10_bands_per_excitation", "WITH " + WK + " SELECT excitation, count(*) AS n FROM k WHERE rank <= 30 GROUP BY excitation")
def _(t):
    return sel.bands_per_excitation(sel.top_n(ranked(t), 30))


@case("f11_excluded_bands", "WITH " + WK + " SELECT band_id, rank FROM k WHERE rank > 30")
def _(t):
    return sel.excluded_bands(ranked(t), sel.top_n(ranked(t), 30)).select("band_id", "rank")


@case("f12_ranking_export", "WITH " + WK + " SELECT rank, rank - 1 AS layer_index, excitation AS excitation_nm, emission AS emission_nm, influence AS coefficient, concat('Ex', excitation, '_Em', emission) AS layer_name FROM k")
def _(t):
    return sel.ranking_export(ranked(t))


@case("f13_format_combinations", """WITH d AS (SELECT DISTINCT config, excitation, emission FROM picks),
    e AS (SELECT config, excitation, concat('Ex', CAST(excitation AS INT), 'nm: [', string_agg(printf('%.1f', emission), ', ' ORDER BY emission), ']nm') AS s FROM d GROUP BY config, excitation)
    SELECT config, string_agg(s, ' | ' ORDER BY excitation) AS combinations FROM e GROUP BY config""")
def _(t):
    return sel.format_combinations(t.picks, ["config"])


@case("f14_config_grid", """WITH m AS (SELECT DISTINCT method FROM results), d AS (SELECT DISTINCT perturbation_dim FROM results), l AS (SELECT unnest([0.3, 0.5, 0.7]) AS lam),
    g AS (SELECT row_number() OVER (ORDER BY method, perturbation_dim, lam) - 1 AS id, method, perturbation_dim, CAST(lam AS DOUBLE) AS lam FROM m, d, l ORDER BY 1 LIMIT 50)
    SELECT g.id, g.method, g.perturbation_dim, g.lam, count(r.config_name) AS n FROM g LEFT JOIN results r ON r.method = g.method AND r.perturbation_dim = g.perturbation_dim GROUP BY ALL""")
def _(t):
    col = lambda c: sorted(r[0] for r in t.results.select(c).distinct().collect())
    g = sel.config_grid(t.spark, {"method": col("method"), "perturbation_dim": col("perturbation_dim"), "lam": [0.3, 0.5, 0.7]}, 50)
    n = t.results.groupBy("method", "perturbation_dim").agg(F.count("*").alias("n"))
    return g.join(n, ["method", "perturbation_dim"], "left").select("id", "method", "perturbation_dim", "lam", F.coalesce("n", F.lit(0)).alias("n"))


@case("f15_config_series", """WITH s AS (SELECT unnest(range(3, 31)) AS n UNION ALL SELECT unnest(range(30, 180, 10))), r AS (SELECT n_bands, count(*) AS runs FROM results GROUP BY n_bands)
    SELECT concat('mmr_lambda050_variance_1dim_', n, 'bands') AS name, CAST(n AS INT) AS n_bands, coalesce(runs, 0) AS runs FROM s LEFT JOIN r ON r.n_bands = s.n""")
def _(t):
    runs = t.results.groupBy("n_bands").agg(F.count("*").alias("runs"))
    return sel.config_series(t.spark).join(runs, "n_bands", "left").select("name", "n_bands", F.coalesce("runs", F.lit(0)).alias("runs"))


@case("f16_excitation_combinations", """WITH e AS (SELECT DISTINCT excitation AS e FROM cubes)
    SELECT concat('single_', e) AS name, CAST(e AS VARCHAR) AS members FROM e UNION ALL SELECT concat('pair_', a.e, '_', b.e), concat(a.e, ',', b.e) FROM e a, e b WHERE a.e < b.e
    UNION ALL SELECT concat('triplet_', a.e, '_', b.e, '_', c.e), concat(a.e, ',', b.e, ',', c.e) FROM e a, e b, e c WHERE a.e < b.e AND b.e < c.e
    UNION ALL SELECT concat('all_', string_agg(CAST(e AS VARCHAR), '_' ORDER BY e)), string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FROM e""")
def _(t):
    return sel.excitation_combinations(t.cubes).select("name", F.array_join(F.col("excitations").cast("array<string>"), ",").alias("members"))
