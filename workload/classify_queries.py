"""Classification and clustering queries."""

from pyspark.sql import functions as F

from specband.operators import classify as cl, quality as q
from specband.sources import io
from workload.compare_queries import rd
from workload.registry import case
from workload.sources_queries import scratch


@case("g01_roi_training_set", "SELECT pixel_id, ord AS class FROM pixels p JOIN roipx AS r ON p.y >= r.y0 AND p.y < r.y1 AND p.x >= r.x0 AND p.x < r.x1")
def _(t):
    return cl.roi_training_set(t.pixels, t.roipx).select("pixel_id", "class")


@case("g01_roi_training_dominant", """WITH m AS (SELECT roi_id, class, count(*) AS n FROM truth t JOIN rois AS r ON t.y >= r.y0 AND t.y < r.y1 AND t.x >= r.x0 AND t.x < r.x1 WHERE class >= 0 GROUP BY 1, 2),
    d AS (SELECT roi_id, arg_max(class, n * 100 - class) AS class FROM m GROUP BY roi_id)
    SELECT pixel_id, d.roi_id, d.class FROM truth t JOIN rois AS r ON t.y >= r.y0 AND t.y < r.y1 AND t.x >= r.x0 AND t.x < r.x1 JOIN d ON d.roi_id = r.roi_id""")
def _(t):
    return cl.roi_training_set(t.truth.drop("class"), t.rois, "dominant", t.truth).select("pixel_id", "roi_id", "class")


SCALED = """st AS (SELECT l.band_id, avg(l.value) AS m, stddev_pop(l.value) AS sd FROM longpix l JOIN train AS t ON l.pixel_id = t.pixel_id GROUP BY l.band_id),
    z AS (SELECT pixel_id, l.band_id, (value - m) / sd AS v FROM longpix l JOIN st ON l.band_id = st.band_id)"""
RAW = "z AS (SELECT pixel_id, band_id, value AS v FROM longpix)"


def _nn(space, dist, k):
    return f"""WITH {space}, ds AS (SELECT a.pixel_id, b.pixel_id AS tid, t.class, {dist} AS d FROM z a JOIN z b ON a.band_id = b.band_id JOIN train AS t ON b.pixel_id = t.pixel_id GROUP BY a.pixel_id, b.pixel_id, t.class),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY d, tid) AS rn FROM ds) q WHERE rn <= {k})"""


EU, MAN = "sqrt(sum(pow(a.v - b.v, 2)))", "sum(abs(a.v - b.v))"


def _label(w):
    return f", v AS (SELECT pixel_id, class, sum({w}) AS w FROM nn GROUP BY 1, 2) SELECT pixel_id, class AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY w DESC, class) AS r FROM v) q WHERE r = 1"


@case("g02_knn_classify", _nn(SCALED, EU, 5) + _label("1"))
def _(t):
    return cl.knn_classify(t.pixels, t.train).select("pixel_id", "cluster")



@case("g03_knn_distance_weights", _nn(RAW, EU, 5) + _label("CASE WHEN z0 THEN CASE WHEN d = 0 THEN 1 ELSE 0 END ELSE 1 / d END").replace("FROM nn GROUP", "FROM (SELECT *, min(d) OVER (PARTITION BY pixel_id) = 0 AS z0 FROM nn) nn GROUP"))
def _(t):
    return cl.knn_classify(t.pixels, t.train, weights="distance", scale=False).select("pixel_id", "cluster")


@case("g04_knn_manhattan", _nn(SCALED, MAN, 5) + _label("1"))
def _(t):
    return cl.knn_classify(t.pixels, t.train, metric="manhattan").select("pixel_id", "cluster")


PROBA = _nn(SCALED, EU, 7) + ", c AS (SELECT unnest(range(10)) AS class), p AS (SELECT DISTINCT pixel_id FROM pixels)"
PSEL = " SELECT p.pixel_id, CAST(c.class AS INT) AS class, round(CAST(count(nn.tid) AS DOUBLE) / 7, 6) AS proba"


@case("g05_knn_proba", PROBA + PSEL + " FROM p CROSS JOIN c LEFT JOIN nn ON nn.pixel_id = p.pixel_id AND nn.class = c.class GROUP BY 1, 2")
def _(t):
    return rd(cl.knn_proba(t.pixels, t.train, list(range(10)), 7))


@case("g06_threshold_class_mask", PROBA + PSEL.replace("round(CAST(count(nn.tid) AS DOUBLE) / 7, 6) AS proba", "count(nn.tid) / 7.0 > 0.4 AS keep") + " FROM p CROSS JOIN c LEFT JOIN nn ON nn.pixel_id = p.pixel_id AND nn.class = c.class GROUP BY 1, 2")
def _(t):
    return cl.threshold_class_mask(cl.knn_proba(t.pixels, t.train, list(range(10)), 7), 0.4).select("pixel_id", "class", "keep")


CV = f"""WITH f AS (SELECT pixel_id, label AS class, (row_number() OVER (PARTITION BY label ORDER BY pixel_id) - 1) % 5 AS fold FROM pixels),
    ds AS (SELECT a.pixel_id, fa.fold, fa.class, b.pixel_id AS tid, fb.class AS tc, list_distance(a.spectrum, b.spectrum) AS d FROM pixels a JOIN f fa ON a.pixel_id = fa.pixel_id, pixels b JOIN f fb ON b.pixel_id = fb.pixel_id WHERE fa.fold <> fb.fold),
    nn AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY d, tid) AS rn FROM ds), ks AS (SELECT unnest([1, 3, 9]) AS k),
    v AS (SELECT k, pixel_id, fold, class, tc, count(*) AS w FROM nn, ks WHERE rn <= k GROUP BY ALL),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, pixel_id ORDER BY w DESC, tc) AS r FROM v) q WHERE r = 1)"""


@case("g07_knn_cv", CV + " SELECT CAST(k AS INT) AS k, CAST(fold AS INT) AS fold, round(avg(CASE WHEN class = tc THEN 1.0 ELSE 0.0 END), 6) AS score FROM p GROUP BY k, fold")
def _(t):
    return rd(cl.knn_cv(t.pixels.withColumn("class", F.col("label")), [1, 3, 9]).select("k", "fold", "score"))


@case("g07_knn_cv_best", CV + ", s AS (SELECT k, fold, avg(CASE WHEN class = tc THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY k, fold) SELECT CAST(k AS INT) AS k, round(avg(s), 6) AS mean FROM s GROUP BY k ORDER BY avg(s) DESC, k LIMIT 1")
def _(t):
    s = cl.knn_cv(t.pixels.withColumn("class", F.col("label")), [1, 3, 9])
    return rd(cl.best_params(cl.cv_summary(s)).select("k", "mean"))


RK = "WITH s AS (SELECT cube, k, avg(score) AS mean, stddev_pop(score) AS std FROM cvres GROUP BY 1, 2), r AS (SELECT *, CAST(rank() OVER (PARTITION BY cube ORDER BY round(mean, 12) DESC) AS INT) AS rank FROM s)"


@case("g08_cv_rank_table", RK + " SELECT cube, k, round(mean, 6) AS mean, round(std, 6) AS std, rank FROM r")
def _(t):
    return rd(cl.cv_rank_table(t.cvres))


@case("g08_cv_pivot", RK + " SELECT cube, " + ", ".join(f"round(max(CASE WHEN k = {k} THEN mean END), 6) AS k_{k}" for k in range(1, 11)) + " FROM r GROUP BY cube")
def _(t):
    return rd(cl.cv_pivot(cl.cv_rank_table(t.cvres), list(range(1, 11))))


@case("g09_kmeans")
def _(t):
    out, _ = cl.kmeans(t.pixels.select("pixel_id", "spectrum"), 5)
    return out.select("pixel_id", "cluster")


@case("g10_kmeans_large")
def _(t):
    return cl.kmeans_large(t.pixels.select("pixel_id", "spectrum"), 5).select("pixel_id", "cluster")


def _lloyd(rows, rounds):
    """Rounds of K-means in SQL from the first five pixels, then the labels; ``rows``: pixel_id, band_id, v."""
    label = """SELECT pixel_id, arg_min(cluster, d * 1000000 + cluster * 1e-9) AS cluster FROM
        (SELECT z.pixel_id, c.cluster, sum(pow(z.v - c.v, 2)) AS d FROM z JOIN c ON c.band_id = z.band_id {where} GROUP BY z.pixel_id, c.cluster) q GROUP BY pixel_id"""
    return f"""WITH RECURSIVE z AS ({rows}), c AS (SELECT 0 AS it, pixel_id AS cluster, band_id, v FROM z WHERE pixel_id < 5
        UNION ALL SELECT (SELECT max(it) FROM c) + 1, l.cluster, z.band_id, avg(z.v) FROM z JOIN ({label.format(where="")}) l ON l.pixel_id = z.pixel_id
          WHERE (SELECT max(it) FROM c) < {rounds} GROUP BY l.cluster, z.band_id)
    SELECT pixel_id, CAST(cluster AS INT) AS cluster FROM ({label.format(where=f"WHERE c.it = {rounds}")}) q"""


def first_five(t):
    return t.pixels.where("pixel_id < 5").select(F.col("pixel_id").cast("int").alias("cluster"), F.col("spectrum").alias("center"))


@case("g09_kmeans_from_starts", _lloyd("SELECT pixel_id, band_id, value AS v FROM longpix", 6))
def _(t):
    out, _ = cl.kmeans(t.pixels.select("pixel_id", "spectrum"), max_iter=5, tol=0.0, starts=first_five(t))
    return out.select("pixel_id", "cluster")


@case("g10_kmeans_large_from_starts", _lloyd("SELECT pixel_id, l.band_id, (value - m) / s AS v FROM longpix l JOIN (SELECT band_id, avg(value) AS m, stddev_pop(value) AS s FROM longpix GROUP BY band_id) n ON n.band_id = l.band_id", 4))
def _(t):
    return cl.kmeans_large(t.pixels.select("pixel_id", "spectrum"), 5, use_pca=False, starts=first_five(t), max_iter=3).select("pixel_id", "cluster")


@case("g11_kmeans_k_sweep")
def _(t):
    return cl.kmeans_k_sweep(t.pixels, [2, 3, 4, 5, 6, 7, 8], "label")


SWEEP = "SELECT l_linenumber AS k, {} AS score FROM lineitem GROUP BY l_linenumber"


@case("g11_best_k_by_silhouette", f"SELECT k, round(score, 6) AS score FROM ({SWEEP.format('avg(l_discount)')}) q ORDER BY score DESC, k LIMIT 1")
def _(t):
    return rd(cl.best_k(t.raw("lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("silhouette"))))


@case("g11_best_k_by_purity", f"SELECT k, round(score, 6) AS score FROM ({SWEEP.format('avg(l_tax)')}) q ORDER BY score DESC, k LIMIT 1")
def _(t):
    return rd(cl.best_k(t.raw("lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_tax").alias("purity")), "purity"))


@case("g11_best_k_of_sweep_by_silhouette")
def _(t):
    return cl.best_k(cl.kmeans_k_sweep(t.pixels, [2, 3, 4, 5, 6]))


@case("g11_best_k_of_sweep_by_purity")
def _(t):
    return cl.best_k(cl.kmeans_k_sweep(t.pixels, [2, 3, 4, 5, 6], "label"), "purity")


@case("g12_assign_nearest_center", """WITH c AS (SELECT label AS cluster, band_id, avg(value) AS v FROM longpix GROUP BY 1, 2),
    d AS (SELECT l.pixel_id, c.cluster, sqrt(sum(pow(l.value - c.v, 2))) AS d FROM longpix l JOIN c ON l.band_id = c.band_id GROUP BY 1, 2)
    SELECT pixel_id, cluster, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY d, cluster) AS r FROM d) q WHERE r = 1""")
def _(t):
    c = q.centroids(t.pixels.withColumn("cluster", F.col("label"))).select("cluster", "center")
    return rd(cl.assign_nearest_center(t.pixels, c).select("pixel_id", "cluster", "distance"))


@case("g13_mask_labels", "SELECT y, x, CASE WHEN (y * 7 + x) % 5 <> 0 THEN cluster ELSE -1 END AS cluster FROM pred")
def _(t):
    mask = t.pred.select("scan_id", "y", "x", ((F.col("y") * 7 + F.col("x")) % 5 != 0).alias("keep"))
    return cl.mask_labels(t.pred, mask).select("y", "x", "cluster")


PC = "pc AS (SELECT c.excitation, c.em_idx, c.value, p.cluster FROM cells c JOIN pred p ON p.pixel_id = c.x * 200 + c.y WHERE p.cluster >= 0)"
PR = PC + ", pr AS (SELECT cluster, excitation, em_idx, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM pc GROUP BY 1, 2, 3)"


def _placed(t):
    """Labels by the place of their order in the cubes, so that every cell has one."""
    return t.pred.select("scan_id", (F.col("pixel_id") % 200).cast("int").alias("y"), F.floor(F.col("pixel_id") / 200).cast("int").alias("x"), "cluster")


def _pc(t):
    return t.cells.join(_placed(t).where("cluster >= 0"), ["scan_id", "y", "x"])


@case("g14_cluster_profile", "WITH " + PR + " SELECT cluster, excitation, em_idx, round(mean, 6) AS mean, round(std, 6) AS std, n FROM pr")
def _(t):
    return rd(cl.cluster_profile(_pc(t)))


@case("g15_cluster_profile_by_excitation", "WITH " + PR + " SELECT cluster, excitation, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM pr GROUP BY 1, 2")
def _(t):
    return rd(cl.cluster_profile_by_excitation(cl.cluster_profile(_pc(t))))


@case("g16_cluster_ex_em_matrix", "WITH " + PC + ", b AS (SELECT cluster FROM pred WHERE cluster >= 0 GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 1) SELECT excitation, em_idx, round(avg(value), 6) AS mean FROM pc JOIN b ON pc.cluster = b.cluster GROUP BY 1, 2")
def _(t):
    return rd(cl.cluster_ex_em_matrix(t.cells, _placed(t)))


@case("g17_cluster_sizes", "SELECT cluster, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS pct FROM pred WHERE cluster >= 0 GROUP BY cluster")
def _(t):
    return rd(cl.cluster_sizes(t.pred))


@case("g18_cluster_pattern_groups")
def _(t):
    return cl.cluster_pattern_groups(t.objres, list(range(10, 80, 10)))


@case("g19_training_classes_filter", "SELECT doc_id, source FROM documents WHERE NOT (source LIKE '%src1%' OR source LIKE '%7%')")
def _(t):
    return cl.training_classes_filter(t.raw("documents").select("doc_id", "source"), ["src1", "7"], "source")


CK = RK + ", m AS (SELECT k, avg(mean) AS score, avg(rank) AS rank, avg(std) AS std FROM r GROUP BY k)"


@case("g20_consensus_k", CK + " SELECT k, round(score, 6) AS score, round(score / max(score) OVER (), 6) AS score_norm, round(rank / max(rank) OVER (), 6) AS rank_norm, round(std / max(std) OVER (), 6) AS std_norm FROM m")
def _(t):
    return rd(cl.consensus_k(cl.cv_rank_table(t.cvres)))


@case("g20_best_ks", CK + " SELECT k, round(score, 6) AS score FROM m ORDER BY m.score DESC, k LIMIT 5")
def _(t):
    return rd(cl.best_ks(cl.consensus_k(cl.cv_rank_table(t.cvres))).select("k", "score"))


@case("g21_cv_split_long", RK + ", l AS (SELECT c.cube, c.score FROM cvres c JOIN r ON c.cube = r.cube AND c.k = r.k AND r.rank = 1) SELECT cube, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median FROM l GROUP BY cube")
def _(t):
    wide = t.cvres.groupBy("cube", "k").pivot("fold", [0, 1, 2, 3, 4]).agg(F.first("score"))
    wide = wide.select("cube", "k", *[F.col(f"`{i}`").alias(f"split{i}") for i in range(5)])
    ranked = wide.join(cl.cv_rank_table(t.cvres).select("cube", "k", "rank"), ["cube", "k"])
    return rd(cl.cv_split_long(ranked, [f"split{i}" for i in range(5)]))


@case("g22_class_mean_spectrum", "SELECT label AS class, CAST(band_id AS INT) AS band_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM longpix GROUP BY 1, 2")
def _(t):
    return rd(cl.class_mean_spectrum(t.pixels.withColumnRenamed("label", "class")))


@case("g23_union_spectra_files", "SELECT CAST(c_nationkey AS VARCHAR) AS cubename, c_custkey AS pixel, c_acctbal AS value FROM customer")
def _(t):
    path = scratch(t.spark)
    src = t.raw("customer").select(F.col("c_nationkey").alias("cubename"), F.col("c_custkey").alias("pixel"), F.col("c_acctbal").alias("value"))
    io.write_table(src.repartition(4, "pixel"), path, "csv")
    return cl.union_spectra_files(t.spark, path, "cubename STRING, pixel BIGINT, value DOUBLE")
