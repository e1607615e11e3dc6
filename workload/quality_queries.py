"""Cluster quality and spatial coherence queries."""

from pyspark.sql import functions as F

from specband.operators import quality as q
from workload.compare_queries import rd
from workload.registry import case


def lp(t):
    return t.pixels.withColumn("cluster", F.col("label"))


@case("h01_silhouette", """WITH d AS (SELECT a.pixel_id, a.label AS ca, b.label AS cb, sum(list_distance(a.spectrum, b.spectrum)) AS s, count(*) AS n FROM pixels a, pixels b GROUP BY 1, 2, 3),
    w AS (SELECT pixel_id, max(CASE WHEN ca = cb THEN s / (n - 1) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b FROM d GROUP BY pixel_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM w""")
def _(t):
    return rd(q.silhouette(lp(t), sample=None))


@case("h01_silhouette_sample", """WITH k AS (SELECT * FROM pixels ORDER BY md5(concat(CAST(pixel_id AS VARCHAR), '|42')), pixel_id LIMIT 200),
    d AS (SELECT a.pixel_id, a.label AS ca, b.label AS cb, sum(list_distance(a.spectrum, b.spectrum)) AS s, count(*) AS n FROM k a, k b GROUP BY 1, 2, 3),
    w AS (SELECT pixel_id, max(CASE WHEN ca = cb THEN n END) AS own, max(CASE WHEN ca = cb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b FROM d GROUP BY pixel_id)
    SELECT round(avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w""")
def _(t):
    return rd(q.silhouette(lp(t), sample=200))


CEN = "c AS (SELECT label AS cluster, band_id, avg(value) AS v, count(*) AS n FROM longpix GROUP BY 1, 2), p AS (SELECT l.label, l.pixel_id, sum(pow(l.value - c.v, 2)) AS sq FROM longpix l JOIN c ON l.label = c.cluster AND l.band_id = c.band_id GROUP BY 1, 2), s AS (SELECT label, avg(sqrt(sq)) AS s, sum(sq) AS w, count(*) AS n FROM p GROUP BY label)"


@case("h02_davies_bouldin", "WITH " + CEN + ", d AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM c a JOIN c b ON a.band_id = b.band_id AND a.cluster <> b.cluster GROUP BY 1, 2) SELECT round(avg(m), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS m FROM d JOIN s x ON d.i = x.label JOIN s y ON d.j = y.label GROUP BY i) q")
def _(t):
    return rd(q.davies_bouldin(lp(t)))


@case("h03_calinski_harabasz", "WITH " + CEN + ", g AS (SELECT band_id, avg(value) AS m FROM longpix GROUP BY band_id), b AS (SELECT sum(c.n * pow(c.v - g.m, 2)) AS b FROM c JOIN g ON c.band_id = g.band_id) SELECT round((max(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM s, b")
def _(t):
    return rd(q.calinski_harabasz(lp(t)))


@case("h04_inertia", "WITH " + CEN + " SELECT round(sum(w), 5) AS inertia FROM s")
def _(t):
    return rd(q.inertia(lp(t)), 5)


@case("h05_degenerate_guard", """SELECT user_id, CASE WHEN k < 2 THEN 0 ELSE s END AS silhouette, CASE WHEN k < 2 THEN 0 ELSE s END AS davies_bouldin FROM (SELECT user_id, count(DISTINCT CASE WHEN value > 3 * user_id THEN event_type END) AS k, round(max(value), 6) AS s FROM events GROUP BY user_id) q""")
def _(t):
    s = t.raw("events").groupBy("user_id").agg(F.countDistinct(F.when(F.col("value") > 3 * F.col("user_id"), F.col("event_type"))).alias("n_clusters"), F.round(F.max("value"), 6).alias("silhouette"))
    return q.degenerate_guard(s.withColumn("davies_bouldin", F.col("silhouette")), 0.0).select("user_id", "silhouette", "davies_bouldin")


H = "WITH d AS (SELECT max(y) + 1 AS h FROM pred), "


@case("h06_spatial_coherence_8", """WITH o AS (SELECT a.dy, b.dx FROM (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b WHERE dy <> 0 OR dx <> 0),
    n AS (SELECT p.y, p.x, CAST(sum(CASE WHEN q.cluster = p.cluster THEN 1 ELSE 0 END) AS DOUBLE) / 8 AS v FROM pred p CROSS JOIN o LEFT JOIN pred q ON q.y = p.y + dy AND q.x = p.x + dx WHERE p.cluster >= 0 GROUP BY 1, 2)
    SELECT round(avg(v), 8) AS spatial_coherence FROM n""")
def _(t):
    return rd(q.spatial_coherence_8(t.pred).drop("scan_id"), 8)


@case("h07_spatial_coherence_4", """WITH d AS (SELECT max(y) + 1 AS h FROM pred), o AS (SELECT unnest([-1, 1, 0, 0]) AS dy, unnest([0, 0, -1, 1]) AS dx),
    n AS (SELECT p.y, p.x, p.cluster, CAST(sum(CASE WHEN q.cluster = p.cluster THEN 1 ELSE 0 END) AS DOUBLE) / 4 AS v FROM pred p CROSS JOIN o LEFT JOIN pred q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)
    SELECT y, x, CASE WHEN y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND 148 AND cluster >= 0 THEN v ELSE 0 END AS coherence FROM n, d""")
def _(t):
    return q.spatial_coherence_4(t.pred).drop("scan_id")


@case("h08_relabel_consecutive", "SELECT pixel_id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INT) AS label FROM (SELECT pixel_id, cluster * cluster + 3 AS c FROM pred WHERE cluster >= 0) q")
def _(t):
    return q.relabel_consecutive(t.pred.where("cluster >= 0").withColumn("cluster", F.col("cluster") * F.col("cluster") + 3)).select("pixel_id", "label")


_KER = ", ".join(f"({i - 12}, {w!r})" for i, w in enumerate(q.gaussian_kernel(3.0)))


@case("h09_smoothed_difference", f"""WITH kr AS (SELECT * FROM (VALUES {_KER}) v(o, w)), d AS (SELECT max(y) + 1 AS h FROM pred), df AS (SELECT p.y, p.x, CASE WHEN p.cluster <> q.cluster THEN 1.0 ELSE 0.0 END AS v FROM pred p JOIN pred2 q ON p.pixel_id = q.pixel_id),
    ax AS (SELECT a.y, a.x, sum(k.w * b.v) AS v FROM df a CROSS JOIN kr k JOIN df b ON b.y = a.y AND b.x = CASE WHEN (a.x + o + 300) % 300 < 150 THEN (a.x + o + 300) % 300 ELSE 299 - (a.x + o + 300) % 300 END GROUP BY 1, 2),
    ay AS (SELECT a.y, a.x, sum(k.w * b.v) AS v FROM ax a CROSS JOIN kr k CROSS JOIN d JOIN ax b ON b.x = a.x AND b.y = CASE WHEN (a.y + o + 4 * h) % (2 * h) < h THEN (a.y + o + 4 * h) % (2 * h) ELSE 2 * h - 1 - (a.y + o + 4 * h) % (2 * h) END GROUP BY 1, 2)
    SELECT y, x, round(v, 7) AS value FROM ay""")
def _(t):
    j = t.pred.join(t.pred2.select("scan_id", "y", "x", F.col("cluster").alias("c2")), ["scan_id", "y", "x"])
    d = j.select("scan_id", "y", "x", F.when(F.col("cluster") != F.col("c2"), 1.0).otherwise(0.0).alias("value"))
    return rd(q.smoothed_difference(d).drop("scan_id"), 7)
