"""Object queries."""

from pyspark.sql import functions as F

from specband.operators import objects as ob
from workload.compare_queries import rd
from workload.registry import case


def fg(t):
    return t.truth.where("class >= 0")


def objs(t):
    return ob.connected_components(fg(t))


def oc(t):
    return ob.object_contingency(objs(t), t.pred2, t.truth)


for _name, _c, _tile in (("j01_connected_components", 8, 256), ("j01_connected_components_4", 4, 256), ("j01_connected_components_small_tiles", 8, 7)):
    @case(_name, f"SELECT y, x, object_id FROM objs{_c}")
    def _(t, c=_c, tile=_tile):
        return ob.connected_components(fg(t), c, tile).select("y", "x", "object_id")


@case("j02_filter_small", "WITH s AS (SELECT object_id, CAST(row_number() OVER (ORDER BY object_id) AS BIGINT) AS n FROM objs8 GROUP BY object_id HAVING count(*) >= 40) SELECT y, x, s.n AS object_id FROM objs8 o JOIN s ON o.object_id = s.object_id")
def _(t):
    return ob.filter_small(objs(t), 40).select("y", "x", "object_id")


SM = """j AS (SELECT o.*, t.class FROM objs8 o JOIN truth t ON o.y = t.y AND o.x = t.x),
    sm AS (SELECT object_id, count(*) AS pixel_count, avg(y) AS centroid_y, avg(x) AS centroid_x, min(y) AS y_min, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max, mode(class) AS class_label FROM j GROUP BY object_id)"""


def sm(t):
    return ob.object_summary(objs(t), t.truth)


@case("j03_object_summary", "WITH " + SM + " SELECT object_id, pixel_count, round(centroid_y, 6) AS centroid_y, round(centroid_x, 6) AS centroid_x, y_min, x_min, y_max, x_max, class_label FROM sm")
def _(t):
    return rd(sm(t).drop("scan_id"))


@case("j04_object_size_stats", "WITH " + SM + " SELECT count(*) AS total_objects, round(avg(pixel_count), 6) AS mean_size, round(stddev_pop(pixel_count), 6) AS std_size, min(pixel_count) AS min_size, max(pixel_count) AS max_size FROM sm")
def _(t):
    return rd(ob.object_size_stats(sm(t)))


@case("j04_objects_per_class", "WITH " + SM + " SELECT class_label, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sm), 6) AS share FROM sm GROUP BY class_label")
def _(t):
    return rd(ob.objects_per_class(sm(t)))


@case("j05_object_pixels", "SELECT p.y, p.x, p.cluster FROM objs8 o JOIN pred p ON o.y = p.y AND o.x = p.x WHERE o.object_id = 3")
def _(t):
    return ob.object_pixels(objs(t), t.pred, 3).select("y", "x", "cluster")


@case("j05_objects_by_class", "WITH " + SM + " SELECT object_id, pixel_count FROM sm WHERE class_label = 2")
def _(t):
    return ob.objects_by_class(sm(t), 2).select("object_id", "pixel_count")


@case("j06_assign_roi_to_objects", "WITH " + SM + """, r AS (SELECT object_id, min_by(roi_id, ord) AS roi_id FROM sm JOIN rois ON centroid_y >= y0 AND centroid_y < y1 AND centroid_x >= x0 AND centroid_x < x1 GROUP BY object_id)
    SELECT sm.object_id, r.roi_id FROM sm LEFT JOIN r ON sm.object_id = r.object_id""")
def _(t):
    rois = t.rois.select("roi_id", "ord", F.col("y0").alias("y"), F.col("x0").alias("x"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))
    return ob.assign_roi_to_objects(sm(t), rois).select("object_id", "roi_id")


OCT = "oc AS (SELECT object_id, t.class, p.cluster, count(*) AS n FROM objs8 o JOIN truth t ON o.y = t.y AND o.x = t.x JOIN pred2 p ON t.pixel_id = p.pixel_id GROUP BY 1, 2, 3)"
OM = OCT + """, ol AS (SELECT object_id, label, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(su) AS DOUBLE) AS su, CAST(sum(pr) AS DOUBLE) AS pr FROM (SELECT object_id, class AS label, CASE WHEN class = cluster THEN n ELSE 0 END AS tp, n AS su, 0 AS pr FROM oc UNION ALL SELECT object_id, cluster, 0, 0, n FROM oc) q GROUP BY 1, 2),
    pf AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS p, CASE WHEN su = 0 THEN 0 ELSE tp / su END AS r, 2 * tp / (su + pr) AS f, sum(su) OVER (PARTITION BY object_id) AS t FROM ol),
    om AS (SELECT object_id, max(t) AS t, sum(tp) AS ok, sum(tp) / max(t) AS accuracy, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm, sum(p * su) / max(t) AS pw, sum(r * su) / max(t) AS rw, sum(f * su) / max(t) AS fw,
      CASE WHEN sum(su * pr) / (max(t) * max(t)) = 1 THEN NULL ELSE (sum(tp) / max(t) - sum(su * pr) / (max(t) * max(t))) / (1 - sum(su * pr) / (max(t) * max(t))) END AS kappa,
      CASE WHEN (max(t) * max(t) - sum(pr * pr)) * (max(t) * max(t) - sum(su * su)) = 0 THEN 0 ELSE (sum(tp) * max(t) - sum(su * pr)) / sqrt((max(t) * max(t) - sum(pr * pr)) * (max(t) * max(t) - sum(su * su))) END AS mcc FROM pf GROUP BY object_id),
    tc AS (SELECT object_id, CASE WHEN count(DISTINCT class) = 1 THEN min(class) ELSE -1 END AS true_class, string_agg(DISTINCT CAST(cluster AS VARCHAR), ',' ORDER BY CAST(cluster AS VARCHAR)) AS preds FROM oc GROUP BY object_id),
    ml AS (SELECT object_id, min_by(class, class - 1000 * n) AS class_label FROM (SELECT object_id, class, sum(n) AS n FROM oc GROUP BY 1, 2) q GROUP BY object_id),
    m AS (SELECT om.object_id, true_class, class_label, preds, CAST(t AS BIGINT) AS total_pixels, CAST(ok AS BIGINT) AS correct_pixels, accuracy, {p} AS precision, {r} AS recall, {f} AS f1, kappa AS cohen_kappa, mcc FROM om JOIN tc ON om.object_id = tc.object_id JOIN ml ON om.object_id = ml.object_id)"""
MAC, WEI = OM.format(p="pm", r="rm", f="fm"), OM.format(p="pw", r="rw", f="fw")
SEL = ", ".join(f"round({m}, 6) AS {m}" for m in ob.METRICS)


@case("j07_object_metrics_macro", "WITH " + MAC + f" SELECT object_id, true_class, class_label, total_pixels, correct_pixels, total_pixels - correct_pixels AS incorrect_pixels, {SEL}, preds FROM m")
def _(t):
    m = ob.object_metrics(oc(t))
    return rd(m.withColumn("preds", F.array_join(F.array_sort(F.map_keys("prediction_distribution").cast("array<string>")), ",")).drop("prediction_distribution", "scan_id"))


@case("j07_object_metrics_mapped", """WITH oc AS (SELECT object_id, t.class, p.cluster, count(*) AS n FROM objs8 o JOIN truth t ON o.y = t.y AND o.x = t.x JOIN pred p ON t.pixel_id = p.pixel_id GROUP BY 1, 2, 3),
    mp AS (SELECT * FROM (VALUES (1, 0), (4, 1), (2, 2), (0, 3)) v(cluster, m)) SELECT object_id, round(CAST(sum(CASE WHEN coalesce(m, oc.cluster) = class THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS accuracy FROM oc LEFT JOIN mp ON oc.cluster = mp.cluster GROUP BY object_id""")
def _(t):
    o = ob.object_contingency(objs(t), t.pred, t.truth)
    return rd(ob.object_metrics(ob.object_mapped_contingency(o)).select("object_id", "accuracy"))


@case("j08_object_metrics_weighted", "WITH " + WEI + " SELECT object_id, true_class, total_pixels, " + SEL + " FROM m")
def _(t):
    return rd(ob.object_metrics(oc(t), "weighted").select("object_id", "true_class", "total_pixels", *ob.METRICS))


@case("j09_object_accuracy", """SELECT object_id, count(*) AS num_pixels, CASE WHEN min(class) = max(class) THEN min(class) ELSE -1 END AS true_class, round(avg(CASE WHEN class = cluster THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM objs8 o JOIN truth t ON o.y = t.y AND o.x = t.x JOIN pred2 p ON t.pixel_id = p.pixel_id GROUP BY object_id""")
def _(t):
    return rd(ob.object_accuracy(objs(t), t.pred2, t.truth).drop("scan_id"))


@case("j10_aggregate_by_class", "WITH " + MAC + " SELECT class_label, count(*) AS num_objects, CAST(sum(total_pixels) AS BIGINT) AS total_pixels, " + ", ".join(f"round({f}({m}), 6) AS {m}_{s}" for m in ob.METRICS for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + " FROM m GROUP BY class_label")
def _(t):
    return rd(ob.aggregate_by_class(ob.object_metrics(oc(t))))


@case("j11_best_worst_objects", "WITH " + MAC + " (SELECT 'best' AS kind, object_id, round(accuracy, 6) AS accuracy FROM m ORDER BY m.accuracy DESC, object_id LIMIT 5) UNION ALL (SELECT 'worst', object_id, round(accuracy, 6) FROM m ORDER BY m.accuracy, object_id LIMIT 5)")
def _(t):
    return rd(ob.best_worst_objects(ob.object_metrics(oc(t))).drop("scan_id"))


@case("j12_performance_matrix", "WITH " + MAC + " SELECT object_id, " + SEL + " FROM m")
def _(t):
    return rd(ob.performance_matrix(ob.object_metrics(oc(t))).drop("scan_id"))


@case("j13_object_global_summary", "WITH " + MAC + " " + " UNION ALL ".join(f"SELECT '{x}' AS metric, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(median({x}), 6) AS median FROM m" for x in ob.METRICS))
def _(t):
    return rd(ob.object_global_summary(ob.object_metrics(oc(t))))


@case("j14_object_confusion", "WITH " + OCT + ", k AS (SELECT class, cluster, n FROM oc WHERE object_id = 3), l AS (SELECT class AS l FROM k UNION SELECT cluster FROM k) SELECT a.l AS class, b.l AS cluster, coalesce(k.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN k ON k.class = a.l AND k.cluster = b.l")
def _(t):
    return ob.object_confusion(oc(t), 3)


@case("j15_object_metric_map", "WITH " + MAC + " SELECT y, x, o.object_id, round(accuracy, 6) AS accuracy FROM objs8 o JOIN m ON o.object_id = m.object_id")
def _(t):
    o = objs(t)
    return rd(ob.object_metric_map(o, ob.object_metrics(ob.object_contingency(o, t.pred2, t.truth))).drop("scan_id"))


@case("j16_multi_config_object_compare", "SELECT object_id, " + ", ".join(f"round(max(CASE WHEN config_name = 'cfg_{n}bands' THEN accuracy END), 6) AS cfg_{n}bands" for n in range(10, 80, 10)) + " FROM objres GROUP BY object_id")
def _(t):
    return rd(ob.multi_config_object_compare(t.objres, [f"cfg_{n}bands" for n in range(10, 80, 10)]))
