"""Label comparison queries."""

from pyspark.sql import functions as F

from specband.operators import compare as cmp
from workload.registry import case


def rd(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes])


def ct(t):
    return cmp.contingency(t.pred, t.truth)


def mapped(t):
    c = ct(t)
    return cmp.apply_mapping(c, cmp.majority_mapping(c))


MAJ = """mj AS (SELECT cluster, class AS mapped FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, class) AS rn FROM ct) q WHERE rn = 1)"""


@case("i01_contingency", "SELECT class, cluster, n FROM ct")
def _(t):
    return ct(t)


@case("i01_contingency_masked", """SELECT t.class, p.cluster, count(*) AS n FROM truth t JOIN pred p ON t.pixel_id = p.pixel_id
    WHERE t.class >= 0 AND p.cluster >= 0 AND (t.y + t.x) % 3 <> 0 GROUP BY t.class, p.cluster""")
def _(t):
    return cmp.contingency(t.pred, t.truth, t.truth.select("scan_id", "y", "x", ((F.col("y") + F.col("x")) % 3 != 0).alias("keep")))


@case("i02_purity", "SELECT round(CAST(sum(m) AS DOUBLE) / sum(s), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS s FROM ct GROUP BY cluster) q")
def _(t):
    return rd(cmp.purity(ct(t)))


@case("i02_majority_mapping", f"WITH {MAJ} SELECT cluster, mapped FROM mj")
def _(t):
    return cmp.majority_mapping(ct(t))


PAIRS = """WITH s AS (SELECT sum(n * (n - 1.0) / 2) AS same, sum(n) AS t FROM ct),
    a AS (SELECT sum(n * (n - 1.0) / 2) AS c FROM (SELECT sum(n) AS n FROM ct GROUP BY class) q),
    b AS (SELECT sum(n * (n - 1.0) / 2) AS k FROM (SELECT sum(n) AS n FROM ct GROUP BY cluster) q),
    f AS (SELECT CAST(same AS DOUBLE) AS same, CAST(c AS DOUBLE) AS c, CAST(k AS DOUBLE) AS k, CAST(t AS DOUBLE) * (t - 1) / 2 AS tp FROM s, a, b) """


@case("i03_adjusted_rand", PAIRS + "SELECT round((same - c * k / tp) / ((c + k) / 2 - c * k / tp), 6) AS ari FROM f")
def _(t):
    return rd(cmp.pair_scores(ct(t)).select("ari"))


@case("i04_information_scores", """WITH h AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM ct) q),
    c AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM (SELECT sum(n) AS n FROM ct GROUP BY class) z) q),
    k AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM (SELECT sum(n) AS n FROM ct GROUP BY cluster) z) q),
    m AS (SELECT c.h AS hc, k.h AS hk, c.h + k.h - h.h AS mi FROM h, c, k)
    SELECT round(mi, 6) AS mutual_information, round(mi / ((hc + hk) / 2), 6) AS nmi, round(mi / hc, 6) AS homogeneity, round(mi / hk, 6) AS completeness,
    round(2 * (mi / hc) * (mi / hk) / (mi / hc + mi / hk), 6) AS v_measure FROM m""")
def _(t):
    return rd(cmp.information_scores(ct(t)))


@case("i05_adjusted_mutual_info", """WITH tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM ct), a AS (SELECT class, CAST(sum(n) AS DOUBLE) AS a FROM ct GROUP BY class), b AS (SELECT cluster, CAST(sum(n) AS DOUBLE) AS b FROM ct GROUP BY cluster),
    pr AS (SELECT a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS k FROM a, b, tot),
    e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1.0)
      - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM pr),
    m AS (SELECT sum(c.n / t.n * ln(c.n * t.n / (a.a * b.b))) AS mi FROM ct c, tot t, a, b WHERE c.class = a.class AND c.cluster = b.cluster),
    h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM a, tot) AS hc, (SELECT -sum(b / n * ln(b / n)) FROM b, tot) AS hk)
    SELECT round((mi - emi) / ((hc + hk) / 2 - emi), 6) AS ami FROM e, m, h""")
def _(t):
    return rd(cmp.adjusted_mutual_info(ct(t)))


@case("i06_fowlkes_mallows", PAIRS + "SELECT round(same / sqrt(c * k), 6) AS fowlkes_mallows FROM f")
def _(t):
    return rd(cmp.pair_scores(ct(t)).select("fowlkes_mallows"))


GRID = """WITH l AS (SELECT class AS l FROM ct UNION SELECT cluster FROM ct), g AS (SELECT a.l AS class, b.l AS cluster FROM l a, l b),
    cm AS (SELECT g.class, g.cluster, coalesce(ct.n, 0) AS n FROM g LEFT JOIN ct ON g.class = ct.class AND g.cluster = ct.cluster)"""


@case("i07_confusion_matrix", GRID + " SELECT class, cluster, n FROM cm")
def _(t):
    return cmp.confusion(ct(t))


@case("i08_confusion_normalized", GRID + """ SELECT class, cluster, round(CASE WHEN sum(n) OVER (PARTITION BY class) = 0 THEN 0 ELSE CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY class) END, 6) AS share FROM cm""")
def _(t):
    return rd(cmp.confusion_normalized(ct(t)))


@case("i09_per_class_prf", """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS position, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def _(t):
    return rd(cmp.per_class_prf(ct(t)))


@case("i10_per_class_full", """SELECT label, tp, pr - tp AS fp, sup - tp AS fn, CAST(tot - sup - pr + tp AS BIGINT) AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    round(CAST(tot - sup - pr + tp AS DOUBLE) / (tot - sup), 6) AS specificity, sup AS support, concat('Class_', label) AS class_name FROM prf""")
def _(t):
    return rd(cmp.per_class_full(ct(t)))


PERM = """WITH cl AS (SELECT DISTINCT cluster FROM ct), pm AS (
    SELECT a.class AS m0, b.class AS m1, c.class AS m2, d.class AS m3 FROM (SELECT DISTINCT class FROM ct) a, (SELECT DISTINCT class FROM ct) b, (SELECT DISTINCT class FROM ct) c, (SELECT DISTINCT class FROM ct) d
    WHERE a.class <> b.class AND a.class <> c.class AND a.class <> d.class AND b.class <> c.class AND b.class <> d.class AND c.class <> d.class),
    ks AS (SELECT k.a, k.b, k.c, k.d FROM (SELECT w.cluster AS a, x.cluster AS b, y.cluster AS c, z.cluster AS d FROM cl w, cl x, cl y, cl z WHERE w.cluster < x.cluster AND x.cluster < y.cluster AND y.cluster < z.cluster) k),
    al AS (SELECT row_number() OVER () AS id, * FROM ks, pm),
    e AS (SELECT id, a AS cluster, m0 AS mapped FROM al UNION ALL SELECT id, b, m1 FROM al UNION ALL SELECT id, c, m2 FROM al UNION ALL SELECT id, d, m3 FROM al),
    sc AS (SELECT e.id, sum({w}) AS s FROM e JOIN ct ON e.cluster = ct.cluster AND e.mapped = ct.class GROUP BY e.id),
    b AS (SELECT arg_max(id, s) AS id FROM sc)"""


@case("i11_hungarian_mapping", PERM.format(w="n") + " SELECT cl.cluster, coalesce(e.mapped, cl.cluster) AS mapped FROM cl CROSS JOIN b LEFT JOIN e ON e.cluster = cl.cluster AND e.id = b.id")
def _(t):
    return cmp.hungarian_mapping(ct(t))


@case("i12_hungarian_mapping_fraction", PERM.format(w="n / (SELECT sum(c2.n) FROM ct c2 WHERE c2.cluster = ct.cluster)") + " SELECT cl.cluster, coalesce(e.mapped, cl.cluster) AS mapped FROM cl CROSS JOIN b LEFT JOIN e ON e.cluster = cl.cluster AND e.id = b.id")
def _(t):
    return cmp.hungarian_mapping(ct(t), fraction=True)


@case("i13_permutation_mapping", """WITH c4 AS (SELECT t.class, p.cluster, count(*) AS n FROM truth t JOIN pred2 p ON t.pixel_id = p.pixel_id WHERE t.class >= 0 AND p.cluster >= 0 GROUP BY ALL),
    v AS (SELECT unnest(range(4)) AS v), pm AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM v a, v b, v c, v d WHERE a.v <> b.v AND a.v <> c.v AND a.v <> d.v AND b.v <> c.v AND b.v <> d.v AND c.v <> d.v),
    sc AS (SELECT a, b, c, d, sum(CASE WHEN class = CASE cluster WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END THEN n ELSE 0 END) AS ok, sum(n) AS tot FROM pm, c4 GROUP BY a, b, c, d),
    bs AS (SELECT * FROM sc ORDER BY ok DESC, a, b, c, d LIMIT 1)
    SELECT CAST(k AS INT) AS cluster, CAST(CASE k WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END AS INT) AS mapped, round(CAST(ok AS DOUBLE) / tot, 6) AS accuracy FROM bs, (SELECT unnest(range(4)) AS k) q""")
def _(t):
    return rd(cmp.permutation_mapping(cmp.contingency(t.pred2, t.truth), 4))


S = "(SELECT sum(tp) FROM lb)"


@case("i14_accuracy", """SELECT round(CAST(sum(tp) AS DOUBLE) / max(tot), 6) AS accuracy, round(avg(CASE WHEN sup > 0 THEN recall END), 6) AS balanced_accuracy,
    round(1 - CAST(sum(tp) AS DOUBLE) / max(tot), 6) AS error_rate, CAST(sum(tp) AS BIGINT) AS correct, CAST(max(tot) AS BIGINT) AS total FROM prf""")
def _(t):
    return rd(cmp.scores(ct(t)).select("accuracy", "balanced_accuracy", "error_rate", "correct", "total"))


AVGS = ", ".join([f"round(avg({m}), 6) AS {m}_macro, round(sum({m} * sup) / max(tot), 6) AS {m}_weighted, round(CAST(sum(tp) AS DOUBLE) / max(tot), 6) AS {m}_micro" for m in ("precision", "recall", "f1")])


@case("i15_averaged_prf", f"SELECT {AVGS} FROM prf")
def _(t):
    return rd(cmp.scores(ct(t)).select(*[f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted", "micro")]))


@case("i16_cohen_kappa", """WITH s AS (SELECT CAST(sum(tp) AS DOUBLE) / max(tot) AS po, CAST(sum(sup * pr) AS DOUBLE) / max(tot) / max(tot) AS pe FROM prf) SELECT round((po - pe) / (1 - pe), 6) AS cohen_kappa FROM s""")
def _(t):
    return rd(cmp.scores(ct(t)).select("cohen_kappa"))


@case("i17_matthews_corrcoef", """WITH s AS (SELECT CAST(sum(tp) AS DOUBLE) AS c, CAST(max(tot) AS DOUBLE) AS s, CAST(sum(sup * pr) AS DOUBLE) AS tp, CAST(sum(pr * pr) AS DOUBLE) AS pp, CAST(sum(sup * sup) AS DOUBLE) AS tt FROM prf)
    SELECT round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS matthews_corrcoef FROM s""")
def _(t):
    return rd(cmp.scores(ct(t)).select("matthews_corrcoef"))


@case("i18_pixel_accuracy", """WITH j AS (SELECT t.class, p.cluster FROM truth t LEFT JOIN pred p ON t.pixel_id = p.pixel_id AND p.cluster >= 0 WHERE t.class >= 0),
    s AS (SELECT CAST(sum(CASE WHEN class = cluster THEN 1 ELSE 0 END) AS BIGINT) AS correct_pixels, count(*) AS total_pixels FROM j)
    SELECT round(CAST(correct_pixels AS DOUBLE) / total_pixels, 6) AS accuracy, correct_pixels, total_pixels, round(1 - CAST(correct_pixels AS DOUBLE) / total_pixels, 6) AS error_rate FROM s""")
def _(t):
    return rd(cmp.pixel_accuracy(t.pred.where("cluster >= 0"), t.truth))


@case("i19_class_distribution", """SELECT class, CASE WHEN class < 0 THEN 'Background' ELSE concat('Class_', class) END AS name, count(*) AS pixel_count,
    round(count(*) * 100.0 / CASE WHEN class >= 0 THEN (SELECT count(*) FROM truth WHERE class >= 0) ELSE (SELECT count(*) FROM truth) END, 6) AS percentage FROM truth GROUP BY class""")
def _(t):
    return rd(cmp.class_distribution(t.truth))


@case("i20_class_distribution_compare", """WITH a AS (SELECT class AS label, count(*) AS n FROM truth WHERE class >= 0 GROUP BY 1), b AS (SELECT cluster AS label, count(*) AS n FROM pred WHERE cluster >= 0 GROUP BY 1)
    SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS true_count, coalesce(b.n, 0) AS pred_count FROM a FULL JOIN b ON a.label = b.label""")
def _(t):
    return cmp.class_distribution_compare(t.pred, t.truth)


ROI = "FROM {src} t JOIN rois AS r ON t.y >= r.y0 AND t.y < r.y1 AND t.x >= r.x0 AND t.x < r.x1"
RM = "m AS (SELECT roi_id, class, count(*) AS n " + ROI.format(src="truth") + " WHERE class >= 0 GROUP BY roi_id, class)"
RMAP = RM + """, mp AS (SELECT roi_id, arg_max(class, n * 100 - class) AS class, string_agg(CAST(class AS VARCHAR), ',' ORDER BY class) AS all_classes, CAST(max(n) AS DOUBLE) / sum(n) AS purity, CAST(sum(n) AS BIGINT) AS pixel_count FROM m GROUP BY roi_id)"""


@case("i21_roi_mapping", "WITH " + RMAP + " SELECT roi_id, class, all_classes, round(purity, 6) AS purity, pixel_count FROM mp")
def _(t):
    return rd(cmp.roi_mapping(t.rois, t.truth, check=False).withColumn("all_classes", F.concat_ws(",", F.col("all_classes").cast("array<string>"))))


@case("i22_roi_statistics", "WITH " + RMAP + """ SELECT count(*) AS n_rois, round(avg(purity), 6) AS average_purity, CAST(sum(CASE WHEN purity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS perfect_rois,
    CAST(sum(CASE WHEN purity <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS mixed_rois FROM mp""")
def _(t):
    return rd(cmp.roi_statistics(cmp.roi_mapping(t.rois, t.truth, check=False)))


@case("i22_rois_per_class", "WITH " + RMAP + " SELECT class, count(*) AS n_rois FROM mp GROUP BY class")
def _(t):
    return cmp.rois_per_class(cmp.roi_mapping(t.rois, t.truth, check=False))


@case("i23_roi_metrics", "WITH j AS (SELECT t.y, t.x, t.class, p.cluster FROM truth t JOIN pred p ON t.pixel_id = p.pixel_id WHERE t.class >= 0), c AS (SELECT roi_id, class, cluster " + ROI.format(src="j") + """),
    a AS (SELECT roi_id, count(*) AS pixel_count, CAST(sum(CASE WHEN class = cluster THEN 1 ELSE 0 END) AS BIGINT) AS correct_pixels FROM c GROUP BY roi_id),
    d AS (SELECT roi_id, arg_max(cluster, n * 100 - cluster) AS dominant_prediction, count(*) AS n_predictions FROM (SELECT roi_id, cluster, count(*) AS n FROM c GROUP BY ALL) q GROUP BY roi_id),
    k AS (SELECT roi_id, arg_max(class, n * 100 - class) AS class FROM (SELECT roi_id, class, count(*) AS n FROM c GROUP BY ALL) q GROUP BY roi_id)
    SELECT a.roi_id, pixel_count, correct_pixels, round(CAST(correct_pixels AS DOUBLE) / pixel_count, 6) AS accuracy, dominant_prediction, n_predictions, class, dominant_prediction = class AS class_match
    FROM a JOIN d ON a.roi_id = d.roi_id JOIN k ON a.roi_id = k.roi_id""")
def _(t):
    return rd(cmp.roi_metrics(t.rois, t.pred, t.truth))


@case("i24_roi_cluster_report", "WITH c AS (SELECT roi_id, cluster, count(*) AS n " + ROI.format(src="pred") + " WHERE cluster >= 0 GROUP BY roi_id, cluster) SELECT roi_id, cluster, n, round(100.0 * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY roi_id), 6) AS pct FROM c")
def _(t):
    return rd(cmp.roi_cluster_report(t.rois, t.pred))


@case("i25_prediction_mask", "SELECT t.y, t.x, CASE WHEN class < 0 THEN 0 WHEN class = cluster THEN 1 ELSE 2 END AS state FROM truth t LEFT JOIN pred p ON t.pixel_id = p.pixel_id")
def _(t):
    return cmp.prediction_mask(t.pred, t.truth).select("y", "x", "state")


@case("i26_per_class_error_map", "SELECT t.y, t.x, class, CASE WHEN class = cluster THEN 1 ELSE 0 END AS correct FROM truth t LEFT JOIN pred p ON t.pixel_id = p.pixel_id WHERE class >= 0")
def _(t):
    return cmp.per_class_error_map(t.pred, t.truth).select("y", "x", "class", "correct")


@case("i26_per_class_accuracy", "SELECT class, round(avg(CASE WHEN class = cluster THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM truth t LEFT JOIN pred p ON t.pixel_id = p.pixel_id WHERE class >= 0 GROUP BY class")
def _(t):
    return rd(cmp.per_class_accuracy(cmp.per_class_error_map(t.pred, t.truth)))


@case("i27_misclassification_rate", PERM.format(w="n") + """, mp AS (SELECT cl.cluster, coalesce(e.mapped, cl.cluster) AS mapped FROM cl CROSS JOIN b LEFT JOIN e ON e.cluster = cl.cluster AND e.id = b.id)
    SELECT round(1 - CAST(sum(CASE WHEN mp.mapped = ct.class THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS misclassification_rate, CAST(sum(n) AS BIGINT) AS total FROM ct JOIN mp ON ct.cluster = mp.cluster""")
def _(t):
    return rd(cmp.misclassification_rate(ct(t)))


@case("i28_compare_labelings", """WITH j AS (SELECT p.cluster AS a, q.cluster AS b FROM pred p JOIN pred2 q ON p.pixel_id = q.pixel_id WHERE p.cluster >= 0 AND q.cluster >= 0)
    SELECT round(100.0 * avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement_pct, CAST(sum(CASE WHEN a = b THEN 0 ELSE 1 END) AS BIGINT) AS differing, count(*) AS total, count(DISTINCT a) AS clusters_a, count(DISTINCT b) AS clusters_b FROM j""")
def _(t):
    return rd(cmp.compare_labelings(t.pred, t.pred2))


IMP = """WITH c1 AS (SELECT class, cluster, count(*) AS n FROM truth t JOIN pred p ON t.pixel_id = p.pixel_id WHERE class >= 0 AND cluster >= 0 GROUP BY ALL),
    m1 AS (SELECT cluster, arg_max(class, n * 100 - class) AS m FROM c1 GROUP BY cluster),
    c2 AS (SELECT class, cluster, count(*) AS n FROM truth t JOIN pred2 p ON t.pixel_id = p.pixel_id WHERE class >= 0 AND cluster >= 0 GROUP BY ALL),
    m2 AS (SELECT cluster, arg_max(class, n * 100 - class) AS m FROM c2 GROUP BY cluster),
    j AS (SELECT t.y, t.x, coalesce(m1.m = t.class, false) AS was, coalesce(m2.m = t.class, false) AS now FROM truth t LEFT JOIN pred p ON t.pixel_id = p.pixel_id LEFT JOIN m1 ON p.cluster = m1.cluster
      LEFT JOIN pred2 q ON t.pixel_id = q.pixel_id LEFT JOIN m2 ON q.cluster = m2.cluster WHERE t.class >= 0),
    st AS (SELECT y, x, CASE WHEN NOT was AND now THEN 1 WHEN was AND NOT now THEN 2 WHEN NOT was AND NOT now THEN 3 ELSE 0 END AS state FROM j)"""


@case("i29_improvement_map", IMP + " SELECT y, x, state FROM st")
def _(t):
    return cmp.improvement_map(t.truth, t.pred, t.pred2).select("y", "x", "state")


def _n(*s):
    return f"CAST(sum(CASE WHEN state IN ({', '.join(map(str, s))}) THEN 1 ELSE 0 END) AS BIGINT)"


@case("i29_improvement_stats", IMP + f""" SELECT {_n(0, 2)} AS baseline_correct, {_n(1, 3)} AS baseline_wrong, {_n(0, 1)} AS optimized_correct, {_n(2, 3)} AS optimized_wrong, {_n(1, 3)} - {_n(2, 3)} AS noise_reduction,
    round(({_n(1, 3)} - {_n(2, 3)}) * 100.0 / {_n(1, 3)}, 6) AS noise_reduction_pct, {_n(1)} AS improved_pixels, {_n(2)} AS degraded_pixels, {_n(3)} AS still_wrong_pixels FROM st""")
def _(t):
    return rd(cmp.improvement_stats(cmp.improvement_map(t.truth, t.pred, t.pred2)))


@case("i30_image_difference_stats", """SELECT excitation, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_abs
    FROM (SELECT a.excitation, a.value - b.value AS d FROM cubes a JOIN cubes b ON a.y = b.y AND a.x = b.x AND a.em_idx = b.em_idx AND a.excitation + 20 = b.excitation) q GROUP BY excitation""")
def _(t):
    a, b = (t.cubes.select("scan_id", (F.col("excitation") - step).alias("excitation"), "y", "x", "em_idx", "value") for step in (0, 20))
    return rd(cmp.image_difference_stats(a, b, by=("excitation",)))


ST = """pp AS (SELECT 'base' AS method, pixel_id, cluster FROM pred UNION ALL SELECT 'opt', pixel_id, cluster FROM pred2),
    cx AS (SELECT method, class, cluster, count(*) AS n FROM truth t JOIN pp ON t.pixel_id = pp.pixel_id WHERE class >= 0 AND cluster >= 0 GROUP BY method, class, cluster)"""


@case("i31_compare_methods_table", "WITH " + ST + """, pu AS (SELECT method, CAST(sum(m) AS DOUBLE) / sum(s) AS purity FROM (SELECT method, max(n) AS m, sum(n) AS s FROM cx GROUP BY method, cluster) q GROUP BY method),
    s AS (SELECT method, sum(n * (n - 1.0) / 2) AS same, sum(n) AS t FROM cx GROUP BY method),
    a AS (SELECT method, sum(n * (n - 1.0) / 2) AS c FROM (SELECT method, sum(n) AS n FROM cx GROUP BY method, class) q GROUP BY method),
    b AS (SELECT method, sum(n * (n - 1.0) / 2) AS k FROM (SELECT method, sum(n) AS n FROM cx GROUP BY method, cluster) q GROUP BY method),
    f AS (SELECT s.method, CAST(same AS DOUBLE) AS same, CAST(c AS DOUBLE) AS c, CAST(k AS DOUBLE) AS k, CAST(t AS DOUBLE) * (t - 1) / 2 AS tp FROM s JOIN a ON s.method = a.method JOIN b ON s.method = b.method)
    SELECT f.method, round(purity, 6) AS purity, round((same - c * k / tp) / ((c + k) / 2 - c * k / tp), 6) AS ari, round(same / sqrt(c * k), 6) AS fowlkes_mallows, round(purity, 6) AS accuracy
    FROM f JOIN pu ON f.method = pu.method""")
def _(t):
    both = t.pred.withColumn("method", F.lit("base")).unionByName(t.pred2.withColumn("method", F.lit("opt")))
    return rd(cmp.compare_methods_table(both, t.truth).select("method", "purity", "ari", "fowlkes_mallows", "accuracy"))


REP = """SELECT concat('Class_', label) AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, sup AS support FROM prf
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(max(tot) AS BIGINT) FROM prf
    UNION ALL SELECT 'weighted avg', round(sum(precision * sup) / max(tot), 6), round(sum(recall * sup) / max(tot), 6), round(sum(f1 * sup) / max(tot), 6), CAST(max(tot) AS BIGINT) FROM prf"""


@case("i32_classification_report", REP)
def _(t):
    return rd(cmp.classification_report(ct(t)))


@case("i33_metrics_long", """SELECT concat('Class_', label) AS scope, NULL AS accuracy, CAST(NULL AS DOUBLE) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, sup AS support FROM prf
    UNION ALL SELECT 'overall', round(CAST(sum(tp) AS DOUBLE) / max(tot), 6), round(avg(CASE WHEN sup > 0 THEN recall END), 6), NULL, NULL, NULL, NULL FROM prf""")
def _(t):
    return rd(cmp.metrics_long(ct(t)).drop("cohen_kappa", "f1_weighted"))


@case("i34_metrics_summary", GRID + """ SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN class = cluster THEN n ELSE 0 END) AS BIGINT) AS trace, CAST(sum(CASE WHEN class = cluster THEN 0 ELSE n END) AS BIGINT) AS off_diagonal,
    count(DISTINCT class) AS n_labels, round(CAST(sum(CASE WHEN class = cluster THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS accuracy FROM cm""")
def _(t):
    return rd(cmp.metrics_summary(ct(t)))


@case("i34_confusion_row_sums", GRID + " SELECT class, CAST(sum(n) AS BIGINT) AS row_sum FROM cm GROUP BY class")
def _(t):
    return cmp.confusion_row_sums(ct(t))


@case("i35_roc_auc_ovr", """WITH s AS (SELECT CAST(o_custkey % 4 AS INT) AS class, k AS label, floor(o_totalprice / 5000) + CASE WHEN o_custkey % 4 = k THEN 6 * (k + 1) ELSE 0 END AS score
      FROM orders, (SELECT unnest(range(4)) AS k) q),
    r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS rk FROM s),
    a AS (SELECT label, (sum(CASE WHEN class = label THEN rk ELSE 0 END) - sum(CASE WHEN class = label THEN 1 ELSE 0 END) * (sum(CASE WHEN class = label THEN 1 ELSE 0 END) + 1) / 2.0)
      / (CAST(sum(CASE WHEN class = label THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN class <> label THEN 1 ELSE 0 END)) AS auc FROM r GROUP BY label)
    SELECT round(avg(auc), 6) AS roc_auc FROM a""")
def _(t):
    k = F.col("label")
    s = t.raw("orders").select((F.col("o_custkey") % 4).cast("int").alias("class"), "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("label"))
    s = s.select("class", "label", (F.floor(F.col("o_totalprice") / 5000) + F.when(F.col("class") == k, 6 * (k + 1)).otherwise(0)).alias("score"))
    return rd(cmp.roc_auc_ovr(s))
