"""Derived tables: the library's schemas built from the given parquet tables.

Each table exists twice, as a Spark frame and as the SQL text that derives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

# name -> SELECT over the given tables (or over earlier derived tables)
SQL_TABLES: dict[str, str] = {
    "pixels": """SELECT 's' AS scan_id, vec_id AS pixel_id, CAST(floor(vec_id / 25) AS INT) AS y,
        CAST(vec_id % 25 AS INT) AS x, CAST(embedding AS DOUBLE[]) AS spectrum, label FROM embeddings""",
    "bands": """SELECT CAST(b AS INT) AS band_id, CAST(300 + 20 * floor(b / 8) AS DOUBLE) AS excitation,
        CAST(b % 8 AS INT) AS em_idx, CAST(420 + 10 * (b % 8) AS DOUBLE) AS emission
        FROM (SELECT unnest(range(max(len(embedding)))) AS b FROM embeddings) q""",
    "longpix": """SELECT p.pixel_id, p.y, p.x, p.label, b.band_id, b.excitation, b.em_idx, b.emission, p.value
        FROM (SELECT pixel_id, y, x, label, unnest(spectrum) AS value, unnest(range(len(spectrum))) AS bi FROM pixels) p
        JOIN bands AS b ON b.band_id = p.bi""",
    "cubes": """SELECT 's' AS scan_id, CAST(300 + 20 * l_linenumber AS DOUBLE) AS excitation, CAST(l_suppkey % 31 AS INT) AS em_idx,
        CAST(420 + 10 * (l_suppkey % 31) AS DOUBLE) AS emission, CAST(l_orderkey % 200 AS INT) AS y,
        CAST(floor(l_orderkey / 200) AS INT) AS x, avg(sqrt(l_extendedprice / 1000.0)) AS value
        FROM lineitem GROUP BY l_linenumber, l_suppkey % 31, l_orderkey % 200, floor(l_orderkey / 200)""",
    "scan_bands": """SELECT 's' AS scan_id, CAST(300 + 20 * l_linenumber AS DOUBLE) AS excitation, CAST(l_suppkey % 31 AS INT) AS em_idx,
        CAST(420 + 10 * (l_suppkey % 31) AS DOUBLE) AS emission FROM lineitem GROUP BY l_linenumber, l_suppkey % 31""",
    "mask": """SELECT DISTINCT scan_id, y, x, (y * 7 + x) % 5 <> 0 AS keep FROM cubes""",
    "cells": """SELECT scan_id, excitation, em_idx, emission, y, x,
        CASE WHEN (y + em_idx) % 3 = 0 THEN NULL ELSE value END AS value FROM cubes""",
    "exposure": """SELECT CAST(300 + 20 * s_suppkey AS DOUBLE) AS excitation, CASE WHEN s_suppkey <> 3 THEN abs(s_acctbal) + 1 END AS exposure
        FROM supplier""",
    "power": """SELECT CAST(300 + 20 * c_custkey AS DOUBLE) AS excitation, CASE WHEN c_custkey % 4 <> 1 THEN abs(c_acctbal) / 1000 + 0.5 END AS power
        FROM customer""",
    "rois": """SELECT r_name AS roi_id, r_regionkey AS ord, r_regionkey * 20 + 2 AS y0, r_regionkey * 20 + 14 AS y1,
        CAST(5 + r_regionkey * 15 AS INT) AS x0, CAST(40 + r_regionkey * 15 AS INT) AS x1 FROM region""",
    "roipx": """SELECT r_name AS roi_id, r_regionkey AS ord, r_regionkey * 4 AS y0, r_regionkey * 4 + 4 AS y1,
        CAST(r_regionkey * 5 AS INT) AS x0, CAST(r_regionkey * 5 + 5 AS INT) AS x1 FROM region""",
    "train": """SELECT p.pixel_id, p.label AS class, r.roi_id FROM pixels p JOIN roipx AS r ON p.y >= r.y0 AND p.y < r.y1 AND p.x >= r.x0 AND p.x < r.x1""",
    "grid": """SELECT o_orderkey AS pixel_id, CAST(floor(o_orderkey / 150) AS INT) AS y, CAST(o_orderkey % 150 AS INT) AS x,
        o_custkey AS ck, floor(o_orderkey / 150) % 10 < 6 AND (o_orderkey % 150) % 12 < 8 AND o_custkey % 10 <> 0 AS fg,
        CAST((floor(floor(o_orderkey / 150) / 10) + floor((o_orderkey % 150) / 12)) % 4 AS INT) AS blk FROM orders""",
    "truth": """SELECT 's' AS scan_id, pixel_id, y, x, CAST(CASE WHEN fg THEN blk ELSE -1 END AS INT) AS class FROM grid""",
    "objs8": """WITH RECURSIVE fg AS (SELECT y, x FROM grid WHERE fg), o AS (SELECT unnest([-1,-1,-1,0,0,1,1,1]) AS dy, unnest([-1,0,1,-1,1,-1,0,1]) AS dx),
        e AS (SELECT a.y * 150 + a.x AS u, b.y * 150 + b.x AS v FROM fg a, o, fg b WHERE b.y = a.y + dy AND b.x = a.x + dx),
        r AS (SELECT y * 150 + x AS s, y * 150 + x AS u FROM fg UNION SELECT r.s, e.v FROM r JOIN e ON r.u = e.u),
        m AS (SELECT u, min(s) AS root FROM r GROUP BY u)
        SELECT CAST(floor(u / 150) AS INT) AS y, CAST(u % 150 AS INT) AS x, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS object_id FROM m""",
    "objs4": """WITH RECURSIVE fg AS (SELECT y, x FROM grid WHERE fg), o AS (SELECT unnest([-1,0,0,1]) AS dy, unnest([0,-1,1,0]) AS dx),
        e AS (SELECT a.y * 150 + a.x AS u, b.y * 150 + b.x AS v FROM fg a, o, fg b WHERE b.y = a.y + dy AND b.x = a.x + dx),
        r AS (SELECT y * 150 + x AS s, y * 150 + x AS u FROM fg UNION SELECT r.s, e.v FROM r JOIN e ON r.u = e.u),
        m AS (SELECT u, min(s) AS root FROM r GROUP BY u)
        SELECT CAST(floor(u / 150) AS INT) AS y, CAST(u % 150 AS INT) AS x, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS object_id FROM m""",
    "pred": """SELECT 's' AS scan_id, pixel_id, y, x, CAST(CASE WHEN ck % 31 = 0 THEN -1
        WHEN ck % 9 = 0 THEN ((blk + 1) * 3 + 1) % 5 ELSE (blk * 3 + 1) % 5 END AS INT) AS cluster FROM grid""",
    "pred2": """SELECT 's' AS scan_id, pixel_id, y, x, CAST(CASE WHEN ck % 37 = 0 THEN -1
        WHEN ck % 5 = 0 THEN (blk + 2) % 4 ELSE blk END AS INT) AS cluster FROM grid""",
    "ct": """SELECT t.class, p.cluster, count(*) AS n FROM truth t JOIN pred p ON t.pixel_id = p.pixel_id
        WHERE t.class >= 0 AND p.cluster >= 0 GROUP BY t.class, p.cluster""",
    "lb": """SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(sup) AS BIGINT) AS sup, CAST(sum(pr) AS BIGINT) AS pr FROM (
        SELECT class AS label, CASE WHEN class = cluster THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM ct
        UNION ALL SELECT cluster, 0, 0, n FROM ct) q GROUP BY label""",
    "prf": """SELECT *, (SELECT sum(n) FROM ct) AS tot, CASE WHEN pr = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pr END AS precision,
        CASE WHEN sup = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / sup END AS recall, CASE WHEN sup + pr = 0 THEN 0.0 ELSE 2.0 * CAST(tp AS DOUBLE) / (sup + pr) END AS f1 FROM lb""",
    "results": """SELECT CASE WHEN o_orderkey = 0 THEN 'BASELINE_FULL_DATA'
        ELSE concat('mmr_', o_orderkey % 200 + 3, 'bands_', o_orderkey) END AS config_name,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'mmr' WHEN '2-HIGH' THEN 'pca' WHEN '3-MEDIUM' THEN 'variance' ELSE 'greedy' END AS method,
        CAST(o_custkey % 7 + 1 AS INT) AS perturbation_dim, CAST(o_orderkey % 200 + 3 AS INT) AS n_bands,
        CAST(o_orderkey % 200 + 3 AS INT) AS n_features, (1 - (o_orderkey % 200 + 3) / 204.0) * 100 AS data_reduction_pct,
        sqrt(o_totalprice) / 760 AS accuracy, (o_totalprice + 3 * o_custkey) / 700000 AS purity,
        o_totalprice / 650000 - 0.05 AS ari, (o_custkey * 13 % 1000) / 1000.0 AS nmi,
        CASE WHEN o_custkey % 50 = 0 THEN 'failed' END AS error FROM orders""",
    "objres": """SELECT concat('cfg_', l_linenumber * 10, 'bands') AS config_name, CAST(l_partkey % 16 AS INT) AS object_id,
        CAST(l_partkey % 16 % 4 AS INT) AS true_class, CAST(l_linenumber * 10 AS INT) AS n_bands,
        CAST(sum(l_quantity) AS BIGINT) AS num_pixels, round(avg(1 - l_discount), 9) AS accuracy
        FROM lineitem GROUP BY l_linenumber, l_partkey % 16""",
    "timings": """SELECT event_type AS stage, concat('cfg', user_id) AS config, value AS seconds,
        CAST(event_id % 40 AS INT) AS n_features FROM events""",
    "traces": """SELECT event_type AS file, 300 + value AS wavelength, value AS power FROM events""",
    "colors": """SELECT CAST(floor(p_partkey / 50) AS INT) AS y, CAST(p_partkey % 50 AS INT) AS x, CAST(p_size AS INT) AS r,
        CAST(p_partkey % 4 AS INT) AS g, CAST(0 AS INT) AS b, CAST(255 AS INT) AS a FROM part""",
    "latent": """SELECT pixel_id AS sample_id, CAST(bi AS INT) AS dim_id, value FROM (
        SELECT pixel_id, unnest(spectrum) AS value, unnest(range(len(spectrum))) AS bi FROM pixels) q""",
    "influence": """SELECT CAST(300 + 20 * l_linenumber AS DOUBLE) AS excitation, CAST(l_suppkey % 31 AS INT) AS em_idx,
        CAST(420 + 10 * (l_suppkey % 31) AS DOUBLE) AS emission, CAST((l_linenumber - 1) * 31 + l_suppkey % 31 AS INT) AS band_id,
        round(sum(l_discount * l_quantity) / 100, 6) AS influence FROM lineitem GROUP BY l_linenumber, l_suppkey % 31""",
    "recon": """SELECT CAST(l_linenumber AS INT) AS plan_id, l_orderkey AS sample_id, CAST(300 + 20 * (l_partkey % 5) AS DOUBLE) AS excitation,
        CAST(l_suppkey % 8 AS INT) AS em_idx, l_extendedprice / 100000 AS baseline,
        l_extendedprice / 100000 + (l_discount - 0.05) * (1 + l_tax) AS perturbed, l_tax < 0.08 AS valid FROM lineitem""",
    "picks": """SELECT concat('cfg', user_id % 40) AS config, CAST(300 + 20 * (event_id % 7) AS DOUBLE) AS excitation,
        CAST(420 + 10 * (floor(value) % 31) AS DOUBLE) AS emission, event_id AS ord FROM events""",
    "cvres": """SELECT c_mktsegment AS cube, CAST(c_custkey % 10 + 1 AS INT) AS k, CAST(c_nationkey % 5 AS INT) AS fold,
        avg(abs(c_acctbal)) / 12000 AS score FROM customer GROUP BY c_mktsegment, c_custkey % 10, c_nationkey % 5""",
}


class Tables:
    """Spark frames for one data folder; every property is lazy."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.lit("s").alias("scan_id"), F.col("vec_id").alias("pixel_id"),
            F.floor(F.col("vec_id") / 25).cast("int").alias("y"), (F.col("vec_id") % 25).cast("int").alias("x"),
            F.col("embedding").cast("array<double>").alias("spectrum"), "label")

    @cached_property
    def bands(self) -> DataFrame:
        b = F.col("b")
        width = self.raw("embeddings").agg(F.max(F.size("embedding")).alias("n"))
        return width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b")).select(
            b.alias("band_id"), (300 + 20 * F.floor(b / 8)).cast("double").alias("excitation"),
            (b % 8).alias("em_idx"), (420 + 10 * (b % 8)).cast("double").alias("emission"))

    @cached_property
    def longpix(self) -> DataFrame:
        b = F.col("band_id")
        return self.pixels.select("pixel_id", "y", "x", "label", F.posexplode("spectrum").alias("band_id", "value")).select(
            "pixel_id", "y", "x", "label", "band_id", (300 + 20 * F.floor(b / 8)).cast("double").alias("excitation"),
            (b % 8).alias("em_idx"), (420 + 10 * (b % 8)).cast("double").alias("emission"), "value")

    @cached_property
    def cubes(self) -> DataFrame:
        em, yy, xx = F.col("l_suppkey") % 31, F.col("l_orderkey") % 200, F.floor(F.col("l_orderkey") / 200)
        return (self.raw("lineitem")
                .groupBy("l_linenumber", em.alias("e"), yy.alias("yy"), xx.alias("xx"))
                .agg(F.avg(F.sqrt(F.col("l_extendedprice") / 1000.0)).alias("value"))
                .select(F.lit("s").alias("scan_id"), (300 + 20 * F.col("l_linenumber")).cast("double").alias("excitation"),
                        F.col("e").cast("int").alias("em_idx"), (420 + 10 * F.col("e")).cast("double").alias("emission"),
                        F.col("yy").cast("int").alias("y"), F.col("xx").cast("int").alias("x"), "value"))

    @cached_property
    def mask(self) -> DataFrame:
        return self.cubes.select("scan_id", "y", "x", ((F.col("y") * 7 + F.col("x")) % 5 != 0).alias("keep")).distinct()

    @cached_property
    def scan_bands(self) -> DataFrame:
        """The manifest of the scan: its bands, from two narrow columns."""
        i = (F.col("l_suppkey") % 31).cast("int")
        return self.raw("lineitem").select(F.lit("s").alias("scan_id"), (300 + 20 * F.col("l_linenumber")).cast("double").alias("excitation"), i.alias("em_idx"),
                                           (420 + 10 * i).cast("double").alias("emission")).distinct()

    @cached_property
    def cells(self) -> DataFrame:
        return self.cubes.withColumn("value", F.when((F.col("y") + F.col("em_idx")) % 3 != 0, F.col("value")))

    @cached_property
    def exposure(self) -> DataFrame:
        return self.raw("supplier").select(  # one scan without a known exposure
            (300 + 20 * F.col("s_suppkey")).cast("double").alias("excitation"), F.when(F.col("s_suppkey") != 3, F.abs("s_acctbal") + 1).alias("exposure"))

    @cached_property
    def power(self) -> DataFrame:
        return self.raw("customer").select(  # every fourth excitation without a measured power
            (300 + 20 * F.col("c_custkey")).cast("double").alias("excitation"), F.when(F.col("c_custkey") % 4 != 1, F.abs("c_acctbal") / 1000 + 0.5).alias("power"))

    @cached_property
    def rois(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.raw("region").select(F.col("r_name").alias("roi_id"), k.alias("ord"), (k * 20 + 2).alias("y0"),
                                         (k * 20 + 14).alias("y1"), (k * 15 + 5).alias("x0"), (k * 15 + 40).alias("x1"))

    @cached_property
    def roipx(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.raw("region").select(F.col("r_name").alias("roi_id"), k.alias("ord"), (k * 4).alias("y0"),
                                         (k * 4 + 4).alias("y1"), (k * 5).alias("x0"), (k * 5 + 5).alias("x1"))

    @cached_property
    def train(self) -> DataFrame:
        from specband.operators.compare import rect_join

        return rect_join(self.pixels, self.roipx).select("pixel_id", "y", "x", "spectrum", F.col("label").alias("class"), "roi_id")

    @cached_property
    def grid(self) -> DataFrame:
        k = F.col("o_orderkey")
        yy, xx = F.floor(k / 150), k % 150
        return self.raw("orders").select(
            k.alias("pixel_id"), yy.cast("int").alias("y"), xx.cast("int").alias("x"), F.col("o_custkey").alias("ck"),
            ((yy % 10 < 6) & (xx % 12 < 8) & (F.col("o_custkey") % 10 != 0)).alias("fg"),
            ((F.floor(yy / 10) + F.floor(xx / 12)) % 4).cast("int").alias("blk"))

    @cached_property
    def truth(self) -> DataFrame:
        return self.grid.select(F.lit("s").alias("scan_id"), "pixel_id", "y", "x",
                                F.when(F.col("fg"), F.col("blk")).otherwise(-1).alias("class"))

    @cached_property
    def pred(self) -> DataFrame:
        ck, blk = F.col("ck"), F.col("blk")
        return self.grid.select(F.lit("s").alias("scan_id"), "pixel_id", "y", "x",
                                F.when(ck % 31 == 0, -1).when(ck % 9 == 0, ((blk + 1) * 3 + 1) % 5)
                                .otherwise((blk * 3 + 1) % 5).alias("cluster"))

    @cached_property
    def pred2(self) -> DataFrame:
        ck, blk = F.col("ck"), F.col("blk")
        return self.grid.select(F.lit("s").alias("scan_id"), "pixel_id", "y", "x",
                                F.when(ck % 37 == 0, -1).when(ck % 5 == 0, (blk + 2) % 4).otherwise(blk).alias("cluster"))

    @cached_property
    def results(self) -> DataFrame:
        k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
        nb = (k % 200 + 3).cast("int")
        pr = F.col("o_orderpriority")
        return self.raw("orders").select(
            F.when(k == 0, "BASELINE_FULL_DATA").otherwise(F.concat(F.lit("mmr_"), nb, F.lit("bands_"), k)).alias("config_name"),
            F.when(pr == "1-URGENT", "mmr").when(pr == "2-HIGH", "pca").when(pr == "3-MEDIUM", "variance").otherwise("greedy").alias("method"),
            (c % 7 + 1).cast("int").alias("perturbation_dim"), nb.alias("n_bands"), nb.alias("n_features"),
            ((1 - nb / 204.0) * 100).alias("data_reduction_pct"), (F.sqrt(p) / 760).alias("accuracy"),
            ((p + 3 * c) / 700000).alias("purity"), (p / 650000 - 0.05).alias("ari"), (c * 13 % 1000 / 1000.0).alias("nmi"),
            F.when(c % 50 == 0, "failed").alias("error"))

    @cached_property
    def objres(self) -> DataFrame:
        return (self.raw("lineitem").groupBy("l_linenumber", (F.col("l_partkey") % 16).cast("int").alias("object_id"))
                .agg(F.sum("l_quantity").cast("bigint").alias("num_pixels"), F.round(F.avg(1 - F.col("l_discount")), 9).alias("accuracy"))
                .select(F.concat(F.lit("cfg_"), F.col("l_linenumber") * 10, F.lit("bands")).alias("config_name"), "object_id",
                        (F.col("object_id") % 4).alias("true_class"), (F.col("l_linenumber") * 10).alias("n_bands"),
                        "num_pixels", "accuracy"))

    @cached_property
    def timings(self) -> DataFrame:
        return self.raw("events").select(F.col("event_type").alias("stage"), F.concat(F.lit("cfg"), "user_id").alias("config"),
                                         F.col("value").alias("seconds"), (F.col("event_id") % 40).cast("int").alias("n_features"))

    @cached_property
    def traces(self) -> DataFrame:
        return self.raw("events").select(F.col("event_type").alias("file"), (300 + F.col("value")).alias("wavelength"),
                                         F.col("value").alias("power"))

    @cached_property
    def colors(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(F.floor(k / 50).cast("int").alias("y"), (k % 50).cast("int").alias("x"),
                                       F.col("p_size").cast("int").alias("r"), (k % 4).cast("int").alias("g"),
                                       F.lit(0).alias("b"), F.lit(255).alias("a"))

    @cached_property
    def latent(self) -> DataFrame:
        return self.pixels.select(F.col("pixel_id").alias("sample_id"), F.posexplode("spectrum").alias("dim_id", "value"))

    @cached_property
    def influence(self) -> DataFrame:
        e = F.col("l_suppkey") % 31
        return (self.raw("lineitem").groupBy("l_linenumber", e.alias("e"))
                .agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / 100, 6).alias("influence"))
                .select((300 + 20 * F.col("l_linenumber")).cast("double").alias("excitation"), F.col("e").cast("int").alias("em_idx"),
                        (420 + 10 * F.col("e")).cast("double").alias("emission"),
                        ((F.col("l_linenumber") - 1) * 31 + F.col("e")).cast("int").alias("band_id"), "influence"))

    @cached_property
    def recon(self) -> DataFrame:
        v = F.col("l_extendedprice") / 100000
        return self.raw("lineitem").select(
            F.col("l_linenumber").cast("int").alias("plan_id"), F.col("l_orderkey").alias("sample_id"),
            (300 + 20 * (F.col("l_partkey") % 5)).cast("double").alias("excitation"), (F.col("l_suppkey") % 8).cast("int").alias("em_idx"),
            v.alias("baseline"), (v + (F.col("l_discount") - 0.05) * (1 + F.col("l_tax"))).alias("perturbed"),
            (F.col("l_tax") < 0.08).alias("valid"))

    @cached_property
    def picks(self) -> DataFrame:
        k = F.col("event_id")
        return self.raw("events").select(F.concat(F.lit("cfg"), F.col("user_id") % 40).alias("config"),
                                         (300 + 20 * (k % 7)).cast("double").alias("excitation"),
                                         (420 + 10 * (F.floor("value") % 31)).cast("double").alias("emission"), k.alias("ord"))

    @cached_property
    def cvres(self) -> DataFrame:
        return (self.raw("customer").groupBy(F.col("c_mktsegment").alias("cube"), (F.col("c_custkey") % 10 + 1).cast("int").alias("k"),
                                             (F.col("c_nationkey") % 5).cast("int").alias("fold"))
                .agg((F.avg(F.abs("c_acctbal")) / 12000).alias("score")))
