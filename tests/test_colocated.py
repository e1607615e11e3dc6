"""Pixel tables that are joined bucket by bucket."""

import re

import pytest
from pyspark.sql import functions as F

from specband.operators import compare as cmp, objects as ob
from specband.sources import io


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("scan_id"), (F.col("id") / 60).cast("int").alias("y"), (F.col("id") % 60).cast("int").alias("x"), "id")
    plain = {"truth": base.withColumn("class", (F.col("id") % 4).cast("int")), "pred": base.withColumn("cluster", (F.col("id") % 5 - 1).cast("int")),
             "things": base.withColumn("object_id", (F.col("y") / 10).cast("int"))}
    plain = {k: v.drop("id") for k, v in plain.items()}
    folder = tmp_path_factory.mktemp("bucketed")
    return plain, {k: io.write_colocated(v, f"bucketed_{k}", str(folder / k), 6) for k, v in plain.items()}, folder


def pixel_moves(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"Exchange hashpartitioning\(scan_id#\d+, y#\d+, x#\d+", plan))


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_contingency_moves_no_pixel(tables):
    plain, stored, _ = tables
    far, near = (cmp.contingency(t["pred"], t["truth"]) for t in (plain, stored))
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect())) and pixel_moves(far) == 2 and pixel_moves(near) == 0


def test_object_scores_move_no_pixel(tables):
    plain, stored, _ = tables
    def scored(t):
        joined = t["things"].join(t["truth"], ["scan_id", "y", "x"]).join(t["pred"], ["scan_id", "y", "x"]).where("cluster >= 0")
        return ob.object_metrics(joined.groupBy("scan_id", "object_id", "class", "cluster").agg(F.count("*").alias("n")))
    far, near = scored(plain), scored(stored)
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect())) and pixel_moves(near) == 0


def test_a_new_session_reads_the_layout(spark, tables):
    plain, _, folder = tables
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = {k: io.read_colocated(other, f"again_{k}", str(folder / k), 6) for k in ("truth", "pred")}
    near = cmp.contingency(t["pred"], t["truth"])
    assert pixel_moves(near) == 0 and sorted(map(tuple, near.collect())) == sorted(map(tuple, cmp.contingency(plain["pred"], plain["truth"]).collect()))
