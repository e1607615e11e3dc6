"""Connected components of links between row keys, for the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specband.functions.scale import cut


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node tells its larger (or its not larger) neighbours the smallest node it sees.

    The minimum of a node combines in the tasks; the join that brings it back has one row per node on one side, so a
    node with very many neighbours can be split by adaptive execution.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    near = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(high.alias("u"), low.alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    told = near.join(least, F.col("u") == F.col("c"))
    if large:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v``: root is the smallest node that links reach.

    Large-star and small-star steps alternate until every component is a star; edges never grow in number by more than the nodes.
    Loops are ignored; no edges, no rows.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    while True:
        nxt = cut(stars(cut(stars(edges, True)), False))
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, nxt)]
        edges = nxt
        if same[0] == same[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
