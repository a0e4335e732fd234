"""Connected components of an edge table by alternating large and small stars.

Edges stay in Spark; each round is written to the shared folder, which cuts the lineage. A hub of any size is
only an aggregation with partial sums and a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v; every node's larger (or smaller) neighbours move to its least neighbour."""
    if large:
        around = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
    else:
        around = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = around.groupBy("x").agg(F.min("y").alias("m"))
    least = least.select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    moved = around.join(least, around["x"] == least["k"])
    if large:
        out = moved.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        out = moved.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node and label (the least node of its component) of every node that has an edge to another."""
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(ends.where("u <> v").distinct(), "edges")
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(sign).first()[0]
    while before[0]:
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        after = now.agg(sign).first()[0]
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
