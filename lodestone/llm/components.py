"""Connected components of an edge table as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut


def _stars(edges: DataFrame, large: bool, salts: int) -> DataFrame:
    """One contraction. edges: (u, v) with u > v. The rows of a hub are dealt out by a salt on their other end."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(back) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = near.withColumn("s", F.pmod(F.hash("v"), F.lit(salts)))
    met = near.join(least, ["u", "s"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """(node, component) of every node of an edge table (u, v) of integers; the component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges no longer change; every round is a written table. Self
    loops, repeated edges and either direction are allowed, null ends are ignored; no edges give an empty result.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if not row[0] or tuple(row) == mark:
            break
        mark = tuple(row)
        now = cut(_stars(_stars(now, True, salts), False, salts))
    ends = now.groupBy("u").agg(F.min("v").alias("v"))
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
