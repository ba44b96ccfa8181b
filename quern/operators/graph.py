"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.durable import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph: (node, component), component being its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    links nodes to the smallest neighbour, so the number of rounds grows with
    the logarithm of the diameter and no adjacency list is ever gathered; the
    minima are pre-aggregated before the shuffle. Null ends and self loops are
    left out; nodes without an edge do not appear; an empty input gives an
    empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = materialize(small.select("x.*").where("u <> v").distinct())
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
