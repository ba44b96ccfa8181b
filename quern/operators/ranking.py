"""Ranking, quotas, apportionment and deterministic samples."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle (window group limit)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def proportional_sample(df: DataFrame, stratum: str, count: int, seed: int, salt: str, identity: list[str]) -> DataFrame:
    """``count`` rows shared over the strata by largest remainders; within one by a hash of seed, salt, stratum and identity."""
    quota = largest_remainder(df.groupBy(stratum).agg(F.count("*").alias("_n")), stratum, "_n", count)
    draw = F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.concat(F.lit(f"{salt}:"), F.col(stratum)), *[F.col(c).cast("string") for c in identity]), 256)
    x = df.join(quota.select(stratum, "seats"), stratum).withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(draw)))
    return x.where(F.col("_place") <= F.col("seats")).drop("seats", "_place")


def hash_share(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 64 bits of a hash of seed and parts; rows below p are nested in those below a larger p."""
    h = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 16)
    return F.conv(h, 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551616.0


def largest_remainder(counts: DataFrame, key: str, n: str, seats: int) -> DataFrame:
    """Hamilton apportionment of seats over a table of counts, left-over seats to the largest fractions, ties to the smaller key."""
    total = counts.agg(F.sum(n).alias("_total"))
    x = counts.join(F.broadcast(total)).withColumns({"floor": F.floor(F.col(n) * seats / F.col("_total")), "fraction": F.col(n) * seats % F.col("_total")})
    left = F.lit(seats) - F.sum("floor").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("fraction"), key))
    return x.select(key, n, (F.col("floor") + (place <= left).cast("int")).alias("seats"))


def round_robin(df: DataFrame, lane: str, *order: Column) -> DataFrame:
    """Rows interleaved over lanes: the first of each lane, then the second of each, and so on."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy(*order)))


def cost_balanced_batches(df: DataFrame, cost: str, identity: str, workers: int, size: int = 7) -> DataFrame:
    """Adds batch and worker: rows by falling cost, ``size`` to a batch, each batch to the worker with the least load so far.

    Rows of one cost are ordered by ``identity`` as text, workers of one load
    by number. A row's place is that within its cost and the number of dearer
    rows, so no window spans the table; only the batches' sums pass through
    one task, as a stream. A null cost counts as 0.
    """
    if workers < 1 or size < 1:
        raise ValueError("workers and size must be positive")
    x = df.withColumn("_cost", F.coalesce(F.col(cost), F.lit(0)))
    dearer = x.groupBy("_cost").agg(F.count("*").alias("_n"))
    dearer = dearer.select("_cost", (F.sum("_n").over(Window.orderBy(F.desc("_cost"))) - F.col("_n")).alias("_dearer"))
    place = F.row_number().over(Window.partitionBy("_cost").orderBy(F.col(identity).cast("string")))
    x = x.withColumn("_place", place).join(dearer, "_cost").withColumn("batch", F.floor((F.col("_dearer") + F.col("_place") - 1) / size).cast("long"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(0, w) for w in range(workers)]
        for b in batches:
            given = []
            for load in b.load.tolist():
                least, w = heap[0]
                heapq.heapreplace(heap, (least + load, w))
                given.append(w)
            yield pd.DataFrame({"batch": b.batch, "worker": given})

    sums = x.groupBy("batch").agg(F.sum("_cost").alias("load")).repartition(1).sortWithinPartitions("batch")
    return x.join(sums.mapInPandas(assign, "batch long, worker long"), "batch").drop("_cost", "_place", "_dearer")
