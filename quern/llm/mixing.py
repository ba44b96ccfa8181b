"""Problem 8: mixing sources to target weights.

Sainte-Lague apportionment. The mixture's size is the largest for which every
source can hold its share with its texts used at most max_repeats times, or
the size asked for. It is cut into blocks of BLOCK tokens, which go to sources
by the highest quotients share / (2k + 1), no source beyond its capacity, and
a source's blocks to its shards likewise, by their tokens. Each shard of a
source then takes whole texts in a seeded order up to its quota and the one
whose length is nearest to what is still open, after all of them once for each
time the quota holds the whole shard.

Only one number per source reaches the driver; shards hold SHARD texts on
average, and one task apportions a source's seats over the sums of its shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.records import label
from quern.llm.tokens import token_counts
from quern.plans.durable import materialize

BLOCK, SHARD, MOST_SOURCES = 1024, 50_000, 1000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats per weight by highest quotients weight / (2k + 1), ties to the first, none beyond its cap.

    A bisection finds a quotient that fewer seats than asked for reach or
    pass; those are given at once, the few that are left one by one.
    """
    w, cap = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def reached(q: float) -> np.ndarray:
        return np.minimum(np.floor((w / q + 1) / 2), cap).astype(np.int64)

    high = float(w.max()) * 2
    low = high / 2
    while reached(low).sum() < seats:
        low /= 4
    for _ in range(100):
        mid = (low * high) ** 0.5
        low, high = (low, mid) if reached(mid).sum() < seats else (mid, high)
    given = reached(high * (1 + 1e-9))
    todo = [(-w[i] / (2 * given[i] + 1), i) for i in range(len(w)) if given[i] < cap[i]]
    heapq.heapify(todo)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(todo)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(todo, (-w[i] / (2 * given[i] + 1), i))
    return given.tolist()


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of the mixture, and per target its share wanted and reached.

    Sources are compared in one spelling; documents of other or no sources,
    without text or without tokens are left out. A target without documents
    takes no part in the size and is reported with 0; targets without a
    source, or with no share, are left out; max_repeats null counts as 1. More
    than most_sources targets are refused, as the driver holds them.
    """
    spark = documents.sparkSession
    t = targets.select(label(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("repeats")).where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("repeats").alias("repeats"))
    wanted = t.orderBy("source").limit(most_sources + 1).collect()
    if len(wanted) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    names = [r.source for r in wanted]
    sizes = token_counts(documents).where("tokens > 0").withColumn("source", label(F.col("source"))).where(F.col("source").isin(names) if names else F.lit(False))
    sizes = materialize(sizes)
    shards = max(1, -(-sizes.count() // SHARD))
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
    cells = materialize(sizes.groupBy("source", "shard").agg(F.sum("tokens").alias("size")))
    have = dict.fromkeys(names, 0) | {r.source: r.n for r in cells.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    present = [r for r in wanted if have[r.source]]
    if total_tokens is None:
        total_tokens = int(min((have[r.source] * r.repeats / r.share for r in present), default=0) * sum(r.share for r in present))
    block = max(1, min(BLOCK, total_tokens // 1000))
    caps = [have[r.source] * r.repeats // block for r in present]
    seats = {r.source: (n, r.repeats) for r, n in zip(present, sainte_lague([r.share for r in present], total_tokens // block, caps))}

    def shares(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("shard")
        n, repeats = seats.get(x.source.iloc[0], (0, 1))
        given = sainte_lague(x["size"].tolist(), n, (x["size"] * repeats // block).tolist())
        return x.assign(quota=np.array(given, dtype=np.int64) * block)

    q = cells.groupBy("source").applyInPandas(shares, "source string, shard long, size long, quota long")
    x = sizes.join(q, ["source", "shard"])
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"whole": F.floor(F.col("quota") / F.col("size")), "upto": F.sum("tokens").over(seeded)})
    x = x.withColumn("rest", F.col("quota") - F.col("whole") * F.col("size"))
    x = x.withColumn("taken", F.col("upto") <= F.col("rest"))
    # the text nearest to what is still open closes the quota
    cell = Window.partitionBy("source", "shard")
    x = x.withColumn("open", F.col("rest") - F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))).over(cell), F.lit(0)))
    x = x.withColumn("off", F.when(~F.col("taken"), F.abs(F.col("tokens") - F.col("open"))))
    nearest = F.row_number().over(cell.orderBy(F.asc_nulls_last("off"), "doc_id")) == 1
    x = x.withColumn("last", nearest & (F.col("off") < F.col("open")))
    again = F.coalesce(F.col("taken") | F.col("last"), F.lit(False))
    picked = materialize(x.select("doc_id", "source", "tokens", (F.col("whole") + again.cast("int")).cast("int").alias("copies")).where("copies > 0"))
    got = picked.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    every = Window.partitionBy(F.lit(1))
    report = t.join(got, "source", "left").select("source", F.col("share").alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "repeats")
    report = report.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)))
    return picked, report


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the share wanted and the share reached."""
    return _mixture(spark, d)[1]
