"""Problem 3: sample matching target category proportions.

A plan's strata are conditions on task and source (null: any). Rows are
counted by the set of strata that they match; only these counts, one per
occurring set, reach the driver. There floors and shortages are fixed (a
stratum gets its share of the sample, at least min_rows and at most its rows)
and the inclusion probabilities are calibrated on the exponential-tilting
dual: probability = base * exp(sum of the multipliers of the row's strata),
the multipliers found by Newton iterations on the weighted moments.

The sample is drawn by the pivotal method: two units with probabilities
between 0 and 1 meet and one of them is decided, until one is left. Blocks of
BLOCK rows of equal strata play their rounds apart and send their last
undecided unit to the next level, so no task sees more than a block and the
size of every stratum's sample is within one of its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.records import label
from quern.plans.durable import materialize

#: Share of the rows that a sample takes unless its size is given; rows of a block; strata of all plans.
SHARE, BLOCK, MOST_STRATA = 0.1, 2_000, 2_000
#: Bound of a multiplier on the dual.
BOUND = 60.0


def calibrate(counts: np.ndarray, member: np.ndarray, targets: np.ndarray, base: float) -> np.ndarray:
    """Probabilities per cell, at most 1, so that member.T @ (counts * p) meets targets where any such do.

    Newton on the convex dual of the bounded problem: a cell's probability is
    base * exp(sum of its multipliers), or 1 where that is more, and a cell at
    1 takes no part in the step. Steps are halved until the dual falls; where
    no probabilities meet the targets, the multipliers stop at +-BOUND.
    """
    lam, top = np.zeros(member.shape[1]), -np.log(base) if base > 0 else 0.0

    def dual(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        x = member @ v
        p = base * np.exp(np.minimum(x, top))
        return float(counts @ np.where(x < top, p, 1 + x - top) - targets @ v), p, x < top

    value, p, free = dual(lam)
    for _ in range(500):
        gap = member.T @ (counts * p) - targets
        if np.abs(gap).max(initial=0) < 1e-9 * max(1.0, targets.sum()):
            break
        curve = member.T @ (member * (counts * p * free)[:, None])
        step = np.linalg.lstsq(curve + 1e-9 * (1 + np.trace(curve)) * np.eye(len(lam)), gap, rcond=None)[0]
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        scale = 1.0
        while scale > 1e-9:
            at = np.clip(lam - scale * step, -BOUND, BOUND)
            new = dual(at)
            if new[0] < value:
                break
            scale /= 2
        else:
            break
        lam, (value, p, free) = at, new
    return np.minimum(1.0, p)


def fixed_targets(share: np.ndarray, least: np.ndarray, have: np.ndarray, size: float) -> np.ndarray:
    """Rows per stratum: proportional to share, within floor and availability, summing to size where possible."""
    lo, hi = np.minimum(least, have), have

    def rows(x: float) -> np.ndarray:
        return np.clip(share * x, lo, hi)

    a, b = 0.0, max(size, 1.0)
    while rows(b).sum() < size and b < 1e18:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if rows(mid).sum() < size else (a, mid)
    return rows(b)


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Decided probabilities (0 or 1) and the place of the one unit left between them, or -1."""
    p = p.copy()
    now = -1
    for i in range(len(p)):
        if p[i] <= 0 or p[i] >= 1:
            continue
        if now < 0:
            now = i
            continue
        a, b, u = p[now], p[i], draws[i]
        if a + b < 1 - 1e-12:
            if u * (a + b) < b:
                p[now], p[i], now = 0.0, a + b, i
            else:
                p[now], p[i] = a + b, 0.0
        else:
            if u * (2 - a - b) < 1 - b:
                p[now], p[i] = 1.0, a + b - 1
                now = i
            else:
                p[now], p[i] = a + b - 1, 1.0
            if p[now] <= 1e-12:
                p[now], now = 0.0, -1
            elif p[now] >= 1 - 1e-12:
                p[now], now = 1.0, -1
    return p, now


def draw(units: DataFrame, seed: int) -> DataFrame:
    """(plan, cell, id) of the drawn units of (plan, cell, id, p)."""
    schema = "plan string, cell string, id long, p double, done boolean"

    def play(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["rank", "id"], kind="stable")
        rng = np.random.default_rng(abs(int(x["rank"].iloc[0])) % (1 << 63) + seed)
        p, left = pivotal(x.p.to_numpy(), rng.random(len(x)))
        done = np.ones(len(x), dtype=bool)
        if left >= 0:
            done[left] = False
        keep = ~done | (p >= 1)
        return x.loc[keep, ["plan", "cell", "id"]].assign(p=p[keep], done=done[keep])

    drawn, level = None, 0
    while True:
        level += 1
        units = units.withColumn("rank", F.xxhash64("plan", "cell", "id", F.lit(seed + level)))
        sizes = units.groupBy("plan", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        most = sizes.agg(F.max("blocks")).first()[0] or 1
        units = units.join(sizes, ["plan", "cell"]).withColumn("block", F.pmod(F.xxhash64("rank"), F.col("blocks")))
        x = materialize(units.groupBy("plan", "cell", "block").applyInPandas(play, schema))
        won = x.where("done").select("plan", "cell", "id")
        drawn = won if drawn is None else drawn.union(won)
        units = x.where("not done").select("plan", "cell", "id", "p")
        if most <= 1:
            break
    # the last unit of a cell is drawn with what is left of its probability
    last = units.where(F.pmod(F.xxhash64("plan", "cell", "id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000 < F.col("p"))
    return drawn.union(last.select("plan", "cell", "id"))


def calibrated_sample(records: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 17, most_strata: int = MOST_STRATA) -> tuple[DataFrame, DataFrame]:
    """(plan_name, record_id) of each plan's sample, and the report of its strata.

    The report has plan_name, task, source, target_share, min_rows, available,
    target_rows, sampled, actual_share and status, told from the rows sampled:
    met (its share or, if that is more, min_rows), floor (min_rows, which is
    more than its share), short (fewer), over (more, as others fell short) or
    absent (no rows). Rows that match no
    stratum of a plan are not drawn for it. Task and source are compared in
    one spelling; null ids are left out; strata without a share, or with
    neither task nor source, are left out; an empty table gives empty samples
    and a report of absences. Sizes default to SHARE of the rows. More than
    most_strata strata are refused, as the driver holds them.
    """
    spark = records.sparkSession
    t = targets.where("plan_name is not null and target_share is not null").select("plan_name", label(F.col("task")).alias("task"), label(F.col("source")).alias("source"), "target_share", F.coalesce("min_rows", F.lit(0)).alias("min_rows")).where("task is not null or source is not null")
    strata = t.orderBy("plan_name", "task", "source").limit(most_strata + 1).collect()
    if len(strata) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    rows = records.where("record_id is not null").select(F.col("record_id").alias("id"), label(F.col("task")).alias("task"), label(F.col("source")).alias("source"))
    plans = sorted({s.plan_name for s in strata})

    def matches(s) -> Column:
        c = F.lit(True)
        for f in ("task", "source"):
            if s[f] is not None:
                c = c & F.coalesce(F.col(f) == s[f], F.lit(False))
        return c

    cells = [F.struct(F.lit(name).alias("plan"), F.concat_ws(",", *[F.when(matches(s), F.lit(str(i))) for i, s in enumerate(strata) if s.plan_name == name]).alias("cell")) for name in plans]
    if not cells:
        empty = rows.where("false").select(F.lit("").alias("plan_name"), F.col("id").alias("record_id"))
        return empty, t.limit(0)
    members = materialize(rows.select("id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*").where("cell <> ''"))
    total = rows.count()
    counts = {(r.plan, r.cell): r.n for r in members.groupBy("plan", "cell").agg(F.count("*").alias("n")).collect()}
    probability, wanted = [], {}
    for name in plans:
        own = [i for i, s in enumerate(strata) if s.plan_name == name]
        keys = sorted(c for p, c in counts if p == name)
        n = np.array([counts[name, c] for c in keys], dtype=float)
        member = np.array([[float(str(i) in c.split(",")) for i in own] for c in keys]).reshape(len(keys), len(own))
        have = member.T @ n
        share = np.array([strata[i].target_share for i in own])
        aim = fixed_targets(share, np.array([strata[i].min_rows for i in own], dtype=float), have, size or round(SHARE * total))
        wanted.update({i: (int(h), float(a)) for i, h, a in zip(own, have, aim)})
        p = calibrate(n, member, aim, min(1.0, (size or SHARE * total) / max(total, 1))) if len(keys) else []
        probability += [(name, c, float(x)) for c, x in zip(keys, p)]
    probs = spark.createDataFrame(probability, "plan string, cell string, p double")
    drawn = materialize(draw(members.join(probs, ["plan", "cell"]), seed))
    got: dict[int, int] = {}
    sizes: dict[str, int] = {}
    for r in drawn.groupBy("plan", "cell").agg(F.count("*").alias("n")).collect():
        sizes[r.plan] = sizes.get(r.plan, 0) + r.n
        for i in r.cell.split(","):
            got[int(i)] = got.get(int(i), 0) + r.n
    out = []
    for i, s in enumerate(strata):
        have, aim = wanted[i]
        fair = s.target_share * (size or round(SHARE * total))
        drawn_here, due = got.get(i, 0), max(fair, s.min_rows)
        status = "absent" if not have else "short" if drawn_here < due - 1 else "over" if drawn_here > due + max(1, 0.01 * due) else "floor" if s.min_rows > fair + 1 else "met"
        out.append((s.plan_name, s.task, s.source, float(s.target_share), int(s.min_rows), have, aim, got.get(i, 0), got.get(i, 0) / max(sizes.get(s.plan_name, 0), 1), status))
    report = spark.createDataFrame(out, "plan_name string, task string, source string, target_share double, min_rows int, available long, target_rows double, sampled long, actual_share double, status string")
    return drawn.select(F.col("plan").alias("plan_name"), F.col("id").alias("record_id")), report


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return calibrated_sample(spark.read.parquet(f"{d}/sft_records.parquet"), spark.read.parquet(f"{d}/sample_targets.parquet"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The record ids of each plan's sample."""
    return _sample(spark, d)[0]


def p3_strata(spark: SparkSession, d: str) -> DataFrame:
    """Per stratum: rows available, wanted and drawn, shares, and whether the target was met."""
    return _sample(spark, d)[1]
