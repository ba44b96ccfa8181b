"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows and their percentage per value; null counts as unknown. The total is of the few groups, not of the rows."""
    counts = df.groupBy(F.coalesce(key, F.lit("unknown")).alias(name)).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.join(F.broadcast(total)).select(name, "rows", F.round(F.col("rows") * 100.0 / F.col("total"), 4).alias("percent"))


def group_rewards(df: DataFrame, group: str, reward: str, accept: float) -> DataFrame:
    """Per group: rollouts, accepted, mean, population deviation, extremes, whether mixed, all or none are accepted."""
    ok = F.count_if(F.col(reward) >= accept)
    return df.groupBy(group).agg(
        F.count("*").alias("rollouts"), ok.alias("accepted"), F.round(F.avg(reward), 6).alias("mean"), F.round(F.stddev_pop(reward), 6).alias("deviation"),
        F.min(reward).alias("lowest"), F.max(reward).alias("highest"),
        F.when(ok == 0, "none").when(ok == F.count("*"), "all").otherwise("mixed").alias("kind"),
    )


def group_policy(df: DataFrame, group: str, accepted: Column, quality: Column, size: int, signal: Column | None = None) -> DataFrame:
    """Adds reward and policy to every rollout of a group.

    A group of ``size`` rollouts gives 0 if none is accepted and 1 if all are;
    any other group gives (size * accepted + policy quality) / (size + 1), the
    policy quality being (signal + 1) / 2 with the signal in [-1, 1], by
    default 2 * quality - 1. The group's counts are aggregated first and joined
    back, so that a group of any size is never sorted or gathered.
    """
    ok = F.coalesce(accepted, F.lit(False))
    per = df.groupBy(group).agg(F.count("*").alias("_n"), F.count_if(ok).alias("_k"))
    x = df.join(per, group)
    s = F.coalesce(signal if signal is not None else 2 * quality - 1, F.lit(-1.0))
    mixed = (size * ok.cast("int") + 0.5 * (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)) + 1)) / (size + 1.0)
    full = F.col("_n") == size
    none, every = full & (F.col("_k") == 0), full & (F.col("_k") == size)
    lane = F.when(full, "mixed_criterion_normalized" if signal is not None else "mixed_quality_fallback").otherwise("incomplete_group_quality_fallback")
    return x.select(*df.columns, F.when(none, 0.0).when(every, 1.0).otherwise(mixed).alias("reward"), F.when(none, "all_rejected_zero").when(every, "all_accepted_one").otherwise(lane).alias("policy"))


def bundle_counts(facts: DataFrame, bundle: str) -> DataFrame:
    """Facts of each bundle, its distinct periods and entities, facts from pictures and distinct modes."""
    n = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return facts.groupBy(bundle).agg(F.count("*").alias("required"), n("period").alias("periods"), n("entity").alias("entities"), F.count_if(F.col("source_mode") == "image").alias("visuals"), F.count_distinct(F.coalesce("source_mode", F.lit(""))).alias("modes"))


def difficulty(required: Column, distractors: Column, documents: Column, periods: Column, entities: Column, visuals: Column, modes: Column, edge_types: Column) -> list[Column]:
    """score and label (hard from 8.5, medium from 5.5) of a bundle from its eight counts."""
    beyond = lambda c: F.greatest(F.lit(0), c - 1)
    score = required * 0.8 + distractors * 0.45 + documents * 0.8 + beyond(periods) * 0.8 + beyond(entities) * 0.8 + visuals * 0.4 + F.when(modes > 1, 1.5).otherwise(0.0) + edge_types * 0.25
    score = F.round(score, 2)
    return [score.alias("score"), F.when(score >= 8.5, "hard").when(score >= 5.5, "medium").otherwise("easy").alias("label")]


def confidence_route(candidate: Column) -> list[Column]:
    """score and route (trusted from 0.9, recheck from 0.75, else quarantine) of a fact; candidate: a rule found it, too."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    seen = (F.col("source_mode") == "image") & (F.coalesce(F.size("images"), F.lit(0)) > 0)
    score = F.when(candidate, 0.35).otherwise(0.1) + F.when(has("numeric_value"), 0.25).otherwise(0.1) + add(has("period"), 0.15) + add(has("metric"), 0.1) + add(seen, 0.1) + add(has("scope"), 0.05)
    score = F.round(F.least(F.lit(1.0), score), 3)
    return [score.alias("score"), F.when(score >= 0.9, "trusted").when(score >= 0.75, "recheck").otherwise("quarantine").alias("route")]


def advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(reward - group mean) / population deviation of all rows, 0 where the deviation is 0."""
    per = df.groupBy(group).agg(F.avg(reward).alias("_mean"))
    all_rows = df.agg(F.stddev_pop(reward).alias("_std"))
    x = df.join(per, group).join(F.broadcast(all_rows))
    return x.select(*df.columns, F.round(F.when(F.col("_std") > 0, (F.col(reward) - F.col("_mean")) / F.col("_std")).otherwise(0.0), 6).alias("advantage"))


def planned_and_actual(planned: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Full outer difference of two tables (key, n), missing sides as 0."""
    p, a = planned.withColumnRenamed("n", "planned"), actual.withColumnRenamed("n", "actual")
    x = p.join(a, key, "full_outer").fillna(0, ["planned", "actual"])
    return x.withColumn("difference", F.col("actual") - F.col("planned"))
