"""Joins, deduplication and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decontaminated(df: DataFrame, key: Column, held: DataFrame, held_key: Column) -> DataFrame:
    """Rows whose key is not among the held-out keys; null keys stay."""
    keys = held.select(held_key.alias("_held")).where("_held is not null").distinct()
    return df.withColumn("_key", key).join(keys, F.col("_key") == F.col("_held"), "left_anti").drop("_key")


def merged_copies(df: DataFrame, key: Column, order: str, label: Column) -> DataFrame:
    """One row per key: the first id, the number of rows and the sorted distinct labels of all copies."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.array_sort(F.collect_set(label)).alias("labels"))


def neighbours(df: DataFrame, group: list[str], key: str, reach: int) -> DataFrame:
    """Edges of each item to the next ``reach`` items of its group, by window leads instead of a self-join."""
    w = Window.partitionBy(*group).orderBy(key)
    x = df.select(F.col(key).alias("a"), *[F.lead(key, i).over(w).alias(f"_b{i}") for i in range(1, reach + 1)])
    ahead = F.array(*[F.struct(F.col(f"_b{i}").alias("b"), F.lit(i).alias("distance")) for i in range(1, reach + 1)])
    return x.select("a", F.explode(ahead).alias("e")).select("a", "e.b", "e.distance").where("b is not null")


def evidence_edges(facts: DataFrame, reach: int = 6) -> DataFrame:
    """(a, b, edge_type, weight): each fact with the next ``reach`` of its groups by fact_id, both ways.

    Five groupings: document, entity and period, entity and metric over
    periods, topic within an entity or document, unit across source modes. A
    null text equals an empty one; an empty one forms no group, except as unit.
    """
    names = ["document_id", "page", "entity", "period", "metric", "topic", "unit_id", "source_mode"]
    f = facts.select(F.col("fact_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in names])
    c = F.col
    lane = lambda kind, here, *keys: F.when(here, F.struct(F.lit(kind).alias("edge_type"), F.array(*keys).alias("group")))
    lanes = F.array_compact(F.array(
        lane("same_document", c("document_id") != "", c("document_id")),
        lane("same_entity_period", (c("entity") != "") & (c("period") != ""), c("entity"), c("period")),
        lane("same_metric_cross_period", (c("entity") != "") & (c("metric") != ""), c("entity"), c("metric")),
        lane("same_topic", c("topic") != "", c("topic")),
        lane("cross_modal_same_unit", F.lit(True), c("unit_id")),
    ))
    x = f.withColumn("_lane", F.explode(lanes)).select("_lane.*", F.struct("fact_id", *names).alias("x"))
    w = Window.partitionBy("edge_type", "group").orderBy("x.fact_id")
    x = x.withColumn("_ahead", F.array_compact(F.array(*[F.lead("x", i).over(w) for i in range(1, reach + 1)]))).select("edge_type", "x", F.explode("_ahead").alias("y"))
    same = lambda n: c(f"x.{n}") == c(f"y.{n}")
    weight = (
        F.when(c("edge_type") == "same_document", F.when(same("page") & (c("x.page") != ""), 3.0).otherwise(2.2))
        .when(c("edge_type") == "same_entity_period", 3.4)
        .when((c("edge_type") == "same_metric_cross_period") & (c("x.period") != "") & (c("y.period") != "") & ~same("period"), 4.0)
        .when((c("edge_type") == "same_topic") & (same("entity") | same("document_id")), 2.7)
        .when((c("edge_type") == "cross_modal_same_unit") & ~same("source_mode"), 4.2)
    )
    e = x.select(c("x.fact_id").alias("a"), c("y.fact_id").alias("b"), "edge_type", weight.alias("weight")).where("weight is not null and a <> b")
    return e.select(F.explode(F.array(F.struct("a", "b", "edge_type", "weight"), F.struct(c("b").alias("a"), c("a").alias("b"), "edge_type", "weight"))).alias("e")).select("e.*")


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected adjacency: each edge in both directions, once."""
    return edges.select("a", "b").union(edges.select("b", "a")).distinct()


def rejected(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of all rules that a row breaks, in order; a null rule is not broken."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def renamed_duplicates(df: DataFrame, key: str, line: str) -> DataFrame:
    """Later rows of an id get ``id:dup:line``; the first keeps its id."""
    first = df.groupBy(key).agg(F.min(line).alias("_first"))
    x = df.join(first, key)
    return x.select(F.when(F.col(line) == F.col("_first"), F.col(key)).otherwise(F.concat_ws(":", F.col(key), F.lit("dup"), F.col(line))).alias("new_id"), line)
