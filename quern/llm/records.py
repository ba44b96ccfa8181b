"""Columns derived from chat records, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.grams import char_sets

LETTERS = r"[^\p{L}\p{N}]+"


def plain(text: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(text), LETTERS, "")


def role(m: Column) -> Column:
    return F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))


def record_text(messages: Column) -> Column:
    """Contents of all messages but system ones, in order, as plain text; empty if there are none."""
    said = F.transform(F.filter(messages, lambda m: role(m) != "system"), lambda m: m["content"])
    return plain(F.coalesce(F.concat_ws("", said), F.lit("")))


def training_side(split: Column) -> Column:
    """True for every spelling of train or training; anything else, null included, is evaluation."""
    return F.coalesce(F.lower(F.trim(split)).isin("train", "training"), F.lit(False))


def label(c: Column) -> Column:
    """A source, split or task name in one spelling; null and empty become null."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(t != "", t)


def picture_set(images: Column) -> Column:
    """The distinct file names (last part of the path) in order, as one string; null equals empty."""
    names = F.transform(F.filter(images, lambda p: p.isNotNull()), lambda p: F.element_at(F.split(p, r"[/\\]"), -1))
    return F.coalesce(F.concat_ws("\x1f", F.array_sort(F.array_distinct(names))), F.lit(""))


def common_share(left: list[str], right: list[str], k: int = 5) -> np.ndarray:
    """The Jaccard index of the distinct k-character runs of each two texts; 0 where neither has any."""
    sa, sb = char_sets(left, k), char_sets(right, k)
    both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(sa, sb)], dtype=float)
    every = np.array([len(p) + len(q) for p, q in zip(sa, sb)], dtype=float) - both
    return np.divide(both, every, out=np.zeros(len(left)), where=every > 0)


def shared_share(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose distinct 5-character runs have a Jaccard index of ``least`` or more, with it."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 500):
                y = x.iloc[at : at + 500]
                j = common_share(list(y.text_a), list(y.text_b))
                keep = j >= least - 1e-12
                yield pd.DataFrame({"a": y.a[keep], "b": y.b[keep], "jaccard": j[keep]})

    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a long, b long, jaccard double")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds text_a and text_b to pairs of class ids; texts: (cid, text), one row per class."""
    return pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")


def of_classes(pairs: DataFrame, key: str, members: DataFrame, name: str) -> DataFrame:
    """Adds column ``name``: every member of the class ``key``; members: (id, cid).

    The members of a class are cut into parts of about COPIES, and a row of
    ``pairs`` meets each part on its own, so a class of any size is spread
    over tasks.
    """
    held = members.join(pairs.select(F.col(key).alias("cid")).distinct(), "cid", "left_semi")
    parts = held.groupBy("cid").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("_parts"))
    m = held.join(parts, "cid").select(F.col("cid").alias(key), F.col("id").alias(name), F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part"))
    x = pairs.join(parts.withColumnRenamed("cid", key), key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return x.join(m, [key, "_part"]).drop("_part")


#: Members of a class that one part of it holds, on average.
COPIES = 1_000
