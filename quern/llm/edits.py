"""Problem 4: near-duplicate records with small edits.

Candidates share Order MinHash signatures of their texts and have the same
picture set (``quern.llm.signatures``; the picture set is mixed into the
signatures, so other records never meet). They are verified by banded
alignment: an edit touches at most MER runs of either text, so a distance of d
edits leaves at least the larger text's runs less MER * d in common, and the
band of a pair is the largest d for which that proves the similarity. Pairs
outside their band, with moved or longer inserted parts that a band cannot hold,
are decided by counting their common runs. Groups are connected components;
pairs of a group that no link proves are verified as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.records import common_share, of_classes, picture_set, record_text, with_texts
from quern.llm.signatures import MER, SIMILAR, signature_pairs
from quern.operators.graph import connected_components
from quern.plans.durable import materialize


def classes(sft: DataFrame) -> DataFrame:
    """(id, cid, text, pictures): records with the same text and pictures share the class cid."""
    x = sft.select(F.col("record_id").alias("id"), record_text(F.col("messages")).alias("text"), F.xxhash64(picture_set(F.col("images"))).alias("pictures"))
    return x.where("id is not null and length(text) >= 5").withColumn("cid", F.xxhash64("text", "pictures"))


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b, edits) of the similar ones among pairs (a, b, runs, text_a, text_b).

    With ``runs`` distinct runs in the larger text, d edits leave runs - MER * d
    of them common among at most runs + MER * d: enough while the quotient is
    at least SIMILAR. edits is null where common runs decide.
    """
    x = pairs.withColumn("_band", F.floor(F.col("runs") * (1 - SIMILAR) / ((1 + SIMILAR) * MER)).cast("int"))
    x = x.withColumn("edits", F.expr("levenshtein(text_a, text_b, _band)"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = (x.edits >= 0).to_numpy()
            open_ = np.flatnonzero(~near)
            for at in range(0, len(open_), 500):
                p = open_[at : at + 500]
                near[p] = common_share(list(x.text_a.iloc[p]), list(x.text_b.iloc[p]), MER) >= SIMILAR - 1e-12
            yield pd.DataFrame({"a": x.a, "b": x.b, "edits": x.edits.where(x.edits >= 0).astype("Int32")})[near]

    return x.select("a", "b", "edits", *[F.when(F.col("edits") < 0, F.col(t)).otherwise("").alias(t) for t in ("text_a", "text_b")]).mapInPandas(decide, "a long, b long, edits int")


def edit_links(sft: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b, edits) between classes, all similar pairs of classes of one group; members (id, cid); and (cid, component) of linked classes.

    edits is the edit distance of the texts if alignment proves the link, null
    where parts were moved or inserted beyond the band.
    """
    rows = classes(sft)
    cand, texts = signature_pairs(sft, "record_id", lambda x: classes(x).select("id", "cid", F.lit(3).cast("byte").alias("side"), F.col("pictures").alias("salt"), "text"), both=True)
    links = materialize(verified(with_texts(cand, texts)))
    comp = materialize(connected_components(links).select(F.col("node").alias("cid"), "component"))
    c = comp.select(F.col("cid").alias("a"), "component")
    within = c.join(c.withColumnRenamed("a", "b"), "component").where("a < b").select("a", "b").join(links, ["a", "b"], "left_anti")
    more = verified(with_texts(within.withColumn("runs", F.lit(0)), texts))
    return materialize(links.unionByName(more)), rows.select("id", "cid"), comp


def edit_groups(sft: DataFrame) -> DataFrame:
    """(id, group) of every record that has a near-duplicate with the same pictures; group is the smallest id.

    Records without five letters or digits, and null ids, are in no group;
    null pictures equal empty ones; copies under new ids share a group; an
    empty table gives an empty one.
    """
    _, members, comp = edit_links(sft)
    m = members.join(comp, "cid", "left").select("id", F.coalesce("component", "cid").alias("c"))
    sizes = m.groupBy("c").agg(F.min("id").alias("group"), F.count("*").alias("n")).where("n > 1")
    return materialize(m.join(sizes, "c").select("id", "group"))


def edit_pairs(sft: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b), smaller first: every two records of a class and of two linked ones."""
    links, members, _ = edit_links(sft)
    m = materialize(members.distinct())
    same = m.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    pairs = materialize(links.select("a", "b").union(same))
    x = of_classes(of_classes(pairs, "a", m, "p"), "b", m, "q").where("a <> b or p < q")
    return x.select(F.least("p", "q").alias("record_id_a"), F.greatest("p", "q").alias("record_id_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of records that are small edits of one another and show the same pictures."""
    return edit_pairs(spark.read.parquet(f"{d}/sft_records.parquet"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record in a group: record_id and the group's smallest id."""
    return edit_groups(spark.read.parquet(f"{d}/sft_records.parquet")).select(F.col("id").alias("record_id"), F.col("group").alias("group_id"))
