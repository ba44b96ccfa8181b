"""Problem 1: same or near-same records across splits.

A prefix-filter join between the evaluation and the training side on rare
shingles. Single 5-character runs, by which similarity is defined, are too
common for a prefix filter (the median run at the end of a 0.3 prefix stands in
2 % of the records), so a shingle is a group of them in text order that a hash
chooses (``quern.llm.signatures``): rare though its parts are common, and whole
wherever its parts are, so edits all over a text and short texts keep enough.
Evaluation prefixes are indexed and training prefixes probed bucket by bucket,
with the length filter and a filter on the number of common shingles. The join
is exact for shingles (NEED + DROP in common are found for certain); 0.7 of
common 5-character runs implies so many with a chance that the README measures.

Candidates are verified on their whole texts. Exact copies are one class
throughout, so a group of copies costs each task one set of postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.records import label, of_classes, record_text, shared_share, training_side, with_texts
from quern.llm.signatures import SIMILAR, signature_pairs
from quern.plans.durable import materialize


def classes(sft: DataFrame) -> DataFrame:
    """(id, train, cid, text) of each record; cid is a hash of the text, so exact copies share it."""
    x = sft.select(F.col("record_id").alias("id"), training_side(F.col("split")).alias("train"), record_text(F.col("messages")).alias("text"))
    return x.where("id is not null").withColumn("cid", F.xxhash64("text"))


def similar_classes(sft: DataFrame) -> DataFrame:
    """(a, b, jaccard) of records: pairs of different texts, one standing on each side, that are similar; materialized."""
    side = F.when(F.col("train"), 2).otherwise(1).cast("byte").alias("side")
    pairs, texts = signature_pairs(sft, "record_id", lambda x: classes(x).select("id", "cid", side, F.lit(0).cast("long").alias("salt"), "text"))
    return materialize(shared_share(with_texts(pairs, texts), SIMILAR))


def cross_split_overlaps(sft: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class pairs (a, b, jaccard) with one text on each side, and the members (id, train, cid) of the classes.

    A class with members on both sides pairs with itself at 1.0. Records
    without five letters or digits have no runs and pair with nothing; null
    ids are left out; null splits are evaluation; an empty table gives two
    empty ones. Other columns of the input are not read.
    """
    rows = classes(sft)
    members = materialize(rows.where(F.length("text") >= 5).select("id", "train", "cid"))
    same = members.groupBy("cid").agg(F.bool_or("train").alias("t"), F.bool_and("train").alias("all")).where("t and not all").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("jaccard"))
    return similar_classes(sft).unionByName(same), members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of record ids, smaller first, one on each side."""
    m = members
    both = materialize(pairs.select(F.col("a").alias("ce"), F.col("b").alias("ct")).union(pairs.where("a <> b").select("b", "a")))
    x = of_classes(of_classes(both, "ce", m.where("not train").select("id", "cid"), "e"), "ct", m.where("train").select("id", "cid"), "t")
    return x.select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b")).distinct()


def _sft(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/sft_records.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a training and an evaluation record that are the same or nearly so."""
    pairs, members = cross_split_overlaps(_sft(spark, d))
    return record_pairs(pairs, members)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation side: its records, those that stand in training too, and pairs."""
    sft = _sft(spark, d)
    pairs, members = cross_split_overlaps(sft)
    m = members
    train = m.where("train").groupBy("cid").agg(F.count("*").alias("k"))
    both = pairs.select(F.col("a").alias("ce"), F.col("b").alias("cid")).union(pairs.where("a <> b").select("b", "a"))
    links = both.join(train, "cid").groupBy("ce").agg(F.sum("k").alias("links"))
    hit = m.where("not train").join(links.withColumnRenamed("ce", "cid"), "cid").select("id", "links")
    names = sft.where(~training_side(F.col("split"))).where("record_id is not null").select(F.col("record_id").alias("id"), label(F.col("split")).alias("split"), label(F.col("source")).alias("source"))
    return names.join(hit, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
