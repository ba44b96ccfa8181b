"""Queries through files: tables are written to the shared folder and read again by the readers and writers of ``quern.sources``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import record_key
from quern.plans.durable import shared_folder
from quern.plans.registry import Registry
from quern.sources import files, sinks

R = Registry()
query = R.query
SFT = "sft_records"
FIELDS = "record_id long, task string, split string"


def place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quern-files-{uuid.uuid4().hex}"


def as_lines(x: DataFrame) -> str:
    """A folder of JSON lines of the fields, rows without a split as lines that break off."""
    to = place(x.sparkSession)
    line = F.to_json(F.struct("record_id", "task", "split"))
    x.select(F.when(F.col("split").isNull(), F.lit('{"record_id": ')).otherwise(line).alias("value")).write.text(to)
    return to


@query("select record_id, task, split from sft_records")
def src1_strict_lines(t):
    spark, to = t(SFT).sparkSession, place(t(SFT).sparkSession)
    t(SFT).select("record_id", "task", "split").write.json(to)
    return files.jsonl(spark, f"{to}/*.json", FIELDS).drop("source", "line")


@query("select case when split is null then 'invalid_json' else 'ok' end as lane, count(*) as rows from sft_records group by 1")
def src3_error_lane(t):
    """Lines by lane: those that break off come out with a reason and are not lost."""
    rows, broken = files.parsed(files.lines(t(SFT).sparkSession, f"{as_lines(t(SFT))}/*.txt"), FIELDS)
    return rows.select(F.lit("ok").alias("lane")).union(broken.select("reason")).groupBy("lane").agg(F.count("*").alias("rows"))


@query("select record_id from sft_records")
def src9_records(t):
    """The ids in the rows of a Parquet folder, read as JSON records."""
    to = f"{place(t(SFT).sparkSession)}.parquet"
    t(SFT).select("record_id", "task").write.parquet(to)
    return files.records(t(SFT).sparkSession, to).select(F.get_json_object("value", "$.record_id").cast("long").alias("record_id"))


@query()
def snk1_distinct_rows(t):
    """Rows written and duplicates left out by the key of messages and pictures."""
    done = sinks.write_distinct(t(SFT).select("record_id", "messages", "images"), place(t(SFT).sparkSession), record_key(F.col("messages"), F.col("images")), "record_id", "parquet")
    return t(SFT).sparkSession.createDataFrame([(done["written"], done["duplicates"])], "written long, duplicates long")


@query("select case when split is null then 'suspicious' when messages is null or len(messages) < 2 then 'broken' else 'clean' end as lane, count(*) as rows from sft_records group by 1")
def snk6_lanes(t):
    lane = F.when(F.col("split").isNull(), "suspicious").when(F.coalesce(F.size("messages"), F.lit(0)) < 2, "broken").otherwise("clean")
    return sinks.write_lanes(t(SFT).select("record_id", "messages", "split"), place(t(SFT).sparkSession), lane)
