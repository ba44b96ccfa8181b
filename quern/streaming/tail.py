"""Append-only files as streams: new rows since the last run, the best of each step window, resumable output.

Offsets, state and output are in the checkpoint and output folders, so a run
that was lost goes on where it stopped and a row counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the rows of JSON-lines files under a folder, new files as they come; broken lines are left out."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).option("mode", "DROPMALFORMED").json(path)


def top_per_window(rows: DataFrame, step: str, width: int, k: int, *order: Column) -> DataFrame:
    """The first k rows of each window of ``width`` steps; steps are counters, not times. Rows without a step are left out."""
    x = rows.where(F.col(step).isNotNull()).withColumn("window", F.floor(F.col(step) / width))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("window").orderBy(*order))).where(F.col("place") <= k)


def keep_top(stream: DataFrame, out: str, checkpoint: str, step: str, width: int, k: int, order: Callable[[], list[Column]]) -> StreamingQuery:
    """Runs through all rows at hand and keeps in ``out`` the first k of every window seen so far.

    A batch is merged with the windows that ``out`` holds and written under its
    own number, so a batch that is run twice replaces itself; ``current`` reads
    the last one.
    """
    kept = [*stream.columns, "window"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = top_per_window(batch, step, width, k, *order()).select(*kept)
        before = latest(spark, out, number)
        if before is not None:
            top = top_per_window(top.drop("window").unionByName(before.drop("window", "place", "batch")), step, width, k, *order()).select(*kept)
        top.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The windows as of the last batch (before a given one), None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*")) or []]
    found = [n for n in found if before is None or n < before]
    return spark.read.parquet(f"{out}/batch={max(found)}") if found else None


def window_totals(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per time window and key, rows up to ``late`` late counted, later ones dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("rows"))


def append_missing(rows: DataFrame, key: str, out: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Works only on rows whose key stands in no earlier output and appends the results; returns how many were left."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows = rows.join(spark.read.parquet(out).select(key).distinct(), key, "left_anti")
    left = rows.count()
    if left:
        work(rows).write.mode("append").parquet(out)
    return left
