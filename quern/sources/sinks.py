"""Writers: distinct rows, lanes, verify before publish, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import listing


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def first_of_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; null keys are one key."""
    x = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return x.select("_row.*")


def write_distinct(df: DataFrame, path: str, key: Column, order: str, fmt: str = "json") -> dict[str, int]:
    """Writes the first row of each key; returns the rows written and the duplicates left out."""
    total = df.count()
    first_of_key(df, key, order).write.format(fmt).save(path)
    written = df.sparkSession.read.format(fmt).load(path).count() if total else 0
    return {"written": written, "duplicates": total - written}


def publish(df: DataFrame, path: str, rules: dict[str, Column] | None = None, fmt: str = "parquet", keep_backup: bool = False) -> None:
    """Writes to a folder beside ``path``, checks the rules on what was written, then puts it in the place of ``path``.

    A rule is a condition that no row may meet; if one does, nothing is
    published and the error names each broken rule with its rows. ``path`` may
    be what ``df`` reads. With ``keep_backup`` the first state stays under
    ``path.bak``.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    fs, to = _fs(spark, path)
    _, new = _fs(spark, staged)
    if rules:
        x = spark.read.format(fmt).schema(df.schema).load(staged)
        counts = x.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).first().asDict()
        broken = {n: c for n, c in counts.items() if c}
        if broken:
            fs.delete(new, True)
            raise ValueError(f"not published, rows that break rules: {broken}")
    _, backup = _fs(spark, f"{path.rstrip('/')}.bak")
    if fs.exists(to):
        if keep_backup and not fs.exists(backup):
            fs.rename(to, backup)
        else:
            fs.delete(to, True)
    if not fs.rename(new, to):
        raise OSError(f"{staged} could not be moved to {path}")


def write_lanes(df: DataFrame, path: str, lane: Column, name: str = "lane", fmt: str = "parquet") -> DataFrame:
    """Writes a folder per value of ``lane``; returns (lane, rows)."""
    x = df.withColumn(name, lane)
    x.write.format(fmt).partitionBy(name).save(path)
    return df.sparkSession.read.format(fmt).load(path).groupBy(name).agg(F.count("*").alias("rows"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Files under a folder with size and SHA-256, and their number and total size."""
    files = listing(spark, path).select("path", "length", "sha256")
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return files, total.asDict()
