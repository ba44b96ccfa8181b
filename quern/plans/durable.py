"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 64-bit keys that may be broadcast: 16 MB at most.
BROADCAST_KEYS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on a local master, as in tests, a new temporary one.

    On a cluster it has to be set: a folder of one machine is none that executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("quern.own.folder", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="quern-")
            spark.conf.set("quern.own.folder", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The result has no lineage, survives the loss of executors and is computed
    once however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_keys(df: DataFrame, key: str, keys: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the distinct one-column table ``keys``.

    ``keys`` should be materialized: it is counted, broadcast if it has at
    most ``bound`` rows and joined by a shuffle otherwise.
    """
    few = keys.count() <= bound
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key, "left_semi")
