"""Readers of JSON lines, JSON documents, tables and mixed folders, with line numbers and a lane for broken rows.

A line number costs no global sort: lines are numbered within the split that
reads them and the splits' counts, one row each, give the offsets.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
#: Keys under which a JSON document may hold its rows.
ENVELOPES = ("data", "items", "records", "results", "rows")


def lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(source, line, value) of every line of text files, numbered from 1 by file; folders are read recursively.

    A byte order mark before the first line is dropped; a missing path gives
    no rows.
    """
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], "source string, line long, value string")
    r = spark.read.option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    x = r.text(paths).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    firsts = x.groupBy("source", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("source").orderBy("_at")
    firsts = firsts.select("source", "_at", "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    x = x.join(firsts, ["source", "_at"]).select("source", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")
    return x.withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def invalid(value: Column) -> Column:
    """True for a text that is not one JSON value; as the only element of a list it can have nothing behind it."""
    one = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    return one.isNull() | F.try_variant_get(one, "$[1]", "variant").isNotNull()


def parsed(x: DataFrame, schema: T.StructType | str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of a column of JSON texts: rows with the schema's columns beside the others, broken ones with a reason.

    Blank texts are in neither. A text is broken if it is no JSON, if it is no
    object, or if a value doesn't fit the schema. A further value after the
    object breaks it, too.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    others = [c for c in x.columns if c != value]
    x = x.where(F.trim(F.col(value)) != "")
    kind = F.when(invalid(F.col(value)), "invalid_json").when(~F.ltrim(F.col(value)).startswith("{"), "not_an_object")
    y = x.withColumns({"_r": F.from_json(value, full, STRICT), "_kind": kind})
    reason = F.coalesce("_kind", F.when(F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull(), "wrong_type"))
    y = y.withColumn("reason", reason)
    good = y.where("reason is null").select(*others, *[F.col("_r")[f.name].alias(f.name) for f in schema.fields])
    return good, y.where("reason is not null").select(*others, F.col(value).alias("value"), "reason")


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Strict JSON lines: (source, line, fields...); reading fails with file and line of a broken one."""
    x = lines(spark, path, "*.jsonl" if isinstance(path, str) and os.path.splitext(path)[1] == "" else None)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    x = x.where(F.trim("value") != "")
    bad = invalid(F.col("value")) | ~F.ltrim("value").startswith("{")
    where = F.concat(F.lit("invalid JSON in "), F.col("source"), F.lit(":"), F.col("line").cast("string"))
    x = x.withColumn("value", F.when(bad, F.raise_error(where)).otherwise(F.col("value")))
    x = x.withColumn("_r", F.from_json("value", full, STRICT))
    return x.select("source", "line", *[F.col("_r")[f.name].alias(f.name) for f in schema.fields])


def jsonl_permissive(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines without the broken ones; a missing file is empty."""
    return parsed(lines(spark, path), schema)[0]


def jsonl_lanes(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines with their reason) of all JSON-lines files under a path."""
    return parsed(lines(spark, path, "*.jsonl"), schema)


def split_objects(text: str) -> list[str]:
    """The top-level JSON objects of a text, wherever its lines break; raw line ends inside strings are escaped."""
    out, piece, depth, quoted, escaped = [], [], 0, False, False
    for c in text:
        if not depth and c != "{":
            continue
        if quoted:
            piece.append({"\n": "\\n", "\r": "\\r"}.get(c, c))
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        piece.append(c)
        quoted = c == '"'
        depth += (c in "{[") - (c in "}]")
        if not depth:
            out.append("".join(piece))
            piece = []
    if piece:
        out.append("".join(piece))  # an object that never ends is a broken row, not a lost one
    return out


def objects(spark: SparkSession, path: str, repair: Callable[[str], str | None] | None = None) -> DataFrame:
    """(source, ordinal, value) of the JSON objects of whole text files; ``repair`` may mend texts that are no JSON."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), "value")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for source, text in zip(x.source, x.value):
                rows = []
                for i, o in enumerate(split_objects(text.removeprefix("﻿"))):
                    try:
                        json.loads(o)
                    except ValueError:
                        o = (repair(o) if repair else None) or o
                    rows.append((source, i, o))
                yield pd.DataFrame(rows, columns=["source", "ordinal", "value"])

    return files.mapInPandas(split, "source string, ordinal long, value string")


def document(spark: SparkSession, path: str) -> DataFrame:
    """(source, ordinal, value) of JSON documents: the elements of a list, of the first list under ENVELOPES, or the object itself."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^﻿", "").alias("value"))
    listed: Column = F.from_json("value", "array<string>")
    for key in ENVELOPES:
        inner = F.get_json_object("value", f"$.{key}")
        listed = F.coalesce(listed, F.when(F.ltrim(inner).startswith("["), F.from_json(inner, "array<string>")))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(listed)
    rows = files.select("source", F.posexplode(F.coalesce(listed, F.array("value"))).alias("ordinal", "value"))
    return rows.select("source", F.col("ordinal").cast("long").alias("ordinal"), "value")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, cap_by: str | None = None, cap: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """A Parquet scan of the columns named; with ``cap_by``, at most ``cap`` rows of each of its values, in order."""
    x = spark.read.parquet(path)
    x = x.select(*columns) if columns else x
    if cap_by is None or cap is None:
        return x
    w = Window.partitionBy(cap_by).orderBy(*(order or [F.col(c) for c in x.columns]))
    return x.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= cap).drop("_place")


def delimited(spark: SparkSession, path: str, separator: str = "\t", needed: list[str] | None = None) -> DataFrame:
    """A table with a header line, all columns as text; rows without one of the ``needed`` values are left out."""
    x = spark.read.csv(path, sep=separator, header=True, multiLine=True, escape='"')
    for c in needed or []:
        x = x.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return x


def records(spark: SparkSession, path: str) -> DataFrame:
    """(source, ordinal, value) of a file by its suffix: .jsonl, .json, .csv, .tsv, .parquet, or .txt and .md as one row each."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".jsonl":
        x = lines(spark, path).where(F.trim("value") != "")
        return x.select("source", F.col("line").alias("ordinal"), "value")
    if suffix == ".json":
        return document(spark, path)
    if suffix in (".txt", ".md"):
        x = spark.read.text(path, wholetext=True)
        return x.select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("long").alias("ordinal"), F.to_json(F.struct(F.col("value").alias("text"))).alias("value"))
    if suffix in (".csv", ".tsv"):
        x = delimited(spark, path, "," if suffix == ".csv" else "\t")
    elif suffix == ".parquet":
        x = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {suffix or path}")
    return x.select(F.lit(path).alias("source"), F.monotonically_increasing_id().alias("ordinal"), F.to_json(F.struct(*x.columns)).alias("value"))


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, stem, length, sha256) of all files under a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    x = (r.option("pathGlobFilter", pattern) if pattern else r).load(path)
    return x.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "length", F.sha2("content", 256).alias("sha256"))


def joined_by_stem(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """One row per file stem that stands in every folder: stem and each folder's text under its name."""
    out = None
    for name, folder in folders.items():
        x = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("value").alias(name))
        out = x if out is None else out.join(x, "stem")
    return out
