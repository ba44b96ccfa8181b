"""Problem 7: filling fixed-capacity containers with items.

Harmonic packing. A text longer than the capacity is cut into full containers
and a remainder; every other text stays whole. Lengths in (C/(k+1), C/k] are
class k, and a container of class k takes k of them, so that workers fill
containers of a class independently by counting. Workers are shards of the
texts by a hash of their id, of SHARD texts on average. Full containers keep
gaps (a quarter on average in class 1), so each shard goes through its texts
from the longest on and gives a text to the smallest gap of a finished
container that takes it, before it opens a container of the text's own class.
Only ids and lengths are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import token_counts
from quern.plans.durable import materialize

#: Texts of a shard, on average.
SHARD = 20_000
#: Classes beyond this one are one class of small texts, whose containers are open to any text that fits.
CLASSES = 16
MOST_SPECS = 1000
OUT = "pack_name string, container string, doc_id long, part int, tokens long"


def pack_shard(lengths: list[int], capacity: int) -> list[int]:
    """The container number of each length (at most the capacity, at least 1)."""
    where = [0] * len(lengths)
    used: list[int] = []
    gaps: list[tuple[int, int]] = []
    now, box, left = 0, -1, 0  # the class at hand, its open container and the texts that still belong there
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = capacity // n
        if k != now and left and box >= 0:
            insort(gaps, (capacity - used[box], box))  # no more texts of its class will come
            left = 0
        now = k
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            to = gaps.pop(at)[1]
            finished = True
        else:
            if not left:
                box, left = len(used), k if k < CLASSES else 1
                used.append(0)
            to, left = box, left - 1
            finished = not left
        where[i] = to
        used[to] += n
        if finished and used[to] < capacity:
            insort(gaps, (capacity - used[to], to))
    return where


def pack(documents: DataFrame, specs: DataFrame, most_specs: int = MOST_SPECS) -> DataFrame:
    """(pack_name, container, doc_id, part, tokens): each piece of each text in a container of each capacity.

    Pieces of a cut text are numbered from 0; whole texts are part 0. Null and
    empty texts have nothing to pack and are left out, as are specs without a
    name or a positive capacity. Copies, and texts under a repeated id, are packed like any other text. Empty
    tables give an empty result; more than most_specs specs are refused, as the
    driver holds them.
    """
    sizes = materialize(token_counts(documents).select("doc_id", "tokens").where("tokens > 0"))
    shards = max(1, -(-sizes.count() // SHARD))
    specs = specs.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))

    def fill(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        name, shard = key
        x = x.sort_values(["doc_id", "tokens"], kind="stable")
        c = int(x.capacity.iloc[0])
        rows, loose = [], []
        for at, (d, n) in enumerate(zip(x.doc_id.tolist(), x.tokens.tolist())):
            full, rest = divmod(n, c)
            rows += [(name, f"{name}-{shard}-{at}-{i}", d, i, c) for i in range(full)]
            if rest:
                loose.append((d, full, rest))
        boxes = pack_shard([r for _, _, r in loose], c)
        rows += [(name, f"{name}-{shard}-{b}", d, part, n) for b, (d, part, n) in zip(boxes, loose)]
        return pd.DataFrame(rows, columns=["pack_name", "container", "doc_id", "part", "tokens"])

    known = [(r.pack_name, r.capacity) for r in specs.orderBy("pack_name").limit(most_specs + 1).collect()]
    if len(known) > most_specs:
        raise ValueError(f"more than {most_specs} pack specs")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in known]) if known else F.expr("cast(array() as array<struct<pack_name:string,capacity:bigint>>)"))
    x = sizes.select("doc_id", "tokens", each.alias("spec")).select("doc_id", "tokens", "spec.*")
    return x.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("pack_name", "shard").applyInPandas(fill, OUT)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of one over the capacity, with its container for each pack spec."""
    return pack(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pack_specs.parquet"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per pack spec: containers, the fewest that the tokens could fill, and the share of space used."""
    specs = spark.read.parquet(f"{d}/pack_specs.parquet")
    x = p7_containers(spark, d).groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    x = x.join(specs, "pack_name")
    return x.select("pack_name", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"))
