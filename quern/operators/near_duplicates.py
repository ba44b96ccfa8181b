"""Near-duplicate removal with MinHash signatures: the first of a group of similar texts is kept.

A text's character n-grams are hashed (base-257 polynomial, then a 64-bit mix),
each of ``num_perm`` seeds gives the smallest mixed value, and rows that agree
on a whole band of the signature are compared. A row is dropped if its text
equals an earlier kept one's or if the share of equal signature places with an
earlier *kept* row is at least the threshold; a dropped row drops nothing.

The greedy pass is run in rounds instead of row by row: the earliest undecided
row of all its bands is kept, and the undecided rows of its bands are compared
with it. So a band shared by any number of rows costs one comparison per row
and round, never all pairs. A long run of dissimilar rows in one band needs as
many rounds as rows, which the number of places in a band makes unlikely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import squeezed
from quern.plans.durable import materialize

#: The default parameters and the constants of the hash.
THRESHOLD, NUM_PERM, NGRAM, BANDS = 0.90, 128, 5, 16
BASE, GOLDEN, M1, M2 = 257, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
U = np.uint64
#: Characters that are hashed at once.
CHARS_AT_ONCE = 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(M1)
    x = (x ^ (x >> U(27))) * U(M2)
    return x ^ (x >> U(31))


def shingle_hashes(text: str, ngram: int = NGRAM) -> np.ndarray:
    """The hashes of a text's n-grams; a text of at most n characters has one, an empty one the hash 0."""
    if not text:
        return np.zeros(1, dtype=U)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)
    if len(c) <= ngram:
        return mixed(np.array([np.sum(c * np.arange(1, len(c) + 1, dtype=U))], dtype=U))
    h = np.zeros(len(c) - ngram + 1, dtype=U)
    for k in range(ngram):
        h = h * U(BASE) + c[k : len(c) - ngram + 1 + k]
    return np.unique(mixed(h))


def signature(text: str, num_perm: int = NUM_PERM, ngram: int = NGRAM) -> np.ndarray:
    """The smallest mixed hash under each seed, as unsigned 64-bit values."""
    h = shingle_hashes(text, ngram)
    seeds = mixed(U(GOLDEN) * np.arange(1, num_perm + 1, dtype=U))[:, None]
    best = np.full(num_perm, U(0xFFFFFFFFFFFFFFFF))
    step = max(1, CHARS_AT_ONCE // 8)
    for at in range(0, len(h), step):
        best = np.minimum(best, mixed(h[None, at : at + step] ^ seeds).min(axis=1))
    return best


def message_text(messages: Column, scope: str = "all") -> Column:
    """Lines ``role: content`` of the messages in scope (all, or one role), lower case, blanks collapsed, trimmed."""
    kept = messages if scope == "all" else F.filter(messages, lambda m: m["role"] == scope)
    lines = F.transform(kept, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return squeezed(F.coalesce(F.array_join(lines, "\n"), F.lit("")))


def signatures(rows: DataFrame, num_perm: int = NUM_PERM, ngram: int = NGRAM) -> DataFrame:
    """(ord, sig array<long>) of (ord, text)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"ord": x.ord, "sig": [signature(t, num_perm, ngram).view(np.int64) for t in x.text]})

    return rows.select("ord", "text").mapInPandas(sign, "ord long, sig array<long>")


def band_keys(sig: Column, num_perm: int = NUM_PERM, bands: int = BANDS) -> Column:
    """An array with a (band, places) of each band."""
    size = num_perm // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.slice(sig, b * size + 1, size).alias("places")))


def equal_share(a: Column, b: Column) -> Column:
    """The share of places in which two signatures are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def kept_rows(df: DataFrame, order: str, text: Column, threshold: float = THRESHOLD, num_perm: int = NUM_PERM, ngram: int = NGRAM, bands: int = BANDS, max_rounds: int = 200) -> DataFrame:
    """(order) of the rows that are kept; ``order`` is a unique number by which rows come first.

    Null texts count as empty; all empty texts are one. Null orders are left
    out, of repeated ones one row counts. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1 or num_perm <= 0 or num_perm % bands or ngram <= 0:
        raise ValueError("threshold must be in (0, 1], num_perm a multiple of bands, ngram positive")
    x = df.select(F.col(order).cast("long").alias("ord"), F.coalesce(text, F.lit("")).alias("text")).where("ord is not null")
    first = materialize(x.groupBy("text").agg(F.min("ord").alias("ord")))  # exact copies keep the first
    sigs = materialize(signatures(first, num_perm, ngram))
    keys = sigs.select("ord", F.explode(band_keys(F.col("sig"), num_perm, bands)).alias("k")).select("ord", F.col("k.band"), F.xxhash64("k.places").alias("key"), F.xxhash64(F.lit(1), "k.places").alias("key2"))
    shared = keys.join(keys.groupBy("band", "key", "key2").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key", "key2"])
    open_ = materialize(shared.select("ord", F.xxhash64("band", "key", "key2").alias("bucket")))
    kept = sigs.select("ord").join(open_.select("ord").distinct(), "ord", "left_anti")
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        lead = open_.groupBy("bucket").agg(F.min("ord").alias("lead"))
        x = materialize(open_.join(lead, "bucket"))
        top = materialize(x.groupBy("ord").agg(F.min("lead").alias("least"), F.max("lead").alias("most")).where("least = ord and most = ord").select("ord"))
        pairs = x.where("ord <> lead").select("ord", "lead").distinct().join(top.withColumnRenamed("ord", "lead"), "lead", "left_semi")
        a, b = sigs.toDF("ord", "sig_a"), sigs.toDF("lead", "sig_b")
        gone = materialize(pairs.join(a, "ord").join(b, "lead").where(equal_share(F.col("sig_a"), F.col("sig_b")) >= threshold).select("ord").distinct())
        kept = kept.union(top)
        open_ = materialize(open_.join(top, "ord", "left_anti").join(gone, "ord", "left_anti"))
    else:
        raise RuntimeError(f"rows were left undecided after {max_rounds} rounds")
    return kept.select(F.col("ord").alias(order))
