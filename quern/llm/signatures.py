"""Order MinHash signatures of texts and the prefix-filter join on them, shared by problems 1 and 4.

A text is the sequence of its MER-character runs, each labelled with its
occurrence number (Marcais et al., 2019). A hash sends a run to one of the
text's cells; of each cell the KEEP smallest are retained in the order in which
they stand in the text, and that group is one signature: a shingle of KEEP runs
that is rare although single runs are common. A text has up to SIGNATURES of
them. Texts too short to give each of so many cells KEEP runs have fewer cells
(its level is the logarithm of their number) under several hashes, so that a
short text's signatures are as selective as a long one's. As two texts of an
index of SIMILAR differ in size by at most 1 : SIMILAR, a text near the lower
end of its level signs for the level below, too.

At an index of 0.7 a signature is common with a chance of about 0.7 ** KEEP,
so SIGNATURES = 64 have 15 in common on average and fewer than NEED = 2 with a
chance of 5 in ten million; moved parts lower it, as runs change their order.

The join counts common signatures in buckets of signatures and keeps pairs
with NEED or more. A text leaves out its DROP most frequent signatures, if they
are frequent at all: any pair that has NEED + DROP in common is found for
certain, whatever the order (the prefix filter of set-similarity joins).
Frequencies are counted over all rows in a table of SLOTS hashed counters. A
signature that is still frequent, as a run of stock text gives it to all its
users, is split: its texts meet in a grid of cells of about SPLIT texts a side, each
a unit of work of its own, so that no task holds all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.grams import U64, chunks, mix, mix_scalar, runs
from quern.plans.durable import keep_keys, materialize

SIMILAR = 0.7
MER, KEEP, LEVELS, LEAST_RUNS = 5, 4, 6, 4
SIGNATURES = 1 << LEVELS
NEED, DROP = 2, 2
#: Counters of the frequency table (4 MB) and the parts in which it is added up.
SLOTS, PARTS = 1 << 20, 16
#: A signature is frequent from this many texts on above the table's mean, and is split beyond SPLIT.
FREQUENT, SPLIT = 16, 20_000
#: Postings of a bucket on average; a bucket's join works on slices of at most HITS hits.
BUCKET_POSTINGS, LEAST_BUCKETS, HITS = 4_000_000, 16, 2_000_000
DOC = np.dtype([("cid", "<i8"), ("n", "<u4"), ("side", "u1"), ("tokens", "u1")])
BITS = U64(40)
#: One hash function per level and repetition.
SALT = np.array([[mix_scalar((level << 8) + rep + 7) for rep in range(SIGNATURES)] for level in range(LEVELS + 1)], dtype=U64)


def _levels(n: np.ndarray) -> np.ndarray:
    """The level of texts of n distinct runs."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1) / LEAST_RUNS)), 0, LEVELS).astype(np.int64)


def _virtual(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, level, repetition) of all signings of texts of so many runs."""
    own, level = np.arange(len(lens)), _levels(lens)
    # sizes are counted in runs here, in distinct runs in an index: a margin for repeated ones
    below = (level > 0) & (lens * SIMILAR * 0.9 < (LEAST_RUNS << level))
    own, level = np.concatenate([own, own[below]]), np.concatenate([level, level[below] - 1])
    has = lens[own] > 0
    own, level = own[has], level[has]
    times = SIGNATURES >> level
    rep = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(own, times), np.repeat(level, times), rep


def order_signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, signature), text by text, and each text's number of distinct runs."""
    sizes = np.zeros(len(texts), dtype=np.int64)
    owns, sigs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U64)]
    for lo, hi in chunks(texts):
        own, at, h = runs(texts[lo:hi], MER)
        if not len(h):
            continue
        lens = np.bincount(own, minlength=hi - lo)
        first = np.cumsum(lens) - lens
        who, level, rep = _virtual(lens)
        size = lens[who]
        pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[who], size)
        v = np.repeat(np.arange(len(who)), size)
        salted = SALT[level, rep]
        x = mix(h[pick] ^ salted[v])
        bins = (1 << level).astype(np.int64)
        base = np.cumsum(bins) - bins
        cell = (base[v] + (x & (bins[v] - 1).astype(U64)).astype(np.int64)).astype(U64)
        key = (cell << BITS) | (x >> (U64(64) - BITS))
        o = np.argsort(key)
        key = key[o]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        sizes[lo:hi] = np.bincount(who, np.bincount(v[o[~same]], minlength=len(who)) * (rep == 0) * (level == _levels(lens)[who]), minlength=hi - lo)
        if same.any():
            tied = same.copy()
            tied[:-1] |= same[1:]
            tied = np.flatnonzero(tied)
            o[tied] = o[tied][np.lexsort((o[tied], key[tied]))]
            start = np.flatnonzero(~same[tied])
            occurrence = np.arange(len(tied)) - np.repeat(start, np.diff(np.concatenate([start, [len(tied)]])))
            again, occurrence = tied[occurrence > 0], occurrence[occurrence > 0]
            key[again] = (key[again] >> BITS << BITS) | (mix(key[again] + occurrence.astype(U64) * U64(mix_scalar(1))) >> (U64(64) - BITS))
            p = np.argsort(key)
            key, o = key[p], o[p]
        place = at[pick[o]]
        c = key >> BITS
        start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        n = np.diff(np.concatenate([start, [len(c)]]))
        there = np.arange(KEEP)[None] < n[:, None]
        idx = np.where(there, start[:, None] + np.arange(KEEP)[None], 0)
        order = np.argsort(np.where(there, place[idx], 1 << 40), axis=1, kind="stable")
        low = np.take_along_axis(np.where(there, key[idx] & ((U64(1) << BITS) - U64(1)), U64(0)), order, axis=1)
        s = np.zeros(len(start), dtype=U64)
        for j in range(KEEP):
            s = mix(s * U64(3) + low[:, j] + U64(j + 1))
        of = v[o[start]]
        s = mix(s + salted[of] + (c[start].astype(np.int64) - base[of]).astype(U64) * U64(mix_scalar(3)))
        o = np.argsort(who[of], kind="stable")
        owns.append(who[of][o] + lo)
        sigs.append(s[o])
    return np.concatenate(owns), np.concatenate(sigs), sizes


def signed(rows: DataFrame) -> DataFrame:
    """(cid, id, side, n, sigs), once per class, side and task; rows: (id, cid, side, salt, text), id any row's key.

    side is a bit, salt a number that is mixed into all signatures, so that
    only classes of one salt meet; n is the number of distinct runs.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for x in batches:
            new = []
            for k in zip(x.cid.tolist(), x.side.tolist()):
                new.append(k not in seen)
                seen.add(k)
            x = x[new]
            if not len(x):
                continue
            own, sig, size = order_signatures(list(x.text))
            sig = mix(sig + x.salt.to_numpy().view(U64)[own])
            cut = np.searchsorted(own, np.arange(len(x) + 1))
            raw = sig.tobytes()
            yield pd.DataFrame({"cid": x.cid, "id": x.id, "side": x.side, "n": size.astype(np.int32), "sigs": [raw[8 * a : 8 * b] for a, b in zip(cut[:-1], cut[1:])]})

    return rows.select("id", "cid", "side", "salt", "text").mapInPandas(sign, "cid long, id long, side byte, n int, sigs binary")


def frequencies(sigs: DataFrame) -> np.ndarray:
    """How many texts have a signature in each of SLOTS hashed counters, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(SLOTS, dtype=np.uint32)
        for x in batches:
            c += np.bincount((np.frombuffer(b"".join(x.sigs), dtype=U64) % U64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        yield pd.DataFrame([(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(c, PARTS))], columns=["part", "counts"])

    def add(x: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(SLOTS // PARTS, dtype=np.uint32)
        for p in x.counts:
            c += np.frombuffer(zlib.decompress(p), dtype=np.uint32)
        return pd.DataFrame({"part": [int(x.part.iloc[0])], "counts": [zlib.compress(c.tobytes(), 1)]})

    schema = "part int, counts binary"
    out = np.zeros(SLOTS, dtype=np.uint32)
    for r in sigs.select("sigs").mapInPandas(count, schema).groupBy("part").applyInPandas(add, schema).collect():
        out[r.part * (SLOTS // PARTS) : (r.part + 1) * (SLOTS // PARTS)] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    return out


def _split(own: np.ndarray, sig: np.ndarray, grid: np.ndarray, cid: np.ndarray, left: np.ndarray, right: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Replaces each posting of a signature with a grid of g x g cells by those of the cells of its text.

    Texts of the left side are in one row of the grid, those of the right side
    in one column. Where all texts meet each other (both), a text's row and
    column have the same number and only cells on or above the diagonal count.
    """
    g = grid[own]
    cell = (mix(cid[own].view(U64)) % g.astype(U64)).astype(np.int64)
    i = np.repeat(np.arange(len(own)), g)
    j = np.arange(len(i)) - np.repeat(np.cumsum(g) - g, g)
    out_own, out_sig = [], []
    for is_left, here in ((True, left[own][i]), (False, right[own][i])):
        row, column = (cell[i], j) if is_left else (j, cell[i])
        keep = here & (row <= column) if both else here
        out_own.append(own[i][keep])
        out_sig.append(mix(sig[i][keep] + (row * (1 << 20) + column)[keep].astype(U64)))
    o, s = np.concatenate(out_own), np.concatenate(out_sig)
    order = np.lexsort((s, o))
    o, s = o[order], s[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])]) if len(o) else np.zeros(0, dtype=bool)
    return o[new], s[new]


def spread(spark: SparkSession, buckets: int) -> np.ndarray:
    """Numbers for the buckets that hash partitioning sends to a partition each, so that no task gets two of them."""
    tried = spark.range(buckets * (4 + buckets.bit_length())).select(F.col("id").cast("int").alias("id"))
    x = tried.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("p")).agg(F.min("id").alias("id")).select("id").toPandas().id.to_numpy(dtype=np.int32)
    left = np.setdiff1d(np.arange(2 * buckets, dtype=np.int32), x)[: buckets - len(x)]  # for partitions that none was found for
    return np.concatenate([x, left])


def postings(sigs: DataFrame, counts: np.ndarray, buckets: int, both: bool) -> DataFrame:
    """(bucket, docs, posts): the prefixes of all classes, packed by bucket of signatures."""
    mean = int(counts.mean())
    numbers = spread(sigs.sparkSession, buckets)
    at_once = min(60_000, max(8_000, 64 * buckets))

    def prefix(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(s) // 8 for s in x.sigs], dtype=np.int64)
        sig = np.frombuffer(b"".join(x.sigs), dtype=U64)
        own = np.repeat(np.arange(len(x)), lens)
        many = counts[(sig % U64(SLOTS)).astype(np.int64)].astype(np.int64) - mean
        often = np.flatnonzero(many >= max(FREQUENT, 2 * mean))
        if not len(often):
            return own, sig
        o = often[np.lexsort((sig[often], -many[often], own[often]))]
        first = np.concatenate([[True], own[o][1:] != own[o][:-1]])
        start = np.flatnonzero(first)
        rank = np.arange(len(o)) - np.repeat(start, np.diff(np.concatenate([start, [len(o)]])))
        keep = np.ones(len(sig), dtype=bool)
        keep[o[(rank < DROP) & (lens[own[o]] > NEED + DROP)]] = False
        own, sig, many = own[keep], sig[keep], many[keep]
        hot = many > SPLIT
        if hot.any():
            side = x.side.to_numpy()
            g = -(-many[hot] // SPLIT)
            a, b = np.ones(len(x), dtype=bool) if both else (side & 1) > 0, np.ones(len(x), dtype=bool) if both else (side & 2) > 0
            parts = [_split(own[hot][g == k], sig[hot][g == k], np.full(len(x), k), x.cid.to_numpy(), a, b, both) for k in np.unique(g)]
            own = np.concatenate([own[~hot], *[p[0] for p in parts]])
            sig = np.concatenate([sig[~hot], *[p[1] for p in parts]])
        return own, sig

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), at_once):
                x = whole.iloc[at : at + at_once]
                own, sig = prefix(x)
                bucket = ((sig >> U64(32)) % U64(buckets)).astype(np.int64)
                o = np.lexsort((own, bucket))
                own, bucket, token = own[o], bucket[o], sig[o].astype(np.uint32)
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]) if len(own) else np.zeros(0, dtype=bool)
                start = np.flatnonzero(new)
                most = np.diff(np.concatenate([start, [len(own)]]))
                docs = np.empty(len(start), dtype=DOC)
                docs["cid"], docs["n"], docs["side"] = x.cid.to_numpy()[own[start]], x.n.to_numpy()[own[start]], x.side.to_numpy()[own[start]]
                docs["tokens"] = np.minimum(most, 255)
                if len(most) and most.max() > 255:  # a split signature stands in many cells: such texts have several entries
                    times = -(-most // 255)
                    docs = np.repeat(docs, times)
                    step = np.arange(len(docs)) - np.repeat(np.cumsum(times) - times, times)
                    docs["tokens"] = np.minimum(np.repeat(most, times) - 255 * step, 255)
                    dbucket = np.repeat(bucket[start], times)
                else:
                    dbucket = bucket[start]
                dcut, pcut = np.searchsorted(dbucket, np.arange(buckets + 1)), np.searchsorted(bucket, np.arange(buckets + 1))
                draw, praw, dsize = docs.tobytes(), token.astype("<u4").tobytes(), DOC.itemsize
                held = np.flatnonzero(np.diff(pcut))
                yield pd.DataFrame({
                    "bucket": numbers[held],
                    "docs": [draw[dsize * dcut[b] : dsize * dcut[b + 1]] for b in held],
                    "posts": [praw[4 * pcut[b] : 4 * pcut[b + 1]] for b in held],
                })

    return sigs.select("cid", "side", "n", "sigs").mapInPandas(pack, "bucket int, docs binary, posts binary")


def _expand(ee: np.ndarray, e_n: np.ndarray, tt: np.ndarray, t_n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All combinations of run i of ee with run i of tt, in slices of about HITS."""
    t_at = np.cumsum(t_n) - t_n
    width = np.repeat(t_n, e_n)  # per left posting: partners
    start = np.repeat(t_at, e_n)
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(width):
        to = max(at + 1, int(np.searchsorted(total, total[at] + HITS, side="right")) - 1)
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = np.arange(len(left)) - np.repeat(total[at:to] - total[at], w) + np.repeat(start[at:to], w)
        yield ee[left], tt[right]
        at = to


def probe(x: pd.DataFrame, both: bool) -> pd.DataFrame:
    """One bucket: (a, b, hits, runs) of the classes that share signatures, left texts indexed and right ones probed."""
    d = np.frombuffer(b"".join(x.docs), dtype=DOC)
    token = np.frombuffer(b"".join(x.posts), dtype="<u4")
    cid, first, dense = np.unique(d["cid"], return_index=True, return_inverse=True)
    side = np.zeros(len(cid), dtype=np.uint8)
    np.bitwise_or.at(side, dense, d["side"])
    n = d["n"][first].astype(np.int64)
    doc = np.repeat(dense, d["tokens"])
    o = np.argsort((token.astype(U64) << U64(32)) | doc.astype(U64))
    token, doc = token[o], doc[o]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
    token, doc = token[new], doc[new]
    left, right = (np.ones(len(doc), dtype=bool),) * 2 if both else ((side[doc] & 1) > 0, (side[doc] & 2) > 0)
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
    ln, rn = np.bincount(group, left), np.bincount(group, right)
    meets = ((ln > 0) & (rn > 0) & (np.bincount(group) > 1))[group]
    left, right = left & meets, right & meets
    e, t = np.flatnonzero(left), np.flatnonzero(right)
    e_n, t_n = np.unique(group[e], return_counts=True)[1], np.unique(group[t], return_counts=True)[1]
    found: list[pd.DataFrame] = []
    held = 0
    for le, ri in _expand(doc[e], e_n, doc[t], t_n):
        keep = (le < ri) if both else (le != ri) & ~((side[le] == 3) & (side[ri] == 3) & (le > ri))
        le, ri = le[keep], ri[keep]
        p, q = n[le], n[ri]
        near = np.minimum(p, q) >= SIMILAR * np.maximum(p, q) - 1e-9
        lo, hi = np.minimum(le[near], ri[near]), np.maximum(le[near], ri[near])
        key, c = np.unique(lo * len(cid) + hi, return_counts=True)
        found.append(pd.DataFrame({"key": key, "hits": c}))
        held += len(key)
        if held > 2 * HITS:
            found = [pd.concat(found).groupby("key", as_index=False).hits.sum()]
            held = len(found[0])
    f = pd.concat(found).groupby("key", as_index=False).hits.sum() if found else pd.DataFrame({"key": np.zeros(0, np.int64), "hits": np.zeros(0, np.int64)})
    lo, hi = f.key.to_numpy() // max(len(cid), 1), f.key.to_numpy() % max(len(cid), 1)
    return pd.DataFrame({"a": cid[lo], "b": cid[hi], "hits": f.hits.to_numpy().astype(np.int32), "runs": np.maximum(n[lo], n[hi]).astype(np.int32)})


def signature_pairs(source: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, runs), a < b, and the texts (cid, text) of their classes, materialized.

    ``make`` gives (id, cid, side, salt, text) of the source's rows, id being their ``key``.

    A pair has NEED or more common signatures; runs are the larger text's
    distinct runs. side is 1 for texts of the left side, 2 for those of the
    right side; pairs have one text on each side, or any two with ``both``.
    Empty texts have no signatures; sizes differ by at most 1 : SIMILAR. Texts
    are made again from one row of each class, which the source is cut to first.
    """
    sigs = materialize(signed(make(source)))
    total = sigs.count()
    buckets = max(LEAST_BUCKETS, -(-total * SIGNATURES // BUCKET_POSTINGS))
    packed = postings(sigs, frequencies(sigs), buckets, both).repartition(buckets, "bucket")
    hits = packed.groupBy("bucket").applyInPandas(lambda x: probe(x, both), "a long, b long, hits int, runs int")
    x = hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hits", "runs").groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("runs").alias("runs"))
    pairs = materialize(x.where(F.col("hits") >= NEED).select("a", "b", "runs"))
    cids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    ids = materialize(keep_keys(sigs.select("cid", "id"), "cid", cids).groupBy("cid").agg(F.min("id").alias("id")).select("id").distinct())
    texts = keep_keys(make(keep_keys(source, key, ids.withColumnRenamed("id", key))).select("cid", "text"), "cid", cids)
    return pairs, materialize(texts.groupBy("cid").agg(F.min("text").alias("text")))
