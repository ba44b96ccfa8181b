"""Problem 2: evaluation texts leaking into training text.

Size-partitioned MinHash containment search (Zhu et al., LSH Ensemble, 2016).
Test items are the stated query set: an index of them (1.5 KB an item) is sent
to all tasks, ITEMS_AT_ONCE items for one pass over all training rows.

An item is the set of runs of MER units of its letters and digits (a CJK
character counts WIDE units). Items are partitioned by size into classes of
128, 256, 512 ... runs. A row's text is cut into blocks of 128 runs; a hash sends a
run to one of BINS bins, and the smallest hash per bin of a window is the
window's MinHash (one permutation, BINS bands of one row). Items of a class
meet windows of twice the class's size at steps of half a window, so that the
sizes differ by a bounded factor, whatever the text's length, and one
equal MinHash makes a candidate, as an item's stretches may lie in different
windows. Runs that stand in more than STOCK of all
items (stock instruction lines) don't count for the search, unless they are
over a third of an item.

A candidate is verified by exact containment: of the item's letters and
digits, those that lie in unbroken stretches of LONG characters (SHORT for
Chinese items) that also stand in a message of the row are counted, and it
leaks if they are LEAK or more of the item. A row's messages are searched
together, as one may hold an item's first stretches and the next the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.grams import NONE, U64, chunks, runs
from quern.llm.records import plain, role

MER, WIDE, BLOCK, BINS = 24, 3, 128, 128
LONG, SHORT, LEAK = 60, 20, 0.5
ITEMS_AT_ONCE, STOCK = 50_000, 8
BITS, FILTER = 1 << 22, 1 << 15


def decoded(content: Column) -> Column:
    """A message's text; a JSON list of parts gives the texts of its parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    as_list = F.ltrim(content).startswith("[") & parts.isNotNull()
    return F.when(as_list, F.concat_ws("", F.transform(parts, lambda p: p["text"]))).otherwise(content)


def row_texts(train: DataFrame) -> DataFrame:
    """(row_id, text): the plain texts of a row's user and assistant messages, a blank between them.

    No run of an item holds a blank, so each stretch stands in one message.
    """
    said = F.filter("messages", lambda m: role(m).isin("user", "assistant"))
    text = F.array_join(F.transform(said, lambda m: plain(decoded(m["content"]))), " ")
    return train.where("row_id is not null").select("row_id", text.alias("text")).where("length(text) > 0")


def is_chinese(t: str) -> bool:
    return 2 * sum("㐀" <= c <= "鿿" for c in t) > len(t)


class Items:
    """A block of test items, ready for the search."""

    def __init__(self, ids: list[int], texts: list[str], frequent: np.ndarray | None = None):
        """frequent: the runs of more than STOCK items, sorted; counted among these items if it isn't given."""
        self.ids, self.texts = np.array(ids, dtype=np.int64), texts
        self.least = [SHORT if is_chinese(t) else LONG for t in texts]
        own, _, h = runs(texts, MER, WIDE)
        o = np.lexsort((h, own))
        own, h = own[o].astype(np.int64), h[o]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, bool)
        own, h = own[new], h[new]
        v, inverse, c = np.unique(h, return_inverse=True, return_counts=True)
        stock = c[inverse] > STOCK if frequent is None else np.isin(h, frequent)
        share = np.bincount(own, stock, minlength=len(texts)) / np.maximum(np.bincount(own, minlength=len(texts)), 1)
        stock &= (share <= 1 / 3)[own]
        always = np.isin(h, h[~stock])
        self.stock = np.unique(h[~always])
        own, h = own[always], h[always]
        size = np.bincount(own, minlength=len(texts))
        level = np.ceil(np.log2(np.maximum(size, BLOCK) / BLOCK)).astype(int)
        bins = (h % U64(BINS)).astype(np.int64)
        o = np.lexsort((h, bins, own))
        own, h, bins = own[o], h[o], bins[o]
        lowest = np.concatenate([[True], (own[1:] != own[:-1]) | (bins[1:] != bins[:-1])]) if len(h) else np.zeros(0, bool)
        own, h = own[lowest], h[lowest]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(level[size > 0]):
            sel = level[own] == k
            o = np.argsort(h[sel], kind="stable")
            hs = h[sel][o]
            seen = np.zeros(BITS, dtype=bool)
            seen[hs % U64(BITS)] = True
            self.levels[int(k)] = (hs, own[sel][o], seen)
        self.bits = np.zeros(BITS, dtype=bool)
        self.bits[self.stock % U64(BITS)] = True
        self.long_runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of the item's least stretch, in order, and their places in a small filter."""
        if i not in self.long_runs:
            k = self.least[i]
            h = runs([self.texts[i]], k)[2] if len(self.texts[i]) >= k else np.zeros(0, dtype=U64)
            self.long_runs[i] = h, (h % U64(FILTER)).astype(np.int32)
        return self.long_runs[i]

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(message, item) that share a MinHash in some window."""
        own, at, h = runs(texts, MER, WIDE)
        out: set[tuple[int, int]] = set()
        if not len(h):
            return out
        if len(self.stock):
            hit = np.flatnonzero(self.bits[h % U64(BITS)])
            hit = hit[np.isin(h[hit], self.stock)]
            h = h.copy()
            h[hit] = NONE
        blocks = np.bincount(own, minlength=len(texts))
        blocks = -(-blocks // BLOCK)
        base = np.concatenate([[0], np.cumsum(blocks)])
        of = np.repeat(np.arange(len(texts)), blocks)
        low = np.full((base[-1], BINS), NONE, dtype=U64)
        first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])[:-1]
        where = base[own] + (np.arange(len(h)) - first[own]) // BLOCK
        bins = (h % U64(BINS)).astype(np.int64)
        real = h != NONE
        np.minimum.at(low, (where[real], bins[real]), h[real])
        window, reach = low, 1  # windows of `reach` blocks, from every block on
        for k in range(max(self.levels, default=-1) + 1):
            while reach < 2 << k:
                wider = window.copy()
                if len(wider) > reach:
                    same = (of[reach:] == of[:-reach])[:, None]
                    np.minimum(window[:-reach], np.where(same, window[reach:], NONE), out=wider[:-reach])
                window, reach = wider, reach * 2
            if k not in self.levels:
                continue
            hs, items, seen = self.levels[k]
            step = max(1, reach // 2)
            rows = np.flatnonzero((np.arange(len(of)) - base[of]) % step == 0)
            flat = window[rows]
            r, b = np.nonzero(seen[flat % U64(BITS)])
            value = flat[r, b]
            lo, hi = np.searchsorted(hs, value, "left"), np.searchsorted(hs, value, "right")
            n = hi - lo
            r, lo, n = r[n > 0], lo[n > 0], n[n > 0]
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            key = np.unique(of[rows[np.repeat(r, n)]].astype(np.int64) * len(self.texts) + items[pos])
            out.update(zip((key // len(self.texts)).tolist(), (key % len(self.texts)).tolist()))
        return out

    def leaks(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text, item, share) of every leak; all candidates of a text are verified at once."""
        out: list[tuple[int, int, float]] = []
        by_text: dict[tuple[int, int], list[int]] = {}
        for m, i in sorted(self.candidates(texts)):
            if len(texts[m]) >= self.least[i] <= len(self.texts[i]):
                by_text.setdefault((self.least[i], m), []).append(i)
        bits = np.zeros(FILTER, dtype=bool)
        for k in sorted({k for k, _ in by_text}):
            own, _, h = runs(texts, k)
            cut = np.searchsorted(own, np.arange(len(texts) + 1))
            place = (h % U64(FILTER)).astype(np.int32)
            for m, items in ((m, x) for (q, m), x in by_text.items() if q == k):
                here = slice(cut[m], cut[m + 1])
                bits[place[here]] = True
                held = [self.runs_of(i) for i in items]
                found = np.flatnonzero(bits[np.concatenate([p for _, p in held])])
                bits[place[here]] = False
                if not len(found):
                    continue
                there, asked = np.sort(h[here]), np.concatenate([r for r, _ in held])[found]
                found = found[there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked]
                start = np.concatenate([[0], np.cumsum([len(r) for r, _ in held])])
                which = np.searchsorted(start, found, "right") - 1
                for j in np.unique(which):
                    at = found[which == j] - start[j]
                    # each run covers k characters, less what the next one covers as well
                    share = (k + np.minimum(np.diff(at), k).sum()) / len(self.texts[items[j]])
                    if share >= LEAK - 1e-12:
                        out.append((m, items[j], float(share)))
        return out


def frequent_runs(items: DataFrame) -> np.ndarray:
    """The runs that stand in more than STOCK items, sorted; their number is bounded by the items' letters over STOCK."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own, _, h = runs(list(x.text), MER, WIDE)
            yield pd.DataFrame({"own": own, "h": h.view(np.int64)}).drop_duplicates()[["h"]]

    found = items.select("text").mapInPandas(distinct, "h long").groupBy("h").count().where(F.col("count") > STOCK).select("h").toPandas()
    return np.sort(found.h.to_numpy(dtype=np.int64).view(U64))


def leaked_items(train: DataFrame, items: DataFrame) -> DataFrame:
    """(row_id, item_id, share): every training row and test item that leaks into its messages.

    ``items`` has item_id and text. Items are read by the driver in blocks of
    ITEMS_AT_ONCE, one pass over the training rows each; those are never
    gathered. Items without text or shorter than the least stretch leak
    nowhere; null ids are left out; repeated rows and items each come out
    under their own ids; empty tables give an empty result.
    """
    texts_ = row_texts(train)
    found = None
    held = items.where("item_id is not null and text is not null").select("item_id", plain(F.col("text")).alias("text"))
    frequent = frequent_runs(held)
    blocks = max(1, -(-held.count() // ITEMS_AT_ONCE))
    for b in range(blocks):
        block = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        ids, texts = [r.item_id for r in block], [r.text for r in block]

        def search(batches: Iterator[pd.DataFrame], ids: list = ids, texts: list = texts) -> Iterator[pd.DataFrame]:
            index = Items(ids, texts, frequent)
            for x in batches:
                everything, rows = list(x.text), x.row_id.to_numpy()
                for lo, hi in chunks(everything):
                    hits = index.leaks(everything[lo:hi])
                    if hits:
                        m, i, s = zip(*hits)
                        yield pd.DataFrame({"row_id": rows[lo:hi][list(m)], "item_id": index.ids[list(i)], "share": s})

        one = texts_.mapInPandas(search, "row_id long, item_id long, share double")
        found = one if found is None else found.union(one)
    return found.groupBy("row_id", "item_id").agg(F.max("share").alias("share"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/bench_candidates.parquet").select(F.col("candidate_id").alias("item_id"), F.col("question").alias("text"))
    return leaked_items(spark.read.parquet(f"{d}/train_multi_sft_minhash_dedup.parquet"), items)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Training rows and the test items whose question stands in them wholly or partly."""
    return _leaks(spark, d).select("row_id", F.col("item_id").alias("candidate_id"))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: rows that hold it and the largest share found."""
    return _leaks(spark, d).groupBy(F.col("item_id").alias("candidate_id")).agg(F.count("*").alias("rows"), F.max("share").alias("largest_share"))
