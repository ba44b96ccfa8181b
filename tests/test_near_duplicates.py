import random

import numpy as np

from quern.operators import near_duplicates as N

M = (1 << 64) - 1


def mix(v):
    v ^= v >> 30
    v = v * 0xBF58476D1CE4E5B9 & M
    v ^= v >> 27
    v = v * 0x94D049BB133111EB & M
    return v ^ v >> 31


def plain_signature(t, perm=128, n=5):
    if not t:
        s = {0}
    elif len(t) <= n:
        s = {mix(sum((i + 1) * ord(c) for i, c in enumerate(t)) & M)}
    else:
        s = {mix(sum(ord(t[i + k]) * 257 ** (n - 1 - k) for k in range(n)) & M) for i in range(len(t) - n + 1)}
    seeds = [mix(0x9E3779B97F4A7C15 * (i + 1) & M) for i in range(perm)]
    return [min(mix(h ^ x) for h in s) for x in seeds]


def plain_kept(texts):
    kept = []
    for i, t in enumerate(texts):
        s = plain_signature(t)
        near = (sum(a == b for a, b in zip(s, k)) / 128 >= 0.9 for _, _, k in kept if any(s[8 * b : 8 * b + 8] == k[8 * b : 8 * b + 8] for b in range(16)))
        if all(t != u for _, u, _ in kept) and not any(near):
            kept.append((i, t, s))
    return [i for i, _, _ in kept]


def test_signatures_equal_the_plain_ones():
    for t in ("", "a", "abcde", "abcdef", "利润如何变化", "the group sold its plant " * 30):
        assert [int(v) for v in N.signature(t)] == plain_signature(t)


def test_kept_rows_equal_the_greedy_pass(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(6)]
    texts = ["", "", "abc", "abc"]
    for t in base:
        for _ in range(6):
            t = list(t)
            for _ in range(r.choice([1, 1, 2, 8])):
                t[r.randrange(len(t))] = r.choice("xyz")
            t = "".join(t)
            texts.append(t)
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t or None, 7) for i, t in enumerate(texts)], "ord long, text string, sig int")
    assert sorted(x.ord for x in N.kept_rows(df, "ord", df.text).collect()) == plain_kept(texts)
    assert N.kept_rows(df.limit(0), "ord", df.text).count() == 0


def test_a_dropped_row_drops_nothing(spark, monkeypatch):
    # A ~ B, B ~ C, A and C apart: A and C are kept
    sig = {"A": np.arange(128), "B": np.where(np.arange(128) < 10, 900, np.arange(128)), "C": np.where(np.arange(128) < 20, 900, np.arange(128))}
    monkeypatch.setattr(N, "signature", lambda t, *_: np.array(sig[t], dtype=np.uint64))
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "ord long, text string")
    assert sorted(x.ord for x in N.kept_rows(df, "ord", df.text).collect()) == [1, 3]
