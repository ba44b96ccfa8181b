import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import edits, leakage, mixing, overlap, packing, pairs, sampling, signatures, spam
from quern.llm.grams import char_sets, runs, token_sets

D = "/root/testdata/sf0.001"
MSG = "array<struct<role:string,content:string>>"
SFT = f"record_id long, messages {MSG}, source string, split string, images array<string>, task string, cid string, text string"


def chat(u, a):
    return [("user", u), ("assistant", a)]


def plain(ms):
    return "".join(c for r, t in ms or [] if r != "system" for c in (t or "").lower() if c.isalnum())


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def words(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def sft(spark):
    base = words(1)
    rows = [
        (1, chat(base, "yes"), "a", "train", ["x/p.png"], None, "c", "t"),
        (2, chat(base.replace("e", "E"), "yes"), "a", " Test ", ["y/p.png"], None, "c", "t"),
        (3, chat(base[:300] + " inserted words here " + base[300:], "yes"), "A ", None, ["p.png", "p.png"], None, "c", "t"),
        (4, chat(base, "yes"), "b", "TRAINING", None, None, "c", "t"),
        (5, chat(words(2), "no"), "b", "eval", [], None, "c", "t"),
        (6, None, None, None, None, None, None, None),
        (7, chat(None, ""), "b", "train", None, None, "c", "t"),
        (None, chat(base, "yes"), "b", "dev", None, None, "c", "t"),
        (8, chat(words(3, 20000), "no"), "b", "eval", [], None, "c", "t"),
    ]
    return spark.createDataFrame(rows, SFT)


def test_run_hashes():
    own, at, h = runs(["abcdefg", "", "xbcdefy", "ab"], 5)
    assert h[(own == 0) & (at == 1)] == h[(own == 2) & (at == 1)]
    assert [len(s) for s in char_sets(["aaaaaaaa", "", "abcd", "abcdef"])] == [1, 0, 0, 2]
    own, h = token_sets(["x" * 30, "", "y"], 40, 4, 8)
    assert list(np.bincount(own, minlength=3)) == [1, 0, 1]


def test_p1_small(sft):
    pairs_, members = overlap.cross_split_overlaps(sft)
    got = {tuple(r) for r in overlap.record_pairs(pairs_, members).collect()}
    assert got == {(1, 2), (2, 4), (1, 3), (3, 4)}
    p, m = overlap.cross_split_overlaps(sft.limit(0))
    assert overlap.record_pairs(p, m).count() == 0


def test_p4_small(sft):
    got = {(r.id, r.group) for r in edits.edit_groups(sft).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    assert edits.edit_groups(sft.limit(0)).count() == 0


def test_p4_edits_all_over_the_text(spark):
    base = ["".join(words(s).split()) for s in range(20, 30)]
    edited = ["".join("q" if i % 30 == 7 else c for i, c in enumerate(t)) for t in base]
    assert all(jaccard(a, b) >= 0.7 for a, b in zip(base, edited))
    rows = [(2 * i + k, [("user", x)], "a", "train", None, None, "c", "t") for i, t in enumerate(zip(base, edited)) for k, x in enumerate(t)]
    assert {(r.id, r.group) for r in edits.edit_groups(spark.createDataFrame(rows, SFT)).collect()} == {(i, i - i % 2) for i in range(20)}


@pytest.mark.parametrize("split", [20_000, 3])
def test_signatures_that_all_texts_share(spark, monkeypatch, split):
    def stock(texts):
        own = np.repeat(np.arange(len(texts)), 6)
        return own, np.tile(np.arange(6, dtype=np.uint64), len(texts)), np.full(len(texts), 600)

    monkeypatch.setattr(signatures, "order_signatures", stock)
    monkeypatch.setattr(signatures, "SPLIT", split)
    monkeypatch.setattr(signatures, "FREQUENT", 2)
    base = [words(s) for s in range(40, 46)]
    rows = [(2 * i + k, [("user", x)], "a", ("train", "test")[k], None, None, "c", "t") for i, t in enumerate(base) for k, x in enumerate((t, t + " and more"))]
    df = spark.createDataFrame(rows, SFT)
    assert {(r.id, r.group) for r in edits.edit_groups(df).collect()} == {(i, i - i % 2) for i in range(12)}
    assert {tuple(r) for r in overlap.record_pairs(*overlap.cross_split_overlaps(df)).collect()} == {(2 * i, 2 * i + 1) for i in range(6)}


@pytest.mark.parametrize("every", [30, 40, 60])
def test_p1_p4_scattered_edits(every):
    base = ["".join(words(s).split()) for s in range(20, 40)]
    edited = ["".join("q" if i % every == 7 else c for i, c in enumerate(t)) for t in base]
    for a, b in zip(base, edited):
        _, sig, n = signatures.order_signatures([a, b])
        _, own = np.unique(signatures.order_signatures([a, b])[0], return_counts=True)
        assert jaccard(a, b) < 0.7 or len(np.intersect1d(sig[: own[0]], sig[own[0] :])) >= signatures.NEED


def test_p1_p4_short_texts():
    for n in range(24, 81):
        a = "".join(words(n).split())[:n]
        b = a[: n // 2] + ("q" if a[n // 2] != "q" else "z") + a[n // 2 + 1 :]
        own, sig, _ = signatures.order_signatures([a, b])
        assert jaccard(a, b) < 0.7 or len(np.intersect1d(sig[own == 0], sig[own == 1])) >= signatures.NEED


def test_signature_frequencies_and_sizes(spark):
    texts = [words(1), words(1), words(2), "", "abcde", "ab"]
    rows = spark.createDataFrame([(i, i, 3, 0, t) for i, t in enumerate(texts)], "id long, cid long, side byte, salt long, text string")
    s = signatures.signed(rows)
    counts = signatures.frequencies(s)
    assert counts.sum() == sum(len(r.sigs) // 8 for r in s.collect())
    own, sig, size = signatures.order_signatures(texts)
    assert [int(n) for n in size] == [len(x) if len(t) >= 5 else int(bool(t)) for x, t in zip(char_sets(texts), texts)] and (sig[own == 0] == sig[own == 1]).all()


def test_buckets_have_a_partition_each(spark):
    for n in (1, 2, 16, 37):
        numbers = signatures.spread(spark, n)
        assert len(set(numbers.tolist())) == n
        x = spark.createDataFrame([(int(i),) for i in numbers], "bucket int").repartition(n, "bucket")
        assert x.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= (1 if n > 2 else 2)


def test_p4_alignment_and_moved_parts(spark):
    t = "".join(words(60, 200).split())
    far = t[400:] + t[:400]
    pairs_ = spark.createDataFrame([(1, 2, 700, t, t[:50] + "x" + t[51:]), (3, 4, 700, t, far), (5, 6, 700, t, "".join(words(61, 200).split())), (7, 8, 0, t, t)], "a long, b long, runs int, text_a string, text_b string")
    assert {tuple(r) for r in edits.verified(pairs_).collect()} == {(1, 2, 1), (3, 4, None), (7, 8, 0)}


def test_p1_edits_all_over_the_text(spark):
    base = ["".join(words(s).split()) for s in range(20, 30)]
    rows = [(2 * i + k, [("user", x)], "a", ("train", "test")[k], None, None, "c", "t") for i, t in enumerate(base) for k, x in enumerate((t, "".join("q" if j % 30 == 7 else c for j, c in enumerate(t))))]
    found = overlap.record_pairs(*overlap.cross_split_overlaps(spark.createDataFrame(rows, SFT)))
    assert {tuple(r) for r in found.collect()} == {(2 * i, 2 * i + 1) for i in range(10)}


@pytest.fixture(scope="module")
def truth(spark):
    rows = spark.read.parquet(f"{D}/sft_records.parquet").select("record_id", "messages", "split", "images").collect()
    t = [(r.record_id, plain([(m.role, m.content) for m in r.messages]), (r.split or "").strip().lower() in ("train", "training"), frozenset(i.split("/")[-1] for i in r.images or [])) for r in rows]
    sets = [frozenset(x[1][i : i + 5] for i in range(len(x[1]) - 4)) for x in t]
    close = [(i, j) for i in range(len(t)) for j in range(i) if (n := len(sets[i] & sets[j])) and n >= 0.7 * (len(sets[i]) + len(sets[j]) - n)]
    return t, close


def test_p1_brute_force(spark, truth):
    t, close = truth
    want = {tuple(sorted((t[i][0], t[j][0]))) for i, j in close if t[i][2] != t[j][2]}
    assert {tuple(r) for r in overlap.p1_found(spark, D).collect()} == want


def test_p4_brute_force(spark, truth):
    t, close = truth
    want = {tuple(sorted((t[i][0], t[j][0]))) for i, j in close if t[i][3] == t[j][3]}
    assert {tuple(r) for r in edits.p4_found(spark, D).collect()} == want


def test_p2_small(spark):
    q = words(5, 40)
    train = spark.createDataFrame([
        (1, chat(words(6) + q + words(7), "a")), (2, chat('[{"type":"image"},{"type":"text","text":"' + q.upper() + '"}]', "b")), (3, chat(q[: len(q) // 4] + words(8), "c")),
        (4, [("system", q)]), (5, None), (6, chat(words(9), q[len(q) // 3 :])), (None, chat(q, "x")),
    ], f"row_id long, messages {MSG}")
    items = spark.createDataFrame([(10, q), (11, q), (12, ""), (13, None), (None, q), (14, words(10, 40))], "item_id long, text string")
    got = {(r.row_id, r.item_id) for r in leakage.leaked_items(train, items).collect()}
    assert got == {(r, i) for r in (1, 2, 6) for i in (10, 11)}
    assert leakage.leaked_items(train.limit(0), items).count() == 0 and leakage.leaked_items(train, items.limit(0)).count() == 0


def test_p2_stretches_in_several_messages(spark):
    q = "".join(words(70, 90).split())[:400]
    half = [chat(words(71) + " " + q[:110] + "." + words(72), words(73) + "! " + q[200:310] + " " + words(74))]
    train = spark.createDataFrame([(1, half[0]), (2, [half[0][0]]), (3, chat(q[:30], q[30:60]))], f"row_id long, messages {MSG}")
    items = spark.createDataFrame([(10, q)], "item_id long, text string")
    assert [(r.row_id, round(r.share, 3)) for r in leakage.leaked_items(train, items).collect()] == [(1, 0.55)]


def test_p2_stretches_far_apart():
    for seed in (917, 921, 1737):
        r = random.Random(seed)
        letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        item = letters(540)
        message = "".join(item[i : i + 68] + letters(2100) for i in (0, 130, 260, 390))
        assert [x[:2] for x in leakage.Items([1], [item]).leaks([message])] == [(0, 0)]


@pytest.mark.parametrize("question, answer, task, defect", [
    ("What is the profit?", "", None, "empty"), ("What is the profit?", None, None, "empty"), ("What is it?", "N/A", None, "empty"), ("Was ist es?", "Antwort:", None, "empty"), ("What is it?", "<answer></answer>", None, "empty"),
    ("What is the profit?", "I'm sorry, but I can't answer that. The material concerns Acme.", None, "refusal"), ("请说明利润。", "抱歉，我无法提供此类信息。", "x", "refusal"), ("Wie hoch?", "Leider kann ich dazu keine Auskunft geben.", None, "refusal"),
    ("Give advice.", "I cannot help with this request.", "Compliance-Safety-Suitability", None), ("Read.\nWhat was the margin of the group in 2020?", "Question: what was the margin of the group in 2020", None, "copies_question"),
    ("Explain how the group did in the year and what it means.", "集团当年收入增长，主要因为海外业务扩张，利润率保持稳定。", None, "other_language"), ("Explain how the group did. Please answer in Chinese.", "集团当年收入增长，主要因为海外业务扩张，利润率保持稳定。", None, None),
    ("What happened in the year?", "The revenue of the group rose by 5% because of the new contracts and the", None, "truncated"), ("Table?", "| a | b |\n|---|---|\n| 1 | 2", None, "truncated"), ("JSON?", '{"a": "b", "c', None, "truncated"),
    ("利润如何？", "董事会批准毛利合计143.21亿港元，两个季度内波动64.1%；供应商停工下调了研发", None, "truncated"), ("利润如何？", "毛利合计143.21亿港元", None, None),
    ("What happened?", "The group sold its plant (as the board had announced in the spring of the year.", None, "truncated"), ("What happened?", "The group sold its plant (as announced). It rose.", None, None),
    ("JSON?", '{"a": "b"}', None, None), ("Which?", "B. 12.3%", None, None), ("What was it?", "The figure is in the table.\nAnswer: $3.2 million", None, None), ("Which tone?", "neutral", None, None), ("Chart?", "The exact figure cannot be read from the first chart, but the second one gives it.", None, None),
])
def test_p5_rules(spark, question, answer, task, defect):
    df = spark.createDataFrame([(1, chat(question, answer), task)], f"record_id long, messages {MSG}, task string")
    got = [r.defect for r in pairs.first_defect(pairs.pair_defects(df)).collect()]
    assert got == ([defect] if defect else [])


def test_p5_missing_parts(spark, sft):
    df = spark.createDataFrame([(1, None, None), (2, [("user", "hello?")], None), (3, [("assistant", "fine, thank you.")], None), (None, None, None)], f"record_id long, messages {MSG}, task string")
    assert {tuple(r) for r in pairs.first_defect(pairs.pair_defects(df)).collect()} == {(1, "empty"), (2, "empty")}
    assert pairs.pair_defects(df.limit(0)).count() == 0


def test_p3_sample(spark):
    rows = spark.createDataFrame([(i, "Big" if i % 10 else "small", None if i % 7 == 0 else "s") for i in range(1000)] + [(None, "big", "s")], "record_id long, task string, source string")
    targets = spark.createDataFrame([("p", "big", None, 0.6, 5), ("p", "small", None, 0.39, 5), ("p", "none", None, 0.01, 2), ("q", None, "s", 1.0, 3), (None, "big", None, 0.5, 1)], "plan_name string, task string, source string, target_share double, min_rows int")
    drawn, report = sampling.calibrated_sample(rows, targets, size=100)
    r = {(x.plan_name, x.task): x for x in report.collect()}
    assert r["p", "none"].status == "absent" and abs(r["p", "big"].sampled - r["p", "big"].target_rows) <= 1 and r["q", None].sampled == 100
    ids = [tuple(x) for x in drawn.collect()]
    assert len(ids) == len(set(ids))
    assert sampling.calibrated_sample(rows.limit(0), targets)[0].count() == 0 and sampling.calibrated_sample(rows, targets.limit(0))[0].count() == 0


def test_p3_pivotal_keeps_the_sum():
    rng = np.random.default_rng(1)
    p = rng.random(501)
    q, left = sampling.pivotal(p, rng.random(501))
    assert abs(q.sum() - p.sum()) < 1e-6 and sum((q > 0) & (q < 1)) == (left >= 0)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "S1" if i % 2 else " s2 ") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_p7_containers(spark):
    texts = [words(i, n) for i, n in enumerate([1, 3, 5, 400, 40, 40, 80, 7, 9, 200])] + ["", None]
    specs = spark.createDataFrame([("c", 256), ("d", 64), (None, 5), ("z", 0)], "pack_name string, capacity_tokens int")
    out = packing.pack(docs(spark, texts), specs).collect()
    use = {}
    for r in out:
        use[r.container] = use.get(r.container, 0) + r.tokens
    assert all(v <= (256 if k.startswith("c") else 64) for k, v in use.items())
    totals = {n: sum(r.tokens for r in out if r.pack_name == n) for n in "cd"}
    assert totals["c"] == totals["d"] > 0 and {r.doc_id for r in out} == set(range(10))
    assert packing.pack(docs(spark, ["x"]).limit(0), specs).count() == 0 and packing.pack(docs(spark, texts), specs.limit(0)).count() == 0


def test_p8_mixture(spark):
    assert mixing.sainte_lague([0.5, 0.3, 0.2], 10, [10, 10, 10]) == [5, 3, 2] and mixing.sainte_lague([0.5, 0.5], 10, [2, 10]) == [2, 8]
    targets = spark.createDataFrame([("s1", 0.5, 2), ("S2", 0.3, 1), ("gone", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    picked, report = mixing.mixture(docs(spark, [words(i, 60) for i in range(200)] + ["", None]), targets)
    r = {x.source: x for x in report.collect()}
    assert abs(r["s1"].actual_share - 0.625) < 0.02 and r["gone"].tokens == 0 and r["s1"].most_copies <= 2 and r["s2"].most_copies <= 1
    assert mixing.mixture(docs(spark, ["x"]).limit(0), targets)[0].count() == 0


def test_p9_pages(spark):
    good = "The board said that the revenue of the group rose in the year. It was helped by the new plant, and the margin was flat. Costs fell as the old site was closed by the firm."
    pages = [good, "buy gold / loan now / buy gold / loan now / " * 20, "Tags: a, b\n#gold #loan\nhttps://x.test/a\n" * 5, good + "\nhttps://a.test/x\nhttps://b.test/y", "| 2014 | 1,2 |\n|---|---|\n| 2015 | 3,4 |", "", None, "Why cheap loan? Because cheap loan beats every other cheap loan. Get cheap loan with cheap loan today! " * 8]
    assert sorted(r.doc_id for r in spam.spam_pages(docs(spark, pages)).collect()) == [1, 2, 7]
    assert spam.spam_pages(docs(spark, pages).limit(0)).count() == 0


def test_p8_highest_quotients():
    def plain_way(w, seats, caps):
        given = [0] * len(w)
        for _ in range(min(seats, sum(c for x, c in zip(w, caps) if x > 0))):
            given[max((i for i in range(len(w)) if given[i] < caps[i] and w[i] > 0), key=lambda i: (w[i] / (2 * given[i] + 1), -i))] += 1
        return given

    assert mixing.sainte_lague([40] + [0.6] * 100, 100, [1000] * 101)[0] == 33
    r = random.Random(3)
    for _ in range(3000):
        n = r.randint(1, 12)
        w, caps = [r.choice([0, 1, 2, 3, r.random() * 10]) for _ in range(n)], [r.randint(0, 30) for _ in range(n)]
        seats = r.randint(0, 120)
        assert mixing.sainte_lague(w, seats, caps) == plain_way(w, seats, caps)


def test_p3_bounded_calibration():
    counts, member = np.array([10.0, 50.0, 10.0]), np.array([[1.0, 0], [1, 1], [0, 1]])
    for aim in (20, 55, 58, 59.9):
        p = sampling.calibrate(counts, member, np.array([aim, aim]), 0.1)
        assert p.max() <= 1 and np.allclose(member.T @ (counts * p), aim, atol=1e-4)
    r = np.random.default_rng(5)
    for _ in range(200):
        m = (r.random((12, 4)) < 0.4).astype(float)
        n, true = r.integers(1, 500, 12).astype(float), r.random(12)
        aim = m.T @ (n * true)
        p = sampling.calibrate(n, m, aim, 0.1)
        assert p.max() <= 1 and np.abs(m.T @ (n * p) - aim).max() < 0.5


def test_p7_repeated_id_over_the_capacity(spark):
    x = docs(spark, [words(1, 200)]).union(docs(spark, [words(1, 200)]))
    specs = spark.createDataFrame([("c", 64)], "pack_name string, capacity_tokens int")
    use = {}
    for r in packing.pack(x, specs).collect():
        use[r.container] = use.get(r.container, 0) + r.tokens
    assert max(use.values()) <= 64


def test_p9_bare_links_and_other_languages(spark):
    links = "\n".join(f"https://www.abc{i}.test/list{i}" for i in range(12))
    russian = "Совет сообщил, что выручка группы выросла за год. " * 2 + "Этому помог новый завод, а маржа не изменилась. Расходы упали, так как старый цех закрыли.\nhttps://a.test/x\nhttps://b.test/y"
    spam_ru = "купить кредит дешево онлайн\nкупить кредит срочно онлайн\nhttps://a.test/x\n" * 9
    rows = [(0, links, "en", "s"), (1, links[:30], "en", "s")] + [(10 + i, russian, "ru", "s") for i in range(9)] + [(30, spam_ru, "ru", "s"), (31, links.replace("\n", " "), "en", "s")]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in spam.spam_pages(x).collect()) == [0, 30, 31]
