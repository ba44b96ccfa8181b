import json

from pyspark.sql import functions as F

from quern.functions import models as M
from quern.streaming import tail as T


def test_top_per_window_over_several_runs(spark, tmp_path):
    src, out, at = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def add(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"step": s, "reward": r}) for s, r in rows) + "\nbroken\n")

    def run():
        T.keep_top(T.new_rows(spark, src, "step long, reward double"), out, at, "step", 10, 2, lambda: [F.desc("reward"), F.col("step")]).awaitTermination()
        return sorted((r.window, r.step, r.reward) for r in T.latest(spark, out).collect())

    add("a.jsonl", [(1, 0.5), (2, 0.9), (3, 0.1), (11, 0.2)])
    assert run() == [(0, 1, 0.5), (0, 2, 0.9), (1, 11, 0.2)]
    add("b.jsonl", [(4, 0.7), (12, 0.1), (25, 1.0)])
    assert run() == [(0, 2, 0.9), (0, 4, 0.7), (1, 11, 0.2), (1, 12, 0.1), (2, 25, 1.0)]
    assert run() == [(0, 2, 0.9), (0, 4, 0.7), (1, 11, 0.2), (1, 12, 0.1), (2, 25, 1.0)]


def test_append_missing(spark, tmp_path):
    out = str(tmp_path / "o")
    work = lambda x: x.withColumn("twice", F.col("id") * 2)
    assert [T.append_missing(spark.range(n), "id", out, work) for n in (3, 5, 5)] == [3, 2, 0]
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]


def factory():
    def client(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [f'say ```json\n{{"score": {len(p)}}}\n```' for p in prompts]

    return client


def test_replies_and_rules(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "bad", None), (3, None, None), (4, "zz", 7)], "id long, p string, r long")
    got = {r.id: r for r in M.judged(df, "id", F.col("p"), factory, "score long").collect()}
    assert got["1"].verdict.score == 3 and got["1"].error is None and "RuntimeError" in got["2"].error and got["3"].error == "no JSON in the reply"
    both = M.rule_then_model(df, "id", F.col("r"), F.col("p"), factory, lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("long"))
    assert {tuple(r) for r in both.collect()} == {("4", 7, "rule"), ("1", 3, "model"), ("2", None, "error"), ("3", None, "model")}
    assert M.json_answer('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and M.json_answer("none {") is None
