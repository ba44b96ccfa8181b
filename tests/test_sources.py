import json

import pytest
from pyspark.sql import functions as F

from quern.sources import files as S
from quern.sources import sinks as K

SCHEMA = "id long, text string"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text('﻿{"id": 1, "text": "x"}\n\n{"id": 2, "text": "y", "more": 1}\n', encoding="utf-8")
    (tmp_path / "a" / "two.jsonl").write_text('{"id": 3}\n{"id": \n[1]\n{"id": "no"}\n{"id": 4} tail\n', encoding="utf-8")
    return tmp_path


def test_lines_are_numbered_by_file(spark, folder):
    big = folder / "big.txt"
    big.write_text("\n".join(str(i) for i in range(1, 30001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert S.lines(spark, str(big)).where("line <> cast(value as long)").count() == 0
        assert S.lines(spark, str(big)).count() == 30000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strict_and_permissive(spark, folder):
    good = S.jsonl(spark, str(folder / "a" / "one.jsonl"), SCHEMA)
    assert [(r.line, r.id, r.text) for r in good.orderBy("line").collect()] == [(1, 1, "x"), (3, 2, "y")]
    with pytest.raises(Exception, match="invalid JSON in .*two.jsonl:[235]"):
        S.jsonl(spark, str(folder / "a" / "two.jsonl"), SCHEMA).collect()
    assert S.jsonl_permissive(spark, str(folder / "none.jsonl"), SCHEMA).count() == 0
    rows, broken = S.jsonl_lanes(spark, str(folder), SCHEMA)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3]
    assert sorted((r.line, r.reason) for r in broken.collect()) == [(2, "invalid_json"), (3, "not_an_object"), (4, "wrong_type"), (5, "invalid_json")]


def test_objects_over_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('junk {"a": "1\n2", "b": {"c": [1, "}"]}}{"a": 2}\n{"a": \n 3} {"a": 4', encoding="utf-8")
    got = [r.value for r in S.objects(spark, str(tmp_path / "x.json"), lambda t: t + "}").orderBy("ordinal").collect()]
    assert [json.loads(v)["a"] for v in got] == ["1\n2", 2, 3, 4]


def test_records_by_suffix(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "e.json").write_text('{"n": 1, "items": [{"a": 3}]}')
    (tmp_path / "o.json").write_text('{"a": 4}')
    (tmp_path / "c.csv").write_text('a,b\n5,"x, y"\n')
    (tmp_path / "t.tsv").write_text("a\tb\n6\t\n7\tz\n")
    (tmp_path / "m.md").write_text("# title\nbody")
    (tmp_path / "j.jsonl").write_text('{"a": 8}\n\n{"a": 9}\n')
    spark.range(2).toDF("a").write.parquet(str(tmp_path / "p.parquet"))
    got = {n: [json.loads(r.value) for r in S.records(spark, str(tmp_path / n)).orderBy("ordinal").collect()] for n in ("l.json", "e.json", "o.json", "c.csv", "m.md", "j.jsonl", "p.parquet")}
    assert got["l.json"] == [{"a": 1}, {"a": 2}] and got["e.json"] == [{"a": 3}] and got["o.json"] == [{"a": 4}]
    assert got["c.csv"] == [{"a": "5", "b": "x, y"}] and got["m.md"] == [{"text": "# title\nbody"}] and got["j.jsonl"] == [{"a": 8}, {"a": 9}]
    assert sorted(r["a"] for r in got["p.parquet"]) == [0, 1]
    assert [r.a for r in S.delimited(spark, str(tmp_path / "t.tsv"), needed=["b"]).collect()] == ["7"]
    with pytest.raises(ValueError):
        S.records(spark, "x.bin")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, k string")
    assert K.write_distinct(df, str(tmp_path / "d"), F.col("k"), "id") == {"written": 3, "duplicates": 2}
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "d")).collect()) == [1, 3, 5]
    out = str(tmp_path / "t")
    K.publish(df, out, {"no id": F.col("id").isNull()})
    with pytest.raises(ValueError, match="no key': 2"):
        K.publish(df, out, {"no key": F.col("k").isNull()})
    K.publish(spark.read.parquet(out).where("id > 2"), out, keep_backup=True)
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(out + ".bak").count() == 5
    lanes = K.write_lanes(df, str(tmp_path / "l"), F.when(F.col("k").isNull(), "broken").otherwise("clean"))
    assert {tuple(r) for r in lanes.collect()} == {("broken", 2), ("clean", 3)}
    found, total = K.manifest(spark, out)
    assert total["files"] == found.count() > 0 and total["bytes"] > 0


def test_files_joined_by_stem(spark, tmp_path):
    for d, names in (("x", ("1.txt", "2.txt")), ("y", ("2.md", "3.md"))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(d + n)
    got = S.joined_by_stem(spark, {"left": str(tmp_path / "x"), "right": str(tmp_path / "y")}).collect()
    assert [tuple(r) for r in got] == [("2", "x2.txt", "y2.md")]
