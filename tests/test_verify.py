from decimal import Decimal

import pytest

from quern.functions import verify as V


@pytest.mark.parametrize("text, value, unit, base", [
    ("3.5亿元", "3.5", "亿元", "350000000.0"), ("人民币12万元", "12", "万元", "120000"), ("$3.2 million", "3.2", "million美元", "3200000.0"), ("12.5％", "12.5", "%", "0.125"), ("1,234.5", "1234.5", "", "1234.5"),
    ("3个百分点", "3", "百分点", "3"), ("2 percentage points", "2", "百分点", "2"), ("-7 HKD", "-7", "港元", "-7"), ("5家", "5", "count", "5"), ("4千美元", "4", "千美元", "4000"),
])
def test_quantities(text, value, unit, base):
    q = V.quantity(text)
    assert (q.value, q.unit, q.base) == (Decimal(value), unit, Decimal(base))


def test_programs():
    assert V.run_program("subtract(120,100),divide(#0,100),multiply(#1,100)") == (20, None)
    assert V.run_program("add(const_m1,const_100)") == (99, None)
    assert [V.run_program(p)[1] for p in ("divide(1,0)", "add(#5,1)", "add(1,2) etc", "add(1)", "", None, "add(x,1)")] == ["program_division_by_zero", "program references missing intermediate #5", "unsupported_program_syntax", "invalid_program_arity:add", "empty_or_unsupported_program", "empty_or_unsupported_program", "unsupported program operand x"]


def test_arithmetic():
    assert V.arithmetic("(v1 - v0) / v0 * 100", {"v0": Decimal(100), "v1": Decimal(120)}) == 20
    assert [V.arithmetic(e) for e in ("1/0", "__import__('os')", "2**9", "1+", "x", "'a'+'b'")] == [None] * 6


@pytest.mark.parametrize("text, kind, answer", [
    ("", "", None), (None, "", None), ("x <answer> 5 </answer> y <ANSWER>6</ANSWER>", "", "6"), ("Final Answer: 12%\nend", "", "12%"), ('{"answer": "A, C"}', "choice", "A, C"), (r"so \boxed{42}", "", "42"),
    ("first\nB", "single_choice", "B"), ("one\ntwo", "", None), ("one", "", "one"), ("rose to 5 then 7万元", "numeric", "7万元"), ("no number", "numeric", None),
])
def test_final_answers(text, kind, answer):
    assert V.final_answer(text, kind) == answer


@pytest.mark.parametrize("completion, gold, kind, question, want", [
    ("", ["1"], "numeric", "", -0.1), ("A,B", ["A,C"], "multiple_choice", "", 1 / 3), ("Answer: 20%", ["20%"], "numeric", "", 1.0), ("Answer: 0.2", ["20%"], "numeric", "", 1.0), ("Answer: 21%", ["20%"], "numeric", "", 0.0),
    ("答案：正确", ["true"], "true_false", "", 1.0), ("pages 3, 5", ["3", "4"], "page_numbers", "", 1 / 3), ("Answer: 3.14", ["3.15"], "numeric", "round to 2 decimal places", 1.0), ("Answer: 3.13", ["3.15"], "numeric", "give it to two decimal places", 1.0),
    ("Answer: 15亿元", ["1500000000元"], "numeric", "", 1.0), ("Answer: x", ["x"], "free", "", 0.0), ("Answer: 5", [], "numeric", "", 0.0),
])
def test_scores(completion, gold, kind, question, want):
    assert V.score(completion, gold, kind, question) == pytest.approx(want)


def test_columns(spark):
    df = spark.createDataFrame([("a", "Answer: 5", ["5"], "numeric", None, "add(2,3)"), ("b", None, None, None, "q", "divide(1,0)")], "id string, c string, g array<string>, k string, q string, p string")
    assert {tuple(r) for r in V.scores(df, "id", "c", "g", "k", "q").collect()} == {("a", 1.0), ("b", -0.1)}
    assert {tuple(r) for r in V.program_results(df, "id", "p").collect()} == {("a", "5", None), ("b", None, "program_division_by_zero")}
    assert V.scores(df.limit(0), "id", "c", "g", "k", "q").count() == 0
