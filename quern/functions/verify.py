"""Checking answers by rule: quantities with units, tolerances, answer atoms, step programs, safe arithmetic.

Plain functions on one value each, exact in decimals; ``scores`` and
``program_results`` run them over columns in Arrow batches, as Spark has
neither per-row precision nor an interpreter.
"""

from __future__ import annotations

import ast
import json
import operator
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scale words, currency names, other units, tolerances.
SCALES = {"千": 3, "万": 4, "十万": 5, "百万": 6, "千万": 7, "亿": 8, "十亿": 9, "百亿": 10, "千亿": 11, "万亿": 12, "thousand": 3, "million": 6, "billion": 9}
CURRENCIES = {"$": "美元", "usd": "美元", "美元": "美元", "¥": "元", "cny": "元", "rmb": "元", "人民币": "元", "元": "元", "港元": "港元", "hkd": "港元"}
CURRENCY_CODES = {"美元": "USD", "元": "CNY", "港元": "HKD"}
SCALED_CURRENCIES = ("元", "美元")
UNITS = {"%": ("%", "percent", "0.01"), "百分点": ("百分点", "percentage_point", "1"), "倍": ("倍", "multiple", "1"), "count": ("count", "count", "1"), "点": ("点", "point", "1")}
UNIT_ALIASES = {"个百分点": "百分点", "percentage point": "百分点", "percentage points": "百分点", "家": "count", "项": "count", "个": "count"}
TOLERANCES = {"count": ("0", "0"), "percent": ("1e-5", "1e-6"), "percentage_point": ("1e-6", "1e-6"), "multiple": ("1e-6", "1e-6"), "point": ("1e-6", "1e-6"), "CNY": ("0.01", "1e-8"), "USD": ("0.01", "1e-8"), "HKD": ("0.01", "1e-8")}
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())} | {w: i for i, w in enumerate("零一二三四五六七八九十")} | {"single": 1, "两": 2}
TRUE_WORDS, FALSE_WORDS = {"true", "yes", "是", "正确", "对", "a"}, {"false", "no", "否", "错误", "错", "不正确", "不是", "不对", "b"}
EDGES = " \t\r\n.,;:!?，。；：！？、\"'“”‘’`()[]{}<>《》"
CHOICES = {"single_choice", "multiple_choice", "choice"}
NUMERIC = {"numeric", "numeric_final", "composite_numeric"}

_WORDS = sorted({s + c for s in SCALES for c in ("", *SCALED_CURRENCIES)} | {"人民币" + s + "元" for s in SCALES if not s.isascii()} | set(CURRENCIES) - {"$", "¥"} | set(UNITS) - {"count"} | set(UNIT_ALIASES) - {"percentage point", "percentage points"}, key=lambda w: (-len(w), w))
QUANTITY = re.compile(r"(?P<sign>[$¥€£])?\s*(?P<number>[-+]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:e[-+]?\d+)?)\s*(?P<unit>percentage\s+points?|" + "|".join(map(re.escape, _WORDS)) + ")?", re.I)
TAG = re.compile(r"<answer>\s*(.*?)\s*</answer>", re.I | re.S)
LABELLED = re.compile(r"(?:最终答案|答案|最终结果|结论|final\s+answer|answer)\s*[:：]\s*([^\r\n]+)", re.I)
JSON_ANSWER = re.compile(r'"answer"\s*:\s*(".*?"|\[[^\]]*\]|[-+]?\d+(?:\.\d+)?|true|false|null)', re.I | re.S)
BOXED = re.compile(r"\\boxed\s*\{([^{}]+)\}")
CALL = re.compile(r"(add|subtract|multiply|divide)\(([^()]*)\)")


def folded(text: str) -> str:
    """Compatibility characters in plain form, list marks as commas, blanks collapsed."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", str(text)).strip().translate(str.maketrans("，、；", ",,;")))


@dataclass(frozen=True)
class Quantity:
    value: Decimal
    unit: str = ""
    dimension: str = "scalar"
    factor: Decimal = Decimal(1)

    @property
    def base(self) -> Decimal:
        return self.value * self.factor


def unit_of(word: str, sign: str = "") -> tuple[str, str, Decimal]:
    """(unit, dimension, factor) of a unit word after a number and a currency sign before it."""
    word, sign = re.sub(r"\s+", " ", word.lower()).strip(), sign.lower()
    word = UNIT_ALIASES.get(word, word)
    if word in UNITS:
        unit, dimension, factor = UNITS[word]
        return unit, dimension, Decimal(factor)
    money = CURRENCIES.get(sign)
    plain = word.removeprefix("人民币") if word != "人民币" else word
    for c in ("", *SCALED_CURRENCIES):
        scale = plain.removesuffix(c) if c else plain
        if plain.endswith(c) and scale in SCALES and (c or plain in SCALES):
            c = c or money or ""
            return scale + c, CURRENCY_CODES.get(c, "scalar"), Decimal(10) ** SCALES[scale]
    c = CURRENCIES.get(word) or money
    return (c, CURRENCY_CODES[c], Decimal(1)) if c else ("", "scalar", Decimal(1))


def quantity(text: str) -> Quantity | None:
    """The first number of a text with its unit."""
    m = QUANTITY.search(folded(text))
    return Quantity(Decimal(m["number"].replace(",", "")), *unit_of(m["unit"] or "", m["sign"] or "")) if m else None


def quantity_of(value: str, unit: str) -> Quantity | None:
    """A number and its unit given apart; None if either cannot be read."""
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        return None
    if not unit:
        return Quantity(number)
    known = unit_of(unit)
    return Quantity(number, *known) if known[0] == unit else None


def quantity_texts(text: str) -> list[str]:
    """The distinct numbers with their units, in order; list marks separate, thousand separators do not."""
    plain = unicodedata.normalize("NFKC", str(text).replace("，", "\n").replace("、", "\n"))
    return list(dict.fromkeys(m.group(0).strip() for m in QUANTITY.finditer(plain)))


def final_answer(text: str | None, kind: str = "") -> str | None:
    """What a completion gives as its answer: tag, label, JSON field, box, or the last line where the kind allows it."""
    text = (text or "").strip()
    for pattern in (TAG, LABELLED):
        found = pattern.findall(text)
        if found and found[-1].strip():
            return found[-1].strip()
    found = JSON_ANSWER.findall(text)
    if found:
        raw = found[-1].strip()
        if raw[0] == '"':
            try:
                raw = str(json.loads(raw)).strip()
            except json.JSONDecodeError:
                raw = raw[1:-1].strip()
        return raw or None
    found = BOXED.findall(text)
    if found and found[-1].strip():
        return found[-1].strip()
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines:
        return None
    if kind == "composite_numeric":
        return lines[-1] if quantity_texts(lines[-1]) else None
    if kind in NUMERIC:
        found = quantity_texts(lines[-1]) or quantity_texts(text)
        return found[-1] if found else None
    return lines[-1] if kind in CHOICES | {"page_numbers", "true_false"} or len(lines) == 1 else None


def atoms(answer: str, kind: str) -> list[str]:
    """The comparable parts of an answer: pages, truth value, option letters, or pieces between list marks."""
    text = folded(answer)
    if kind == "page_numbers":
        found = re.findall(r"\d+", text)
    elif kind == "true_false":
        word = text.casefold().strip(EDGES)
        found = ["true"] * (word in TRUE_WORDS) + ["false"] * (word in FALSE_WORDS)
    elif kind in CHOICES:
        packed = re.sub(r"[\s,;/|]+", "", text.upper())
        found = packed if re.fullmatch("[A-H]+", packed) else re.findall(r"(?<![A-Za-z])[A-H](?![A-Za-z])|(?<!\d)\d+(?!\d)", text.upper())
    else:
        found = [p.strip() for p in re.split(r"[,;\n|/]+", text) if p.strip()]
    return list(dict.fromkeys(found))


def asked_places(question: str | None) -> int | None:
    """The decimal places that a question asks for, None if it asks for none."""
    text = unicodedata.normalize("NFKC", question or "").casefold()
    if re.search(r"\b(?:nearest|closest)\s+(?:whole\s+number|integer)\b|(?:保留|精确到|精确至|四舍五入(?:到|至)?)\s*(?:为|至)?\s*整数|取整", text):
        return 0
    m = re.search(r"(?:保留|精确到|精确至|四舍五入(?:到|至)?)\s*([0-9一二两三四五六七八九十]+)\s*位小数", text) or re.search(r"\b(?:to|at)\s+(?:the\s+)?(\w+)\s+decimal\s+places?\b", text)
    if not m:
        return None
    return int(m[1]) if m[1].isdigit() else NUMBER_WORDS.get(m[1])


def _near(a: Decimal, b: Decimal, places: int) -> bool:
    """Both rounded half up, at most two units of the last place apart."""
    unit = Decimal(1).scaleb(-places)
    return abs(a.quantize(unit, ROUND_HALF_UP) - b.quantize(unit, ROUND_HALF_UP)) <= 2 * unit


def agrees(given: Quantity, gold: Quantity, question: str = "", abs_tol: Decimal | None = None, rel_tol: Decimal | None = None) -> bool:
    """Whether a quantity equals the gold one within the places asked for, else within its dimension's tolerance.

    A number without a unit may be in the gold's unit or in its base unit.
    """
    bare = given.dimension == "scalar" and not given.unit
    places = asked_places(question) if abs_tol is None and rel_tol is None else None
    if places is not None:
        if gold.dimension == "scalar" and not gold.unit:
            return _near(given.value, gold.value, places)
        if bare:
            return _near(given.value, gold.value, places) or _near(given.value / gold.factor, gold.value, places)
        return given.dimension == gold.dimension and _near(given.base / gold.factor, gold.value, places)
    default = TOLERANCES.get(gold.dimension, ("1e-4", "1e-5" if abs(gold.base) < 1 else "1e-8"))
    at, rt = (Decimal(d) if t is None else t for d, t in zip(default, (abs_tol, rel_tol)))
    if bare:
        tried = [(gold.base, at), (gold.value, at if gold.value == gold.base else at / gold.factor)]
        return any(abs(given.value - x) <= max(t, abs(x) * rt) for x, t in tried)
    return given.dimension == gold.dimension and abs(given.base - gold.base) <= max(at, abs(gold.base) * rt)


def score(completion: str | None, gold: list[str], kind: str, question: str = "", gold_quantities: list[list[Quantity]] | None = None) -> float:
    """Shared over all parts of answer and gold, 0 to 1; -0.1 if there is no answer.

    gold_quantities gives alternatives for each gold number in place of ``gold``.
    """
    answer = final_answer(completion, kind)
    if answer is None:
        return -0.1
    if kind in NUMERIC:
        given = [quantity(t) for t in quantity_texts(answer)]
        wanted = gold_quantities if gold_quantities is not None else [[quantity(str(g))] for g in gold]
        if not given or not wanted or any(q is None for alternatives in wanted for q in alternatives):
            return 0.0
        left = list(range(len(wanted)))
        for q in given:
            hit = next((i for i in left if any(agrees(q, g, question) for g in wanted[i])), None)
            if hit is not None:
                left.remove(hit)
        same = len(wanted) - len(left)
        return same / (len(given) + len(wanted) - same)
    if kind not in CHOICES | {"page_numbers", "true_false"}:
        return 0.0
    a, b = set(atoms(answer, kind)), set(atoms(";".join(map(str, gold)), kind))
    return len(a & b) / len(a | b) if a and b else 0.0


def run_program(program: str | None) -> tuple[Decimal | None, str | None]:
    """(result, None) of steps like ``subtract(5,3),divide(#0,2)``, or (None, reason).

    ``#k`` (or ``Ak``) is the result of step k, ``const_x`` the number x and
    ``const_m1`` minus one.
    """
    calls = CALL.findall(program or "")
    if not calls:
        return None, "empty_or_unsupported_program"
    if CALL.sub("", program).replace(",", "").strip():
        return None, "unsupported_program_syntax"
    done: list[Decimal] = []
    apply = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": operator.truediv}
    for name, inside in calls:
        words = [w.strip() for w in inside.split(",")]
        if len(words) != 2:
            return None, f"invalid_program_arity:{name}"
        args = []
        for w in words:
            if w[:1] in ("#", "A") and w[1:].isdigit():
                if int(w[1:]) >= len(done):
                    return None, f"program references missing intermediate #{int(w[1:])}"
                args.append(done[int(w[1:])])
                continue
            try:
                args.append(Decimal(-1) if w == "const_m1" else Decimal(w.removeprefix("const_")))
            except InvalidOperation:
                return None, f"unsupported program operand {w}"
        if name == "divide" and args[1] == 0:
            return None, "program_division_by_zero"
        done.append(apply[name](*args))
    return done[-1], None


def arithmetic(expression: str, values: dict[str, Decimal] | None = None) -> Decimal | None:
    """The value of an expression of numbers, named values, + - * / and brackets; None for anything else."""
    apply = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}

    def value(n: ast.AST) -> Decimal:
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return Decimal(str(n.value))
        if isinstance(n, ast.Name):
            return (values or {})[n.id]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
        if isinstance(n, ast.BinOp):
            return apply[type(n.op)](value(n.left), value(n.right))
        raise KeyError(type(n))

    try:
        return value(ast.parse(expression.strip(), mode="eval"))
    except (KeyError, SyntaxError, ArithmeticError, ValueError, RecursionError):
        return None


def scores(df: DataFrame, key: str, completion: str, gold: str, kind: str, question: str) -> DataFrame:
    """(key, score) of each row; gold is an array of strings. Null golds are empty, null kinds score 0 or -0.1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = [score(c, list(g) if g is not None else [], k or "", q or "") for c, g, k, q in zip(x.completion, x.gold, x.kind, x.question)]
            yield pd.DataFrame({"key": x.key, "score": s})

    x = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).alias(n) for n, c in (("completion", completion), ("gold", gold), ("kind", kind), ("question", question))])
    return x.mapInPandas(run, "key string, score double").withColumnRenamed("key", key)


def program_results(df: DataFrame, key: str, program: str) -> DataFrame:
    """(key, result as decimal text, error) of each row's step program."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            done = [run_program(p) for p in x.program]
            yield pd.DataFrame({"key": x.key, "result": [None if v is None else format(v.normalize(), "f") for v, _ in done], "error": [e for _, e in done]})

    return df.select(F.col(key).cast("string").alias("key"), F.col(program).alias("program")).mapInPandas(run, "key string, result string, error string").withColumnRenamed("key", key)
