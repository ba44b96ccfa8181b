"""Problem 5: broken prompt and response pairs.

Ordered rules over the last user message and the assistant message after it,
as built-in expressions over one scan: no shuffle and no Python. Every
triggered rule is emitted; ``first_defect`` takes the first in the order
empty, copies_question, refusal, other_language, truncated.

A missing record id leaves the record out; null messages, a null or missing
answer and one of blanks or placeholders are empty; a record without a user
message can only be empty; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.leakage import decoded
from quern.llm.records import label, plain, role

DEFECTS = ["empty", "copies_question", "refusal", "other_language", "truncated"]

# Patterns of the rules.
PLACEHOLDER = r"(?is)^[\s　]*(?:n\.?/?a\.?|null|none|nil|nan|tbd|todo|k\. ?a\.|无|暂无|待补充|空|keine angabe|<none>|no answer|(?:<(\w+)>\s*</\1>)|\[\s*\]|\{\s*\}|[-–—_.…。·*#?？/\\|]*|(?:final |the )?(?:answer|antwort|答案|最终答案|回答|response|assistant)\s*(?:is|ist|为|是)?\s*[:：]?)[\s　]*$"
NO_EN = r"(?:can['’]?t|cannot|can not|won['’]?t|will not|unable|not able|not permitted|not allowed|may not|must decline|have to decline|decline to|refuse to|not in a position|couldn['’]?t|could not|not comfortable)"
REFUSAL_EN = r"(?i)^(?:(?:i['’]?m|i am|we['’]?re|we are)?\s*(?:(?:very|so|truly|deeply|really|terribly)\s+)?(?:sorry|afraid)\b[^.!?]{0,120}?" + NO_EN + r"|(?:unfortunately|regrettably|sadly|apologies|my apologies|i apologi[sz]e|with regret)\b[^.!?]{0,60}?\b(?:i|we)\b[^.!?]{0,40}?" + NO_EN + r"|as an? (?:ai|assistant|language model|artificial)[^.!?]{0,60}?" + NO_EN + r"|(?:i|we)(?:['’]m| am| are|['’]re)?\s+(?:\w+\s+){0,2}?" + NO_EN + r")"
REFUSAL_ZH = r"^(?:(?:很|非常|十分|真的|实在)?(?:抱歉|遗憾|对不起|不好意思)[^。！？\n]{0,30}?(?:无法|不能|不便|没有能力|不可以|不会|不得|难以)|作为(?:一个|一名|一款)?(?:AI|人工智能|助手|语言模型|大模型|智能助手)[^。！？\n]{0,20}?(?:无法|不能|不便|不会|没有能力|不可以)|(?:请?恕)?(?:我|我们|本人|本助手)(?:目前|暂时|实在)?(?:无法|不能|不便|没有能力|没有办法|拒绝|不可以)|恕(?:不|无法|难))"
REFUSAL_DE = r"(?i)^(?:(?:leider|bedauerlicherweise|es tut mir leid|tut mir leid|entschuldigung|verzeihung|ich bedau\w+|als (?:ki|assistent|sprachmodell))[^.!?]{0,80}?\b(?:ich|wir|mir)\b[^.!?]{0,100}?\b(?:nicht|kein\w*|ablehnen|außerstande|unmöglich)\b|(?:ich|wir)\s+(?:kann|darf|möchte|muss|bin|können|dürfen|müssen|sind|werde)\b[^.!?]{0,100}?\b(?:nicht|kein\w*|ablehnen|außerstande)\b)"
ASKS_LANGUAGE = r"(?i)\btranslate\b|übersetz|译|\bin(?:to)? (?:chinese|english|german)\b|\b(?:auf|ins) (?:deutsch|englisch|chinesisch)e?n?\b|(?:用|以|使用)(?:中文|英文|德文|英语|德语|汉语)|(?:中文|英文|德文|英语|德语|汉语)(?:作答|回答|答复|撰写)"
ANSWER_LINE = r"(?i)^\W*(?:(?:so |thus |therefore |hence )?(?:the )?(?:final |endgültige |letzte )?(?:answer|antwort|ergebnis|result)(?:\s+is|\s+ist|\s+lautet)?|最终答案|答案|结论|结果|因此选|故选|选)\s*(?:为|是)?\s*[:：]?\s*\S"
LABEL = r"(?i)^(?:[A-H](?:[.):、]\s?[^\n]{0,60})?|选[A-H]|\S{1,16}|[^\s一-鿿]+(?:[  ][^\s一-鿿]+){0,2}|[-−–+(]?\s*(?:rmb|cny|usd|hk\$|hkd|us\$|eur|jpy|gbp|chf|\$|€|£|¥)?\s*[-−–]?[\d.,]+[^\n.。]{0,24}|[-−–]?[\d.,]+\s*\S{0,6})$"
TERMINAL = r"[.。!！?？…”’\"'»』」）)\]】}》>]\s*$"
BROKEN_END = r"(?:\.\.\.|…|……)\s*$|(?<![\p{L}])(?:Tsd|Mio|Mrd|approx|vs|No|Nr|bzw|ca)\.\s*$|(?:[$€£¥]|RMB|CNY|EUR|USD|HKD)\s?\d[\d,]*\.\s*$"
EN = r"\b(?:the|of|and|to|in|is|was|for|on|by|with|from|that|as|at|were|which|its|this|are)\b"
DE = r"\b(?:der|die|das|und|von|mit|auf|im|den|dem|des|ist|war|ein|eine|einer|bei|nach|nicht|zum|zur|wurde|unter|aus|sich|denn|danach|nennt)\b|[äöüß]"
OPENED = r"(?:[（(]+[^（()）]*|[【「『“]+[^】」』”“]*)$"
QUESTION_LABEL = r"(?i)^[\s　]*(?:question|frage|问题|问|q|prompt|user|用户)\s*[:：]\s*"


def question_and_answer(messages: Column) -> tuple[Column, Column]:
    """The last user message and the first assistant message after it (after the start if there is no user)."""
    last = F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(role(m) == "user", i))), F.lit(-1))
    after = F.filter(messages, lambda m, i: (role(m) == "assistant") & (i > last))
    question = F.when(last >= 0, F.try_element_at(messages, (last + 1).cast("int"))["content"])
    return question, F.try_element_at(after, F.lit(1))["content"]


def with_language(x: DataFrame, name: str, text: Column, wanted: Column) -> DataFrame:
    """Adds column ``name``: zh, de or en of a text with sentences, null where it is too short or too mixed to tell or not wanted.

    The counts are columns of their own, so that each pattern runs once.
    """
    t = F.when(wanted, text)
    x = x.withColumns({"_w": F.length(t) - F.length(F.regexp_replace(t, r"[一-鿿]+", "")), "_l": F.length(F.regexp_replace(t, r"[^A-Za-zÄÖÜäöüß]+", ""))})
    zh, latin = (F.col("_w") >= 8) & (F.col("_w") * 3 > F.col("_l")), F.col("_l") >= 30
    x = x.withColumns({"_zh": zh, "_t": F.when(~zh & latin, F.lower(t))})
    x = x.withColumns({"_en": F.regexp_count("_t", F.lit(EN)), "_de": F.regexp_count("_t", F.lit(DE))})
    x = x.withColumn(name, F.when(F.col("_zh"), "zh").when(F.col("_de") > F.col("_en") + 1, "de").when(F.col("_en") > F.col("_de") + 1, "en"))
    return x.drop("_w", "_l", "_zh", "_t", "_en", "_de")


def last_line(t: Column) -> Column:
    return F.trim(F.substring_index(t, "\n", -1))


def pair_defects(records: DataFrame) -> DataFrame:
    """(record_id, defects array<string>) of every record with at least one triggered rule."""
    q, a = question_and_answer(F.col("messages"))
    x = records.where("record_id is not null").select("record_id", label(F.col("task")).alias("task"), F.coalesce(decoded(q), F.lit("")).alias("q"), F.coalesce(decoded(a), F.lit("")).alias("a"))
    x = x.withColumn("a", F.regexp_replace("a", r"^[\s　]+|[\s　]+$", "")).withColumn("q", F.regexp_replace("q", r"^[\s　]+|[\s　]+$", ""))
    x = x.withColumns({"pa": plain(F.regexp_replace("a", QUESTION_LABEL, "")), "pq": plain(F.col("q")), "line": last_line(F.col("q")), "aline": last_line(F.col("a")), "empty": F.col("a").rlike(PLACEHOLDER)})
    # the question: the sentence that asks something in the last lines, or the last line
    tail = F.substring_index("q", "\n", -6)
    asks = F.filter(F.split(tail, r"(?<=[.。!！?？])|\n"), lambda t: t.rlike(r"[?？]"))
    x = x.withColumns({"pline": plain(F.col("line")), "asks": plain(F.coalesce(F.try_element_at(asks, F.lit(-1)), F.lit("")))})
    task, a, q = F.coalesce(F.col("task"), F.lit("")), F.col("a"), F.col("q")
    empty = F.col("empty")

    long = F.length("pa") >= 10
    x = x.withColumn("holds", long & F.expr("contains(pq, pa)"))
    question = F.when(F.col("asks") != "", F.least(F.length("asks"), F.length("pline"))).otherwise(F.length("pline")) * 0.9
    ends = F.col("holds") & F.expr("endswith(pq, pa)") & (F.length("pa") >= F.length("pline") * 0.9)
    whole = F.col("holds") & (F.length("pa") >= 0.6 * F.length("pq")) & (task != "evidence_retrieval")
    is_question = F.col("holds") & (F.length("pa") >= question) & (a.rlike(r"[?？]\s*$") | F.expr("asks <> '' and contains(asks, pa)"))
    copies = ~empty & (ends | whole | is_question)

    x = x.withColumn("refuses", ~empty & (a.rlike(REFUSAL_EN) | a.rlike(REFUSAL_ZH) | a.rlike(REFUSAL_DE)))
    marks = F.when(F.col("refuses"), F.regexp_replace(a, r"(?<=[\p{L})）”])[.!?](?=\s|$)|[。！？]|\n", "\u0001"))
    sentences = F.size(F.filter(F.split(marks, "\u0001"), lambda s: F.trim(s) != ""))
    refusal = F.col("refuses") & (sentences <= REMARKS + 1) & (task != "compliance_safety_suitability")

    x = x.withColumn("structure", a.rlike(r"^(?:```\w*\s*)?[{\[]"))
    table_line = F.col("aline").startswith("|")
    asked_for = (task == "financial_translation") | q.rlike(ASKS_LANGUAGE) | ((task == "evidence_retrieval") & F.col("holds"))
    x = x.withColumn("judged", ~empty & ~F.col("structure") & ~F.col("refuses") & (F.length("pa") >= 8) & ~asked_for)
    x = with_language(x, "la", F.regexp_replace(a, r"(?m)^\|.*$", ""), F.col("judged"))
    x = with_language(x, "ll", F.col("line"), F.col("la").isNotNull())
    x = with_language(x, "lq", q, F.col("la").isNotNull() & F.col("ll").isNull())
    other = F.coalesce(F.col("la") != F.coalesce("ll", "lq"), F.lit(False))

    x = x.withColumn("bare", F.when(F.col("structure"), F.regexp_replace(a, r'"(?:[^"\\]|\\.)*"', "")))
    opened = F.length(F.regexp_replace("bare", r"[^{\[]+", "")) - F.length(F.regexp_replace("bare", r"[^}\]]+", ""))
    fences = F.regexp_count(a, F.lit("```")) % 2 == 1
    tags = a.rlike(r"(?i)<(?:answer|think|result)>") & ~a.rlike(r"(?i)</(?:answer|think|result)>")
    pipes = F.length(F.regexp_replace("aline", r"[^|]+", ""))
    header = F.regexp_extract(a, r"(?m)^(\|.*)$", 1)
    cut_table = ~F.col("aline").endswith("|") | (pipes < F.length(F.regexp_replace(header, r"[^|]+", ""))) | F.col("aline").rlike(r"^[|\-: ]+$")
    is_label = a.rlike(LABEL)
    end = F.right(a, F.lit(24))
    said = ~end.rlike(TERMINAL) & ~F.col("aline").rlike(ANSWER_LINE) & ~is_label
    truncated = ~empty & F.when(F.col("structure"), (opened > 0) | F.expr("contains(bare, '\"')")).when(table_line, cut_table).otherwise(fences | tags | said | (F.right(a, F.lit(OPEN_AT_MOST)).rlike(OPENED) & ~is_label) | (end.rlike(BROKEN_END) & ~is_label))

    asked = F.length("pq") > 0
    rules = [empty, copies & asked, refusal & asked, other & asked, truncated & asked]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, DEFECTS)]))
    # the one-element array keeps the filter above the rules, which would otherwise be copied into it, each many times
    return x.select("record_id", F.explode_outer(F.array(found)).alias("defects")).where(F.size("defects") > 0)


#: Characters before the end of an answer in which a bracket or quotation mark that opens there has to be closed.
OPEN_AT_MOST = 160
#: Sentences that may follow a refusal: a courtesy and a remark.
REMARKS = 3


def first_defect(defects: DataFrame) -> DataFrame:
    return defects.select("record_id", F.element_at("defects", 1).alias("defect"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record whose last question and answer are a broken pair, with its defect."""
    return first_defect(pair_defects(spark.read.parquet(f"{d}/sft_records.parquet")))


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    """Records by triggered rule and task."""
    sft = spark.read.parquet(f"{d}/sft_records.parquet")
    x = pair_defects(sft).select("record_id", F.explode("defects").alias("defect"))
    return x.join(sft.select("record_id", label(F.col("task")).alias("task")), "record_id").groupBy("task", "defect").agg(F.count("*").alias("records"))
