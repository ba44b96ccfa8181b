"""Model calls as an injected function: retries, errors as a column, JSON answers, rule before model.

A client takes a list of prompts and gives a list of texts; it is built once
per task by a factory, so it needs no pickling. Nothing here opens a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str]]
#: Prompts of one call; characters of a prompt, longer ones are refused with an error.
AT_ONCE, LONGEST = 32, 1_000_000
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def json_answer(text: str | None) -> str | None:
    """The first JSON object of a reply, fenced or bare, in one line; None if there is none."""
    if not text:
        return None
    for part in [*FENCE.findall(text), text]:
        at = part.find("{")
        while at >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(part, at)[0], ensure_ascii=False)
            except ValueError:
                at = part.find("{", at + 1)
    return None


def replies(df: DataFrame, key: str, prompt: Column, factory: Callable[[], Client], attempts: int = 3) -> DataFrame:
    """(key, reply, error) of each row: a batch that fails is tried again prompt by prompt, then given up with its error.

    A null prompt gets no reply; one longer than LONGEST an error.
    """

    def ask(client: Client, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        error = ""
        for _ in range(attempts):
            try:
                got = client(prompts)
                if len(got) != len(prompts):
                    raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
                return [(r, None) for r in got]
            except Exception as e:  # noqa: BLE001 - an injected client may raise anything
                error = f"{type(e).__name__}: {e}"
        return [(None, error)] if len(prompts) == 1 else [ask(client, [p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for x in batches:
            out: list[tuple[str | None, str | None]] = [(None, None if p is None else "too long") for p in x.prompt]
            open_ = [i for i, p in enumerate(x.prompt) if p is not None and len(p) <= LONGEST]
            for at in range(0, len(open_), AT_ONCE):
                part = open_[at : at + AT_ONCE]
                for i, r in zip(part, ask(client, [x.prompt.iloc[i] for i in part])):
                    out[i] = r
            yield pd.DataFrame({"key": x.key, "reply": [r for r, _ in out], "error": [e for _, e in out]})

    x = df.select(F.col(key).cast("string").alias("key"), prompt.cast("string").alias("prompt"))
    return x.mapInPandas(run, "key string, reply string, error string").withColumnRenamed("key", key)


def judged(df: DataFrame, key: str, prompt: Column, factory: Callable[[], Client], schema: str, attempts: int = 3) -> DataFrame:
    """(key, verdict struct, error): replies parsed as JSON of the schema; no or other JSON is an error."""
    find = F.udf(json_answer, "string")
    x = replies(df, key, prompt, factory, attempts).withColumn("verdict", F.from_json(find("reply"), schema))
    return x.select(key, "verdict", F.coalesce("error", F.when(F.col("verdict").isNull(), "no JSON in the reply")).alias("error"))


def rule_then_model(df: DataFrame, key: str, rule: Column, prompt: Column, factory: Callable[[], Client], read: Callable[[Column], Column]) -> DataFrame:
    """(key, value, by): the rule's value, or the model's where the rule gives null; only those rows reach the model."""
    x = df.withColumn("_rule", rule)
    sure = x.where("_rule is not null").select(F.col(key).cast("string").alias(key), F.col("_rule").alias("value"), F.lit("rule").alias("by"))
    asked = replies(x.where("_rule is null"), key, prompt, factory)
    return sure.unionByName(asked.select(key, read(F.col("reply")).alias("value"), F.when(F.col("error").isNull(), "model").otherwise("error").alias("by")))
