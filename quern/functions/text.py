"""Scalar functions on text columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def unspaced(c: Column) -> Column:
    """A question key: no white space at all."""
    return F.regexp_replace(c, r"\s+", "")


def role_text(messages: Column, role: str) -> Column:
    """Contents of one role's messages, joined by a line end; empty if it has none."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def last_of(messages: Column, role: str) -> Column:
    """The content of a role's last message, null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def record_key(messages: Column, images: Column) -> Column:
    """SHA-256 of the squeezed messages and slash-normalised images, null equal to empty."""
    said = F.array_join(F.transform(messages, lambda m: F.concat_ws("\x1f", m["role"], F.coalesce(squeezed(m["content"]), F.lit("")))), "\x1e")
    seen = F.array_join(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda p: F.replace(p, F.lit("\\"), F.lit("/"))), "\x1e")
    return F.sha2(F.concat_ws("\x1d", said, seen), 256)


def answer_tail(c: Column) -> Column:
    """The last answer line's value, else the last line."""
    line = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?im)^(?:answer|antwort|答案)\s*[:：]\s*(.+)$"), F.lit(1)), F.lit(-1))
    return F.coalesce(line, F.element_at(F.split(c, "\n"), -1))


def numbers(c: Column) -> Column:
    """Distinct numeric tokens without thousand separators, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def choice(c: Column) -> Column:
    """The option letter that an answer gives, null if none."""
    return F.nullif(F.regexp_extract(c, r"^(?:The answer is |Answer: |Antwort: |答案：|选)?([A-D])(?:$|[.)])", 1), F.lit(""))


def rank_key(seed: int, salt: str, *identity: Column) -> Column:
    """SHA-256 of seed, salt and the first non-empty identity, joined by NUL: a reproducible random order."""
    first = F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in identity], F.lit(""))
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.lit(salt), first), 256)
