"""Problem 9: keyword-stuffed and link-list pages.

One pass over the texts takes, of each page after a lead of at most two
sentences and without table lines: the share of function words, the share of
text in sentences (a stretch between line ends or sentence marks with enough
function words, not made of stuffed word pairs), the shares of the five most
frequent words and of stuffed pairs, of repeated lines, of lines with links and
of tag lines, and separators per word.
Thresholds on function words and repetition are calibrated per language on the
medians of all pages, within fixed bounds so that a corpus of mostly spam
can't move them far. In a language whose pages hold hardly any of the function
words below, a sentence is a stretch of enough words with a mark at its end. A
page is spam if it lacks sentences and shows at least one of repetition, links,
tags or separators, or if it has links and hardly a word beside them.

Null ids are left out; a null, empty or wordless text is no spam; a null
language is a language of its own; copies get the same answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.durable import materialize

# Function words, Latin script together; CJK by character or short word.
FUNCTION = frozenset(
    "the a an of and to in is was were are be been has had have for on by with from that as at which its it this these those or but not will would may can than then there their they he she we you i if while although because after before into over under about between during through against "
    "der die das den dem des ein eine einer eines einem einen und oder aber nicht mit von vom zu zum zur im in an am auf für bei nach aus über unter um durch ohne gegen ist sind war waren wird werden wurde hat haben hatte sich es er sie wir als wie da denn dass daß wenn obwohl während bis nur noch auch so rund laut nennt "
    "le la les un une des du de et ou à au aux en dans sur pour par avec sans que qui est sont était il elle nous vous el los las una y o del al con sin por para que es son fue se su sus como más".split()
)
WIDE_FUNCTION = re.compile("[的了是在和与及将使因由对从等为被把并但而或其所至令该这那有就也都已未不于以系较]|根据|尽管|如果|截至|同比|预计|达到")
WIDE = re.compile("[㐀-鿿぀-ヿ가-힯]")
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:test|example|invalid|com|net|org|info|biz|top|xyz)(?:/\S*)?")
DOMAIN = re.compile(r"\.(?:test|example|invalid|com|net|org|info|biz|top|xyz)\b")
WORD = re.compile(r"[^\W\d_]+")
NUMBER = re.compile(r"\d[\d.,]*")
STRETCH = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
TAG_LABEL = re.compile(r"(?:tags?|keywords?|schlagw\w+|stichw\w+|标签|关键词|关键字)\s*[:：]", re.I)
ITEM = re.compile(r"\b(?:sku|art|item|ref|nr|no)[-. #]?\d{2,}", re.I)
SEPARATOR = re.compile(r"[|/>»·•,;、，；#+*~]|\s[-–—]\s")
LEAD, WORDS = 2, 6
#: Of a sentence: least words (twice as many without a mark at its end), function words' share and, in CJK, characters.
SENTENCE_WORDS, SENTENCE_SHARE, SENTENCE_WIDE = 5, 0.12, 8
#: A word pair is stuffed if it makes up this share of a page's pairs, repeated stretches counted once, and stands there so often.
STUFFED_SHARE, STUFFED_TIMES = 0.03, 4
#: Bounds of the calibrated thresholds: function words' share, top words' share.
FUNCTION_BOUNDS, TOP_BOUNDS = (0.05, 0.12), (0.35, 0.6)
#: A language is known if its median page has this share of function words; links of a page that has no words beside them.
KNOWN, LINKS = 0.03, 3
FIELDS = "doc_id long, lang string, words long, functions double, sentences double, top_words double, stuffed double, repeated_lines double, link_lines double, tag_lines double, separators double, marked double, links long"
NOTHING = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)


def pairs_of(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring words; a CJK stretch counts as overlapping pairs of characters."""
    out = []
    for w in words:
        if w[0] >= "㐀" and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return list(zip(out, out[1:]))


def page_features(text: str) -> tuple:
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    bars = [x for x in lines if x[0] == "|" and x[-1] == "|" and len(x) > 1]
    has_table = any(not WORD.search(x) or NUMBER.search(x) for x in bars)
    kept, linked, tagged, links = [], 0, 0, 0
    for x in lines:
        if has_table and x[0] == "|" and x[-1] == "|":
            continue
        link = ("http" in x or "www." in x or "." in x and DOMAIN.search(x) is not None) and LINK.search(x) is not None
        tag = x[0] == "#" and all(w[0] == "#" for w in x.split()) or TAG_LABEL.match(x) is not None or ("-" in x or "#" in x) and len(x) < 200 and ITEM.search(x) is not None
        if not link and not tag and len(x) < 400:
            numbers = NUMBER.findall(x)
            if len(numbers) >= 2 and len(numbers) >= len(WORD.findall(x)):
                continue
        linked += link
        links += len(LINK.findall(x)) if link else 0
        tagged += tag
        kept.append(LINK.sub(" ", x) if link else x)
    if not kept:
        return NOTHING
    repeated = 1 - len({x.lower() for x in kept}) / len(kept)
    stretches = [x for x in STRETCH.split("\n".join(kept).lower()) if x.strip()]
    has_wide = WIDE.search(text) is not None
    rows = []
    for x in stretches:
        w = WORD.findall(x)
        ended = x.rstrip()[-1] in ".!?。！？"
        wide = len(WIDE.findall(x)) if has_wide else 0
        if wide > 2:
            n, f = (wide + 1) // 2, len(WIDE_FUNCTION.findall(x))
            is_sentence = wide >= SENTENCE_WIDE and (ended and f >= 1 or f >= 3)
            marked = ended and wide >= SENTENCE_WIDE
        else:
            n, f = len(w), sum(map(FUNCTION.__contains__, w))
            is_sentence = n >= SENTENCE_WORDS * (1 if ended else 2) and f >= max(1, SENTENCE_SHARE * n)
            marked = ended and n >= SENTENCE_WORDS
        rows.append([x, n, f, is_sentence, w, marked])
    # a stuffed pair needs frequent words, which most pages lack
    unique = {r[0]: r[4] for r in rows}
    counts = Counter()
    for w in unique.values():
        counts.update(w) if not has_wide else counts.update("".join(w))
    enough = max(STUFFED_TIMES, STUFFED_SHARE * sum(counts.values()) / (2 if has_wide else 1))
    known = dict.fromkeys(unique, 0.0)
    if any(c >= enough and w not in FUNCTION for w, c in counts.items()):
        pairs = {x: pairs_of(w) for x, w in unique.items()}
        times = Counter()
        for p in pairs.values():
            times.update(p)
        enough = max(STUFFED_TIMES, STUFFED_SHARE * sum(times.values()))
        hot = {p for p, c in times.items() if c >= enough}
        if hot:
            known = {x: sum(map(hot.__contains__, p)) / len(p) if p else 0.0 for x, p in pairs.items()}
    for r in rows:
        r[3], r[5] = r[3] and known[r[0]] < 0.25, r[5] and known[r[0]] < 0.25
    lead = 0
    while lead < min(LEAD, len(rows) - 1) and rows[lead][3]:
        lead += 1
    rest = rows[lead:]
    n, f = sum(r[1] for r in rest), sum(r[2] for r in rest)
    told, marked = sum(r[1] for r in rest if r[3]), sum(r[1] for r in rest if r[5])
    body = "\n".join(r[0] for r in rest)
    words = [w for r in rest for w in r[4]]
    top = sum(c for _, c in Counter(words).most_common(5)) / len(words) if words else 0.0
    stuffed = sum(r[1] * known[r[0]] for r in rest) / n if n else 0.0
    return (n, f / n if n else 0.0, told / n if n else 0.0, top, stuffed, repeated, linked / len(kept), tagged / len(kept), len(SEPARATOR.findall(body)) / max(n, 1) if f < 0.2 * n else 0.0, marked / n if n else 0.0, links)


def features(documents: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FIELDS.split(", ")]
        for x in batches:
            rows = [(d, g, *page_features(t)) for d, g, t in zip(x.doc_id, x.lang, x.text)]
            yield pd.DataFrame(rows, columns=names)

    return documents.where("doc_id is not null and text is not null").select("doc_id", "lang", "text").mapInPandas(measure, FIELDS)


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, reasons array<string>) of every spam page; reasons: stuffed, repeated, links, tags, separators."""
    x = materialize(features(documents))
    middle = x.where(F.col("words") >= 20).groupBy("lang").agg(F.percentile_approx("functions", 0.5, 1000).alias("mf"), F.percentile_approx("top_words", 0.5, 1000).alias("mt"))
    lo, hi = (F.lit(v) for v in FUNCTION_BOUNDS)
    tlo, thi = (F.lit(v) for v in TOP_BOUNDS)
    limits = middle.select(F.col("lang").alias("_lang"), F.greatest(lo, F.least(hi, F.col("mf") * 0.3)).alias("least_functions"), F.greatest(tlo, F.least(thi, F.col("mt") * 2)).alias("most_top"), (F.col("mf") >= KNOWN).alias("known"))
    x = x.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").fillna({"least_functions": FUNCTION_BOUNDS[0], "most_top": TOP_BOUNDS[1], "known": True})
    enough, told = F.col("words") >= WORDS, F.when(F.col("known"), F.col("sentences")).otherwise(F.col("marked"))
    lacking = enough & ((told < 0.2) | (told < 0.65) & (F.col("stuffed") >= 0.25)) | (F.col("words") < WORDS) & (F.col("links") >= LINKS)
    no_functions = ~F.col("known") | (F.col("functions") < F.col("least_functions"))
    why = {
        "stuffed": (F.col("stuffed") >= 0.15) & (F.col("words") >= 2 * WORDS),
        "repeated": no_functions & (F.col("words") >= 2 * WORDS) & ((F.col("top_words") >= F.col("most_top")) | (F.col("repeated_lines") >= 0.4)),
        "links": F.col("link_lines") >= 0.3,
        "tags": F.col("tag_lines") >= 0.3,
        "separators": no_functions & (F.col("separators") >= 0.3) & (F.col("words") >= 2 * WORDS),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in why.items()]))
    return x.where(lacking).select("doc_id", F.explode_outer(F.array(reasons)).alias("reasons")).where(F.size("reasons") > 0)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids of spam pages."""
    return spam_pages(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id")


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages by language, source and reason."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    x = spam_pages(docs).select("doc_id", F.explode("reasons").alias("reason"))
    return x.join(docs.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source", "reason").agg(F.count("*").alias("pages"))
