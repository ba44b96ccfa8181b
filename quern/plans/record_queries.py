"""Queries over chat records: projections, filters, deduplication, joins, routing, answer parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import verify
from quern.functions.text import last_of, rank_key, record_key, role_text, squeezed, unspaced
from quern.operators import near_duplicates, ranking
from quern.plans.core_queries import LAST, SOURCE, TASK, task_name
from quern.plans.registry import Registry

R = Registry()
query = R.query
SFT, TRAIN, BENCH, DOCS = "sft_records", "train_multi_sft_minhash_dedup", "bench_candidates", "documents"

USERS = "array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: coalesce(x.content, '')), chr(10))"
QUESTION = "list_filter(messages, lambda x: x.role = 'user' and trim(coalesce(x.content, '')) <> '')[-1].content"
SQUEEZED = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
IMAGES = "coalesce(images, [])"


def answer() -> Column:
    return F.coalesce(last_of(F.col("messages"), "assistant"), F.lit(""))


def images() -> Column:
    return F.coalesce("images", F.array().cast("array<string>"))


def question() -> Column:
    """The last non-blank user message."""
    asked = F.filter("messages", lambda m: (m["role"] == "user") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.try_element_at(asked, F.lit(-1))["content"]


def source_name() -> Column:
    return task_name("source")


# -- projections ---------------------------------------------------------------
@query("select candidate_id, ['user', 'assistant'] as roles, [question, answer] as contents, lower(benchmark) as source, 'test' as split, task from bench_candidates where coalesce(question, '') <> '' and coalesce(answer, '') <> ''")
def prj1_record(t):
    said = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    x = t(BENCH).where("coalesce(question, '') <> '' and coalesce(answer, '') <> ''").withColumn("messages", F.array(said("user", "question"), said("assistant", "answer")))
    return x.select("candidate_id", F.col("messages.role").alias("roles"), F.col("messages.content").alias("contents"), F.lower("benchmark").alias("source"), F.lit("test").alias("split"), "task")


@query("select row_id, len(messages) as messages, coalesce(source, '') as source, coalesce(split, 'train') as split, coalesce(task, '') as task, -1 as pass_at_k from train_multi_sft_minhash_dedup")
def prj2_five_columns(t):
    return t(TRAIN).select("row_id", F.size("messages").cast("long").alias("messages"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("split", F.lit("train")).alias("split"), F.coalesce("task", F.lit("")).alias("task"), F.lit(-1).alias("pass_at_k"))


@query("select candidate_id, 'G' || i as claim, trim(choices[i]) as text, len(choices) <> len(list_distinct(list_transform(choices, lambda c: trim(c)))) as repeated from (select candidate_id, choices, unnest(range(1, len(choices) + 1))::int as i from bench_candidates where choices is not null)")
def prj9_claims(t):
    x = t(BENCH).select("candidate_id", F.transform("choices", lambda c: F.trim(c)).alias("c"))
    return x.select("candidate_id", F.posexplode("c").alias("i", "text"), (F.size("c") != F.size(F.array_distinct("c"))).alias("repeated")).select("candidate_id", F.concat(F.lit("G"), (F.col("i") + 1).cast("string")).alias("claim"), "text", "repeated")


@query(f"select record_id, list_transform({IMAGES}, lambda p: case when starts_with(p, 'images/') then 'assets/' || substr(p, 8) else p end) as paths from sft_records")
def prj14_rewritten_paths(t):
    moved = lambda p: F.when(p.startswith("images/"), F.concat(F.lit("assets/"), F.substring(p, 8, 1 << 30))).otherwise(p)
    return t(SFT).select("record_id", F.transform(images(), moved).alias("paths"))


@query("with u as (select record_id, p, i from (select record_id, unnest(images) as p, unnest(range(1, len(images) + 1)) as i from sft_records)), f as (select p, min(struct_pack(r := record_id, i := i)) as first from u where p is not null group by p) select p as path, row_number() over (order by first) as number from f")
def prj15_image_numbers(t):
    """Pictures numbered by first use; ranges of first uses are ranked apart, so no window spans the table."""
    u = t(SFT).select("record_id", F.posexplode("images").alias("i", "path")).where("path is not null")
    f = u.groupBy("path").agg(F.min(F.struct("record_id", "i")).alias("first")).withColumn("part", F.floor(F.col("first.record_id") / 5000))
    parts = f.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    return f.join(before, "part").select("path", (F.col("before") + place).alias("number"))


@query("select candidate_id, benchmark || ':' || source_id as origin, list_filter(['choices', 'media'], lambda c: (c = 'choices' and choices is not null) or (c = 'media' and media is not null)) as fields from bench_candidates")
def prj26_provenance(t):
    given = F.array_compact(F.array(F.when(F.col("choices").isNotNull(), "choices"), F.when(F.col("media").isNotNull(), "media")))
    return t(BENCH).select("candidate_id", F.concat("benchmark", F.lit(":"), "source_id").alias("origin"), given.alias("fields"))


@query(f"select record_id, coalesce(nullif(trim(bundle_id), ''), nullif(trim(source), ''), record_id::varchar) as first_id, {LAST} as answer from sft_records")
def prj27_accessors(t):
    ids = [F.nullif(F.trim(c), F.lit("")) for c in ("bundle_id", "source")]
    return t(SFT).select("record_id", F.coalesce(*ids, F.col("record_id").cast("string")).alias("first_id"), answer().alias("answer"))


@query(f"select record_id, {QUESTION} as question from sft_records")
def prj28_question(t):
    return t(SFT).select("record_id", question().alias("question"))


@query(r"select record_id, list_transform(messages, lambda m: trim(regexp_replace(coalesce(m.content, ''), '</?answer>|<image>', '', 'g'), ' ')) as texts from sft_records")
def prj32_without_markers(t):
    return t(SFT).select("record_id", F.transform("messages", lambda m: F.trim(F.regexp_replace(F.coalesce(m["content"], F.lit("")), "</?answer>|<image>", ""))).alias("texts"))


# -- filters -------------------------------------------------------------------
@query("select kind, count(*) as refs, count(distinct ref) as distinct_refs from (select ref, case when coalesce(trim(ref), '') = '' then 'empty' when regexp_matches(ref, '^https?://') then 'remote' when starts_with(ref, 'data:') then 'embedded' when starts_with(ref, '/') then 'absolute' when contains(ref, '/') then 'relative' else 'bare' end as kind from (select unnest(images) as ref from sft_records)) group by kind")
def flt2_image_references(t):
    r = F.col("ref")
    kind = F.when(F.trim(F.coalesce(r, F.lit(""))) == "", "empty").when(r.rlike("^https?://"), "remote").when(r.startswith("data:"), "embedded").when(r.startswith("/"), "absolute").when(r.contains("/"), "relative").otherwise("bare")
    return t(SFT).select(F.explode("images").alias("ref")).groupBy(kind.alias("kind")).agg(F.count("*").alias("refs"), F.count_distinct("ref").alias("distinct_refs"))


@query(f"select candidate_id, list_filter([case when question is null or trim(question) = '' then 'no_question' end, case when answer is null or trim(answer) = '' then 'no_answer' end, case when choices is not null and len(choices) < 2 then 'few_choices' end, case when n > 1 then 'repeated_pair' end], lambda e: e is not null) as errors from (select *, count(*) over (partition by {SQUEEZED.format('question')}, {SQUEEZED.format('answer')}) as n from bench_candidates)")
def flt4_benchmark_rules(t):
    x = t(BENCH).withColumns({"_q": squeezed(F.col("question")), "_a": squeezed(F.col("answer"))})
    x = x.withColumn("_n", F.count("*").over(Window.partitionBy("_q", "_a")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {"no_question": blank("question"), "no_answer": blank("answer"), "few_choices": F.size("choices").between(0, 1) & F.col("choices").isNotNull(), "repeated_pair": F.col("_n") > 1}
    return x.select("candidate_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("errors"))


@query("select task, count(*) as items, count(*) = 20 as as_planned from bench_candidates group by task")
def flt5_shape(t):
    return t(BENCH).groupBy("task").agg(F.count("*").alias("items"), (F.count("*") == 20).alias("as_planned"))


@query(rf"select record_id, trim(regexp_extract({QUESTION}, '([^\n]*)$', 1)) as focus from sft_records")
def flt8_focus(t):
    return t(SFT).select("record_id", F.trim(F.substring_index(question(), "\n", -1)).alias("focus"))


CALCULATION = r"how much|by what|percent|growth|change|ratio|增长|变动|比率|多少|wie hoch|anteil"


@query(rf"select record_id, score from (select record_id, 4 * coalesce(regexp_matches(lower({QUESTION}), '{CALCULATION}')::int, 0) + case when {SOURCE} like '%note%' then 1 else 0 end + coalesce((len(regexp_extract_all({QUESTION}, '\d[\d,]*(?:\.\d+)?')) >= 2)::int, 0) as score from sft_records) where score >= 4")
def flt9_calculation_score(t):
    q = question()
    part = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 4 * part(F.lower(q).rlike(CALCULATION)) + part(source_name().contains("note")) + part(F.regexp_count(q, F.lit(r"\d[\d,]*(?:\.\d+)?")) >= 2)
    return t(SFT).select("record_id", score.alias("score")).where("score >= 4")


TERMS = ["cash flow", "现金流", "umsatz", "goodwill", "商誉"]


@query("select doc_id, " + " or ".join(f"contains(lower(text), '{w}')" for w in TERMS) + " as named from documents")
def flt17_any_term(t):
    return t(DOCS).select("doc_id", F.exists(F.array(*map(F.lit, TERMS)), lambda w: F.contains(F.lower("text"), w)).alias("named"))


@query("select fact_id, case when fact_type in ('numeric', 'text', 'table', 'visual') then fact_type else 'other' end as kind, case when lower(confidence) in ('high', 'medium') then lower(confidence) else 'low' end as level from evidence_facts")
def flt18_clamped(t):
    clamp = lambda c, known, default: F.when(c.isin(*known), c).otherwise(default)
    return t("evidence_facts").select("fact_id", clamp(F.col("fact_type"), ["numeric", "text", "table", "visual"], "other").alias("kind"), clamp(F.lower("confidence"), ["high", "medium"], "low").alias("level"))


# -- deduplication ---------------------------------------------------------------
@query()
def ddp1_near_dedup(t):
    """Rows kept by the greedy MinHash pass over all training rows, in order of their ids."""
    return near_duplicates.kept_rows(t(TRAIN), "row_id", near_duplicates.message_text(F.col("messages")))


@query()
def ddp4_band_keys(t):
    """Bands of the training rows' signatures that more than one distinct text shares, with their sizes."""
    x = t(TRAIN).select(F.col("row_id").alias("ord"), near_duplicates.message_text(F.col("messages")).alias("text")).groupBy("text").agg(F.min("ord").alias("ord"))
    k = near_duplicates.signatures(x).select("ord", F.explode(near_duplicates.band_keys(F.col("sig"))).alias("k"))
    return k.groupBy("k.band", "k.places").agg(F.count("*").alias("rows")).where("rows > 1").groupBy("band").agg(F.count("*").alias("shared"), F.max("rows").alias("largest"))


@query(r"select row_id, md5(trim(regexp_replace(lower(array_to_string(list_transform(messages, lambda m: coalesce(m.role, '') || ': ' || coalesce(m.content, '')), chr(10))), '\s+', ' ', 'g'))) as text_md5 from train_multi_sft_minhash_dedup")
def ddp6_message_text(t):
    return t(TRAIN).select("row_id", F.md5(near_duplicates.message_text(F.col("messages"))).alias("text_md5"))


DDP9 = "concat_ws(chr(31), coalesce(question, ''), array_to_string(coalesce(media, []), chr(30)), coalesce(task, ''), coalesce(answer, ''))"


@query(f"select min(candidate_id) as candidate_id, 'rlc_' || substr(sha1({DDP9}), 1, 20) as id from bench_candidates group by {DDP9}")
def ddp9_candidate_ids(t):
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    key = F.concat_ws("\x1f", c("question"), F.array_join(F.coalesce("media", F.array().cast("array<string>")), "\x1e"), c("task"), c("answer"))
    return t(BENCH).groupBy(key.alias("key")).agg(F.min("candidate_id").alias("candidate_id")).select("candidate_id", F.concat(F.lit("rlc_"), F.substring(F.sha1("key"), 1, 20)).alias("id"))


@query(f"select record_id, case when r > 1 then 'duplicate_id' when empty then 'no_answer' end as error from (select record_id, row_number() over (partition by {SQUEEZED.format(QUESTION)} order by record_id) as r, trim({LAST}, ' ') = '' as empty from sft_records)")
def ddp13_duplicate_lane(t):
    x = t(SFT).select("record_id", squeezed(question()).alias("key"), (F.trim(answer()) == "").alias("empty"))
    first = x.groupBy("key").agg(F.min("record_id").alias("first"))
    x = x.alias("x").join(first.alias("f"), F.col("x.key").eqNullSafe(F.col("f.key")))
    return x.select("record_id", F.when(F.col("record_id") > F.col("first"), "duplicate_id").when(F.col("empty"), "no_answer").alias("error"))


TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[一-鿿]|[a-z0-9]+'))"


@query(f"select candidate_id, round(case when len(list_distinct(list_concat(q, a))) = 0 then 0 else len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) end, 6) as similarity from (select candidate_id, {TOKENS.format('question')} as q, {TOKENS.format('answer')} as a from bench_candidates)")
def ddp14_token_jaccard(t):
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([一-鿿]|[a-z0-9]+)"), F.lit(1)))
    x = t(BENCH).select("candidate_id", tokens("question").alias("q"), tokens("answer").alias("a"))
    every = F.size(F.array_union("q", "a"))
    return x.select("candidate_id", F.round(F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect("q", "a")) / every), 6).alias("similarity"))


STRIPPED = "regexp_replace(coalesce({}, ''), '[^一-鿿A-Za-z0-9%]', '', 'g')"


def bigrams(text: Column) -> Column:
    """The distinct character pairs of a text without anything but CJK, Latin letters, digits and percent signs."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[^一-鿿A-Za-z0-9%]", "")
    chars = F.split(s, "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.length(s) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.length(s) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.when(F.length(s) > 1, pairs).otherwise(F.array().cast("array<string>")))


@query(f"select candidate_id, len(list_distinct(list_transform(range(1, greatest(len(s), 1)), lambda i: substr(s, i::int, 2)))) as bigrams from (select candidate_id, {STRIPPED.format('question')} as s from bench_candidates)")
def ddp15_bigrams(t):
    return t(BENCH).select("candidate_id", F.size(bigrams(F.col("question"))).cast("long").alias("bigrams"))


KEY = r"regexp_replace({}, '\s+', '', 'g')"


@query(f"select row_id from (select min(row_id) as row_id, k from (select row_id, {KEY.format(QUESTION)} as k from train_multi_sft_minhash_dedup) where k is not null group by k) where k not in (select {KEY.format('question')} from bench_candidates where question is not null) order by row_id limit 500")
def ddp16_distinct_and_clean(t):
    """The first 500 rows by id whose question is new and stands in no benchmark item."""
    x = t(TRAIN).select("row_id", unspaced(question()).alias("k")).where("k is not null").groupBy("k").agg(F.min("row_id").alias("row_id"))
    held = t(BENCH).where("question is not null").select(unspaced(F.col("question")).alias("k")).distinct()
    return x.join(held, "k", "left_anti").select("row_id").orderBy("row_id").limit(500)


# -- joins -----------------------------------------------------------------------
JKEY = f"concat_ws(chr(31), coalesce(task, chr(0)), coalesce(source, chr(0)), coalesce(bundle_id, chr(0)), array_to_string({IMAGES}, chr(30)), coalesce({QUESTION}, chr(0)), {LAST})"


@query(f"with l as (select row_id, {JKEY} as k from train_multi_sft_minhash_dedup), r as (select record_id, {JKEY} as k from sft_records), ln as (select k, count(*) as n from l group by k), rn as (select k, count(*) as n, min(record_id) as id from r group by k) select row_id, case when ln.n > 1 then 'repeated_left' when rn.n is null then 'missing' when rn.n > 1 then 'repeated_right' else 'ok' end as status, case when ln.n = 1 and rn.n = 1 then rn.id end as record_id from l join ln using (k) left join rn using (k)")
def jon1_composite_key(t):
    c = lambda n: F.coalesce(F.col(n), F.lit("\x00"))
    key = F.concat_ws("\x1f", c("task"), c("source"), c("bundle_id"), F.array_join(images(), "\x1e"), F.coalesce(question(), F.lit("\x00")), answer()).alias("k")
    left, right = t(TRAIN).select("row_id", key), t(SFT).select("record_id", key)
    r = right.groupBy("k").agg(F.count("*").alias("rn"), F.min("record_id").alias("id"))
    x = left.join(left.groupBy("k").agg(F.count("*").alias("ln")), "k").join(r, "k", "left")
    status = F.when(F.col("ln") > 1, "repeated_left").when(F.col("rn").isNull(), "missing").when(F.col("rn") > 1, "repeated_right").otherwise("ok")
    return x.select("row_id", status.alias("status"), F.when((F.col("ln") == 1) & (F.col("rn") == 1), F.col("id")).alias("record_id"))


PRINT = r"sha256(trim(regexp_replace(regexp_replace(lower({} || chr(10) || {}), '<image ?\d*>', '', 'g'), '\s+', ' ', 'g')))"


@query(f"select row_id from train_multi_sft_minhash_dedup where {QUESTION} is null or {PRINT.format(QUESTION, LAST)} not in (select {PRINT.format('question', 'answer')} from bench_candidates where question is not null and answer is not null)")
def jon3_fingerprint_anti_join(t):
    mark = lambda q, a: F.sha2(squeezed(F.regexp_replace(F.lower(F.concat(q, F.lit("\n"), a)), r"<image ?\d*>", "")), 256)
    held = t(BENCH).where("question is not null and answer is not null").select(mark(F.col("question"), F.col("answer")).alias("p")).distinct()
    return t(TRAIN).select("row_id", mark(question(), answer()).alias("p")).join(held, "p", "left_anti").select("row_id")


@query("select name, count(distinct folder) as folders, count(distinct folder) > 1 as conflict from (select regexp_extract(p, '([^/]*)$', 1) as name, regexp_replace(p, '[^/]*$', '') as folder from (select unnest(images) as p from sft_records)) where name <> '' group by name")
def jon13_functional_mapping(t):
    x = t(SFT).select(F.explode("images").alias("p")).select(F.regexp_extract("p", "([^/]*)$", 1).alias("name"), F.regexp_replace("p", "[^/]*$", "").alias("folder")).where("name <> ''")
    n = F.count_distinct("folder")
    return x.groupBy("name").agg(n.alias("folders"), (n > 1).alias("conflict"))


# -- ranking, quotas --------------------------------------------------------------
@query(f"select record_id, task from (select *, row_number() over (partition by task order by case when mm and r <= 20 then 0 when not mm then 1 else 2 end, r) as place from (select record_id, {TASK} as task, coalesce(len(images), 0) > 0 as mm, row_number() over (partition by {TASK}, coalesce(len(images), 0) > 0 order by record_id) as r from sft_records)) where place <= 30")
def win2_modality_quota(t):
    """Per task 30 rows: up to 20 with pictures, then text ones, then further ones with pictures."""
    x = t(SFT).select("record_id", task_name().alias("task"), (F.size(images()) > 0).alias("mm"))
    x = ranking.top_per_group(x, ["task", "mm"], 30, F.col("record_id")).withColumnRenamed("place", "r")
    lane = F.when(F.col("mm") & (F.col("r") <= 20), 0).when(~F.col("mm"), 1).otherwise(2)
    return ranking.top_per_group(x, ["task"], 30, lane, F.col("r")).select("record_id", "task")


@query(f"select record_id, row_number() over (order by sha256('5' || chr(0) || 'keep' || chr(0) || record_id), record_id) <= 25 as kept from sft_records where {TASK} = 'financial_translation'")
def win5_keep_n(t):
    """25 rows of one task by a seeded order; the others are routed away. The cut is found first, so no window spans the task."""
    x = t(SFT).where(task_name() == "financial_translation").select("record_id", rank_key(5, "keep", F.col("record_id")).alias("draw"))
    kept = x.orderBy("draw", "record_id").limit(25).select("record_id", F.lit(True).alias("kept"))
    return x.select("record_id").join(kept, "record_id", "left").select("record_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(r"select candidate_id, task, epoch::bigint as epoch, row_number() over (partition by task, epoch order by sha256('9' || chr(0) || coalesce(task, '') || chr(0) || epoch || chr(0) || candidate_id)) as place from bench_candidates, (select unnest([0, 1, 2]) as epoch)")
def win12_epoch_order(t):
    """Three passes without replacement over each task's items, reshuffled at every exhaustion."""
    x = t(BENCH).select("candidate_id", "task", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("epoch"))
    draw = F.sha2(F.concat_ws("\x00", F.lit("9"), F.coalesce("task", F.lit("")), "epoch", "candidate_id"), 256)
    return x.select("candidate_id", "task", "epoch", F.row_number().over(Window.partitionBy("task", "epoch").orderBy(draw)).alias("place"))


@query("select candidate_id from (select candidate_id, -ln((('0x' || substr(sha256('4' || chr(0) || 'pick' || chr(0) || candidate_id), 1, 12))::bigint + 1) / 281474976710657.0) / (1 + len(coalesce(question, ''))) as k from bench_candidates) order by k, candidate_id limit 100")
def win13_weighted_choice(t):
    """100 items without replacement, weighted by their length: the smallest -ln(u) / weight."""
    u = (F.conv(F.substring(rank_key(4, "pick", F.col("candidate_id")), 1, 12), 16, 10).cast("long") + 1) / F.lit(281474976710657.0)
    x = t(BENCH).select("candidate_id", (-F.log(u) / (1 + F.length(F.coalesce("question", F.lit(""))))).alias("k"))
    return x.orderBy("k", "candidate_id").limit(100).select("candidate_id")


@query("select candidate_id, task, (r - 1 - o % n + n) % n as turn from (select candidate_id, task, row_number() over (partition by task order by candidate_id) as r, count(*) over (partition by task) as n, ('0x' || substr(sha256('8' || chr(0) || 'turn' || chr(0) || coalesce(task, '')), 1, 8))::bigint as o from bench_candidates)")
def win16_rotation(t):
    n = t(BENCH).groupBy(F.coalesce("task", F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    x = t(BENCH).select("candidate_id", "task", F.row_number().over(Window.partitionBy("task").orderBy("candidate_id")).alias("r"), F.coalesce("task", F.lit("")).alias("k")).join(n, "k")
    o = F.conv(F.substring(rank_key(8, "turn", F.col("k")), 1, 8), 16, 10).cast("long")
    return x.select("candidate_id", "task", F.pmod(F.col("r") - 1 - o % F.col("n"), F.col("n")).cast("long").alias("turn"))


@query("select record_id, ('0x' || substr(sha256('7:model:' || record_id), 1, 8))::bigint as seed, record_id % 16 as worker from sft_records")
def win18_seed_and_shard(t):
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("7:model:"), F.col("record_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return t(SFT).select("record_id", seed.alias("seed"), (F.col("record_id") % 16).alias("worker"))


@query("select record_id, sha256('21' || chr(0) || 'rank' || chr(0) || coalesce(nullif(bundle_id, ''), record_id::varchar)) as draw from sft_records")
def win30_rank_key(t):
    return t(SFT).select("record_id", rank_key(21, "rank", F.col("bundle_id"), F.col("record_id")).alias("draw"))


# -- set operations ----------------------------------------------------------------
@query(f"select record_id from (select min(record_id) as record_id, k from (select record_id, {KEY.format(QUESTION)} as k from sft_records where regexp_matches({LAST}, '\\d')) where k is not null group by k) where k not in (select {KEY.format(QUESTION)} from train_multi_sft_minhash_dedup where {QUESTION} is not null)")
def set2_new_calculations(t):
    """Filter first, then first occurrence, then without the questions that are there already."""
    x = t(SFT).where(answer().rlike(r"\d")).select("record_id", unspaced(question()).alias("k")).where("k is not null").groupBy("k").agg(F.min("record_id").alias("record_id"))
    return x.join(t(TRAIN).select(unspaced(question()).alias("k")).where("k is not null").distinct(), "k", "left_anti").select("record_id")


@query("select id, origin, row_number() over (partition by lane order by origin, id) as number, lane from (select candidate_id as id, 'bench' as origin, case when choices is null then 'generation' else 'reasoning' end as lane from bench_candidates union all select row_id, 'train', case when coalesce(len(images), 0) > 0 then 'generation' else 'reasoning' end from train_multi_sft_minhash_dedup)")
def set3_moved_and_renumbered(t):
    """Two tables dealt anew to two lanes, each numbered densely from ranges of ids whose sizes give the offsets."""
    a = t(BENCH).select(F.col("candidate_id").alias("id"), F.lit("bench").alias("origin"), F.when(F.col("choices").isNull(), "generation").otherwise("reasoning").alias("lane"))
    b = t(TRAIN).select(F.col("row_id").alias("id"), F.lit("train").alias("origin"), F.when(F.size(images()) > 0, "generation").otherwise("reasoning").alias("lane"))
    x = a.unionByName(b).withColumn("part", F.floor(F.col("id") / 1000))
    n = x.groupBy("lane", "origin", "part").agg(F.count("*").alias("n"))
    before = n.select("lane", "origin", "part", (F.sum("n").over(Window.partitionBy("lane").orderBy("origin", "part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("lane", "origin", "part").orderBy("id"))
    return x.join(before, ["lane", "origin", "part"]).select("id", "origin", (F.col("before") + place).alias("number"), "lane")


@query("select candidate_id, choices is not null as by_rule from bench_candidates")
def set5_two_ways(t):
    return t(BENCH).select("candidate_id", F.col("choices").isNotNull().alias("by_rule"))


@query(f"select origin, kind, count(*) as rows from (select 'sft' as origin, case when {LAST} = '' then 'error' else 'ok' end as kind from sft_records union all select 'train', case when {LAST} = '' then 'error' else 'ok' end from train_multi_sft_minhash_dedup) group by all")
def set6_union_statistics(t):
    kind = F.when(answer() == "", "error").otherwise("ok").alias("kind")
    x = t(SFT).select(F.lit("sft").alias("origin"), kind).unionByName(t(TRAIN).select(F.lit("train").alias("origin"), kind))
    return x.groupBy("origin", "kind").agg(F.count("*").alias("rows"))


@query()
def set7_ordered_distinct_union(t):
    """The first row of each content over both tables, the training rows first."""
    a = t(TRAIN).select(F.lit(0).alias("file"), F.col("row_id").alias("id"), record_key(F.col("messages"), F.col("images")).alias("k"))
    b = t(SFT).select(F.lit(1).alias("file"), F.col("record_id").alias("id"), record_key(F.col("messages"), F.col("images")).alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.min(F.struct("file", "id")).alias("first")).select("first.*")


@query("select candidate_id, case when benchmark in (select benchmark from bench_candidates group by 1 order by count(*) desc, benchmark limit 2) then 'keep' else 'repair' end as lane from bench_candidates")
def set8_keep_and_repair(t):
    top = t(BENCH).groupBy("benchmark").count().orderBy(F.desc("count"), "benchmark").limit(2).select("benchmark", F.lit("keep").alias("lane"))
    return t(BENCH).select("candidate_id", "benchmark").join(F.broadcast(top), "benchmark", "left").select("candidate_id", F.coalesce("lane", F.lit("repair")).alias("lane"))


# -- scalar functions ---------------------------------------------------------------
@query(rf"select record_id, trim(regexp_extract_all({LAST}, '(?is)<answer>\s*(.*?)\s*</answer>', 1)[-1]) as tagged, trim(regexp_extract_all({LAST}, '答案\s*[:：][ \t]*([^\r\n]*)', 1)[-1]) as labelled from sft_records")
def str1_last_answer(t):
    last = lambda p: F.trim(F.try_element_at(F.regexp_extract_all(answer(), F.lit(p), F.lit(1)), F.lit(-1)))
    return t(SFT).select("record_id", last(r"(?is)<answer>\s*(.*?)\s*</answer>").alias("tagged"), last(r"答案\s*[:：][ \t]*([^\r\n]*)").alias("labelled"))


_STEPS = [r"(?is)<answer>\s*(.*?)\s*</answer>", r"(?i)(?:最终答案|答案|最终结果|结论|Final\s+Answer|Answer)\s*[:：]\s*([^\r\n]+)", r'(?is)"answer"\s*:\s*"([^"]*)"', r"\\boxed\s*\{([^{}]+)\}"]


@query("select record_id, coalesce(" + ", ".join(f"nullif(trim(regexp_extract_all({LAST}, '{p}', 1)[-1]), '')" for p in _STEPS) + f", case when not contains(trim({LAST}, chr(10) || ' '), chr(10)) then nullif(trim({LAST}, chr(10) || ' '), '') end) as answer from sft_records")
def str2_final_answer(t):
    """Tag, label, JSON field, box, else the only line."""
    a = answer()
    steps = [F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(a, F.lit(p), F.lit(1)), F.lit(-1))), F.lit("")) for p in _STEPS]
    line = F.trim(F.regexp_replace(a, r"^[\n ]+|[\n ]+$", ""))
    return t(SFT).select("record_id", F.coalesce(*steps, F.when(~line.contains("\n"), F.nullif(line, F.lit("")))).alias("answer"))


@query(f"select candidate_id, list_sort(list_distinct(regexp_extract_all(upper(answer), '\\b[A-H]\\b'))) as letters, list_sort(list_distinct(regexp_extract_all(answer, '\\d+'))) as pages from bench_candidates where answer is not null")
def str6_atoms(t):
    every = lambda c, p: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    return t(BENCH).where("answer is not null").select("candidate_id", every(F.upper("answer"), r"\b[A-H]\b").alias("letters"), every(F.col("answer"), r"\d+").alias("pages"))


@query()
def str9_scores(t):
    """Each benchmark answer scored as a completion against itself as gold, by kind."""
    kind = F.when(F.col("choices").isNotNull(), "single_choice").when(F.col("answer").rlike(r"\d"), "numeric").otherwise("true_false")
    x = t(BENCH).select("candidate_id", F.concat(F.lit("Answer: "), "answer").alias("completion"), F.array("answer").alias("gold"), kind.alias("kind"), "question")
    return verify.scores(x, "candidate_id", "completion", "gold", "kind", "question")


@query(r"select candidate_id, list_transform(list_sort(map_keys(o)), lambda k: k || '=' || o[k]) as options from (select candidate_id, map(list_transform(range(1, len(choices) + 1), lambda i: chr(64 + i::int)), list_transform(choices, lambda c: trim(regexp_replace(c, '^[A-H][.)、]\s*', '')))) as o from bench_candidates where choices is not null)")
def str19_option_map(t):
    texts = F.transform("choices", lambda c: F.trim(F.regexp_replace(c, r"^[A-H][.)、]\s*", "")))
    letters = F.transform("choices", lambda c, i: F.char(F.lit(65) + i))
    o = F.map_from_arrays(letters, texts)
    return t(BENCH).where("choices is not null").select("candidate_id", o.alias("o")).select("candidate_id", F.transform(F.array_sort(F.map_keys("o")), lambda k: F.concat(k, F.lit("="), F.element_at("o", k))).alias("options"))


@query(rf"select record_id, len(regexp_extract_all({LAST}, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) as controls, len(regexp_extract_all({LAST}, chr(65533))) as replaced, len(w) as words, case when len(w) = 0 then 0 else round(len(list_distinct(w)) / len(w), 6) end as diversity, case when len(w) < 4 then 0 else round(1 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) / (len(w) - 3), 6) end as repetition from (select *, regexp_extract_all(lower({LAST}), '[一-鿿]|[a-z0-9]+') as w from sft_records)")
def str20_anomalies(t):
    """Control and replacement characters, distinct share of tokens, repeated share of 4-grams."""
    a = answer()
    w = F.regexp_extract_all(F.lower(a), F.lit("([一-鿿]|[a-z0-9]+)"), F.lit(1))
    x = t(SFT).select("record_id", F.regexp_count(a, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).cast("long").alias("controls"), F.regexp_count(a, F.lit("�")).cast("long").alias("replaced"), w.alias("w"))
    n = F.size("w")
    part = lambda k: F.slice("w", k, F.greatest(n - 3, F.lit(0)))
    grams = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.concat_ws(" ", x, y)), F.zip_with(part(3), part(4), lambda x, y: F.concat_ws(" ", x, y)), lambda x, y: F.concat_ws(" ", x, y))
    return x.select("record_id", "controls", "replaced", n.cast("long").alias("words"), F.when(n == 0, 0.0).otherwise(F.round(F.size(F.array_distinct("w")) / n, 6)).alias("diversity"), F.when(n < 4, 0.0).otherwise(F.round(1 - F.size(F.array_distinct(grams)) / (n - 3), 6)).alias("repetition"))


@query("select candidate_id, '| ' || array_to_string(list_transform(choices, lambda c: replace(c, '|', '\\|')), ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(choices)) as md from bench_candidates where choices is not null and len(choices) > 0")
def str26_markdown_row(t):
    cells = F.transform("choices", lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    md = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n|"), F.expr("repeat('---|', size(choices))"))
    return t(BENCH).where("size(choices) > 0").select("candidate_id", md.alias("md"))


@query(r"select fact_id, regexp_replace(round(v, 4)::decimal(24,4)::varchar, '\.?0+$', '') as shown, nullif(regexp_extract(period, '(?:19|20)\d\d'), '') as year from (select fact_id, period, try_cast(replace(regexp_extract(numeric_value, '^-?\d[\d,]*(?:\.\d+)?$'), ',', '') as decimal(24,8)) as v from evidence_facts)")
def str32_shown_decimal(t):
    v = F.replace(F.regexp_extract("numeric_value", r"^(-?\d[\d,]*(?:\.\d+)?)$", 1), F.lit(","), F.lit("")).try_cast("decimal(24,8)")
    shown = F.regexp_replace(F.round(v, 4).cast("decimal(24,4)").cast("string"), r"\.?0+$", "")
    return t("evidence_facts").select("fact_id", shown.alias("shown"), F.nullif(F.regexp_extract("period", r"(?:19|20)\d\d", 0), F.lit("")).alias("year"))


@query(rf"select record_id, {KEY.format(QUESTION)} as question_key, sha256(coalesce({USERS}, '')) as role_key from sft_records")
def str37_question_key(t):
    return t(SFT).select("record_id", unspaced(question()).alias("question_key"), F.sha2(F.coalesce(role_text(F.col("messages"), "user"), F.lit("")), 256).alias("role_key"))


@query(f"select record_id, 256.0 * coalesce(len(images), 0) + len({USERS}) / 4.0 as cost from sft_records")
def str40_evaluation_cost(t):
    return t(SFT).select("record_id", (256.0 * F.size(images()) + F.length(role_text(F.col("messages"), "user")) / 4.0).alias("cost"))


@query("select fact_id, lower(coalesce(case when lower(trim(entity)) not in ('', 'unknown') then entity end, case when lower(trim(document_id)) not in ('', 'unknown') then document_id end, 'none')) as key from evidence_facts")
def str41_fallback_key(t):
    given = lambda c: F.when(~F.lower(F.trim(c)).isin("", "unknown"), F.col(c))
    return t("evidence_facts").select("fact_id", F.lower(F.coalesce(given("entity"), given("document_id"), F.lit("none"))).alias("key"))
