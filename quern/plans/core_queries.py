"""Queries of the core operators over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import answer_tail, choice, last_of, numbers, rank_key, record_key, role_text, squeezed, unspaced
from quern.operators import ranking as K
from quern.operators import relational as J
from quern.operators import reports as A

SFT, FACTS, DOCS, BENCH, BUNDLES, TRAIN = "sft_records", "evidence_facts", "documents", "bench_candidates", "document_bundles", "train_multi_sft_minhash_dedup"
_ALL: dict[str, tuple[Callable, str]] = {}


def query(sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))

        _ALL[f.__name__] = (run, sql)
        return f

    return keep


def queries() -> dict[str, Callable]:
    return {k: v for k, (v, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}


def task_name(c: str = "task") -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s\-]+", "_"), F.lit(""))


TASK = r"nullif(regexp_replace(lower(trim(task)), '[\s\-]+', '_', 'g'), '')"
SOURCE = r"nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), '')"


# -- aggregations ------------------------------------------------------------
@query(f"select coalesce({TASK}, 'unknown') task, count(*) as rows, round(count(*) * 100.0 / sum(count(*)) over (), 4) as percent from sft_records group by 1")
def agg1_task_histogram(t):
    return A.histogram(t(SFT), task_name(), "task")


@query("select fact_type, source_mode, count(*) as facts from evidence_facts group by all")
def agg2_fact_type_counts(t):
    return t(FACTS).groupBy("fact_type", "source_mode").agg(F.count("*").alias("facts"))


@query(f"select coalesce({SOURCE}, 'unknown') as source, count(*) as rows, count(*) filter (where len(images) > 0) as with_images, count(*) filter (where coalesce(len(images), 0) = 0) as text_only, count(distinct bundle_id) as bundles, round(avg(coalesce(len(images), 0)), 6) as mean_images from sft_records group by 1")
def agg10_modality_counters(t):
    n = F.coalesce(F.size(F.nullif(F.col("images"), F.array().cast("array<string>"))), F.lit(0))
    x = t(SFT).select(F.coalesce(task_name("source"), F.lit("unknown")).alias("source"), "bundle_id", F.when(F.col("images").isNull(), 0).otherwise(F.size("images")).alias("n"))
    return x.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("with_images"), F.count_if(F.col("n") == 0).alias("text_only"), F.count_distinct("bundle_id").alias("bundles"), F.round(F.avg("n"), 6).alias("mean_images"))


@query("select count(*) as rows, count(distinct img) as distinct_images from (select unnest(images) as img from sft_records)")
def agg13_distinct_images(t):
    return t(SFT).select(F.explode("images").alias("img")).agg(F.count("*").alias("rows"), F.count_distinct("img").alias("distinct_images"))


@query("select user_id, count(*) as rollouts, count(*) filter (where value >= 50) as accepted, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, min(value) as lowest, max(value) as highest, case when count(*) filter (where value >= 50) = 0 then 'none' when count(*) filter (where value >= 50) = count(*) then 'all' else 'mixed' end as kind from events group by user_id")
def agg14_reward_groups(t):
    return A.group_rewards(t("events"), "user_id", "value", 50.0)


@query("select k, count(*) as groups from (select o_custkey, count(*) filter (where o_totalprice > 200000) as k from orders group by 1 having count(*) >= 8) group by k")
def agg15_success_histogram(t):
    g = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 200000).alias("k"), F.count("*").alias("n")).where("n >= 8")
    return g.groupBy("k").agg(F.count("*").alias("groups"))


@query("with s as (select stddev_pop(value) as d from events), g as (select user_id, avg(value) as m from events group by 1) select event_id, user_id, value, round((value - m) / d, 6) as advantage from events join g using (user_id), s")
def agg16_advantage(t):
    return A.advantage(t("events").select("event_id", "user_id", "value"), "user_id", "value")


@query(f"select task, coalesce(p, 0) as planned, coalesce(a, 0) as actual, coalesce(a, 0) - coalesce(p, 0) as difference from (select {TASK} as task, count(*) as p from train_multi_sft_minhash_dedup group by 1) x full outer join (select {TASK} as task, count(*) as a from sft_records group by 1) y using (task) where task is not null")
def agg9_planned_and_actual(t):
    count = lambda name: t(name).select(task_name().alias("task")).where("task is not null").groupBy("task").agg(F.count("*").alias("n"))
    return A.planned_and_actual(count(TRAIN), count(SFT), "task")


@query("select user_id, max_by(event_type, struct_pack(a := n, b := event_type)) as best from (select user_id, event_type, count(*) as n from events group by all) group by user_id")
def agg7_best_by_key(t):
    g = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("best"))


@query("select reason, count(*) as rows from (select case when question is null or trim(question) = '' then 'empty_question' when answer is null or trim(answer) = '' then 'empty_answer' when choices is null then 'open' else 'choice' end as reason from bench_candidates) group by reason")
def agg24_rows_by_reason(t):
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = F.when(blank("question"), "empty_question").when(blank("answer"), "empty_answer").when(F.col("choices").isNull(), "open").otherwise("choice")
    return t(BENCH).groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


# -- joins -------------------------------------------------------------------
@query(r"select row_id from train_multi_sft_minhash_dedup where not exists (select 1 from bench_candidates b where sha256(regexp_replace(coalesce(b.question, ''), '\s+', '', 'g')) = sha256(regexp_replace(coalesce(list_filter(messages, lambda x: x.role = 'user')[-1].content, ''), '\s+', '', 'g')))")
def jon2_decontaminate(t):
    key = lambda c: F.sha2(unspaced(F.coalesce(c, F.lit(""))), 256)
    return J.decontaminated(t(TRAIN), key(last_of(F.col("messages"), "user")), t(BENCH), key(F.col("question"))).select("row_id")


@query("select record_id, bundle_id, document_id, package_type from sft_records join document_bundles using (bundle_id)")
def jon4_bundle_lookup(t):
    return t(SFT).select("record_id", "bundle_id").join(t(BUNDLES).select("bundle_id", "document_id", "package_type"), "bundle_id").select("record_id", "bundle_id", "document_id", "package_type")


_LANES = {"same_document": ("document_id", "''"), "same_entity_period": ("entity", "period"), "same_metric_cross_period": ("entity", "metric"), "same_topic": ("topic", "''"), "cross_modal_same_unit": ("unit_id", "''")}
_FACT = ", ".join(f"coalesce({c}, '') as {c}" for c in ("document_id", "page", "entity", "period", "metric", "topic", "unit_id", "source_mode"))
_LANE_ROWS = " union all ".join(f"select '{k}' as edge_type, {g} as g, {h} as h, f.* from f" + ("" if g == "unit_id" else f" where {g} <> ''" + ("" if h == "''" else f" and {h} <> ''")) for k, (g, h) in _LANES.items())


EDGES_SQL = (
    f"with f as (select fact_id, {_FACT} from evidence_facts), l as ({_LANE_ROWS}), "
    "r as (select *, row_number() over (partition by edge_type, g, h order by fact_id) as rn from l), "
    "p as (select x.fact_id as a, y.fact_id as b, edge_type, case edge_type when 'same_document' then case when x.page = y.page and x.page <> '' then 3.0 else 2.2 end when 'same_entity_period' then 3.4 "
    "when 'same_metric_cross_period' then case when x.period <> '' and y.period <> '' and x.period <> y.period then 4.0 end when 'same_topic' then case when x.entity = y.entity or x.document_id = y.document_id then 2.7 end "
    "else case when x.source_mode <> y.source_mode then 4.2 end end::double as weight from r x join r y using (edge_type, g, h) where y.rn between x.rn + 1 and x.rn + 6) "
    "select a, b, edge_type, weight from p where weight is not null and a <> b union all select b, a, edge_type, weight from p where weight is not null and a <> b"
)


@query(EDGES_SQL)
def jon7_evidence_edges(t):
    return J.evidence_edges(t(FACTS))


@query("with e as (select fact_id as a, lead(fact_id) over (partition by document_id order by fact_id) as b from evidence_facts) select a, b from e where b is not null union select b, a from e where b is not null")
def jon15_adjacency(t):
    return J.both_ways(J.neighbours(t(FACTS).select("document_id", "fact_id"), ["document_id"], "fact_id", 1))


@query("select document_id from document_bundles where document_id not in (select document_id from evidence_facts where document_id is not null) and document_id is not null")
def jon14_unreferenced(t):
    return t(BUNDLES).select("document_id").where("document_id is not null").join(t(FACTS).select("document_id"), "document_id", "left_anti")


@query("select document_id, min(fact_id) as first_fact, min_by(entity, fact_id) as entity, count(*) as facts from evidence_facts group by document_id")
def jon12_document_entity(t):
    return t(FACTS).groupBy("document_id").agg(F.min("fact_id").alias("first_fact"), F.min_by("entity", "fact_id").alias("entity"), F.count("*").alias("facts"))


# -- deduplication -----------------------------------------------------------
KEY_SQL = r"sha256(concat_ws(chr(29), array_to_string(list_transform(messages, lambda x: concat_ws(chr(31), x.role, coalesce(trim(regexp_replace(lower(x.content), '\s+', ' ', 'g'), ' '), ''))), chr(30)), array_to_string(list_transform(coalesce(images, []), lambda x: replace(x, '\', '/')), chr(30))))"


@query(f"select min(record_id) as record_id from sft_records group by {KEY_SQL}")
def ddp7_exact_dedup(t):
    return t(SFT).groupBy(record_key(F.col("messages"), F.col("images")).alias("k")).agg(F.min("record_id").alias("record_id")).select("record_id")


@query(f"select {KEY_SQL} as key, min(record_id) as first, count(*) as copies, list_sort(list_distinct(list({SOURCE}))) as labels from sft_records group by 1")
def ddp8_merged_copies(t):
    return J.merged_copies(t(SFT), record_key(F.col("messages"), F.col("images")), "record_id", task_name("source"))


@query("select doc_id from (select doc_id, row_number() over (partition by trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) order by (source = 'annual_reports')::int desc, doc_id) as r from documents) where r = 1")
def ddp10_preferred_copy(t):
    x = t(DOCS).select("doc_id", "source", squeezed(F.col("text")).alias("k"))
    return x.groupBy("k").agg(F.min_by("doc_id", F.struct((F.col("source") != "annual_reports"), "doc_id")).alias("doc_id")).select("doc_id")


@query("select case when candidate_id = min(candidate_id) over (partition by source_id) then source_id else source_id || ':dup:' || candidate_id end as new_id, candidate_id from bench_candidates where source_id is not null")
def ddp12_renamed_duplicates(t):
    return J.renamed_duplicates(t(BENCH).where("source_id is not null").select("source_id", "candidate_id"), "source_id", "candidate_id")


# -- windows, ranking, samples -----------------------------------------------
@query(f"select record_id, task, place from (select record_id, task, row_number() over (partition by task order by n desc, record_id) as place from (select m.r as record_id, m.t as task, m.n as n from (select min(struct_pack(r := record_id, t := task, n := n)) as m from (select record_id, {TASK} as task, coalesce(len(images), 0) as n, regexp_replace(list_filter(messages, lambda x: x.role = 'user')[-1].content, '\\s+', '', 'g') as k from sft_records) where k is not null and k not in (select regexp_replace(question, '\\s+', '', 'g') from bench_candidates where question is not null) group by k))) where place <= 20")
def win1_top_per_task(t):
    """The first 20 rows of a task by pictures and id, one per question and none whose question is a benchmark's."""
    x = t(SFT).select("record_id", task_name().alias("task"), F.when(F.col("images").isNull(), 0).otherwise(F.size("images")).alias("n"), unspaced(last_of(F.col("messages"), "user")).alias("k")).where("k is not null")
    x = J.decontaminated(x, F.col("k"), t(BENCH), unspaced(F.col("question")))
    x = x.groupBy("k").agg(F.min(F.struct("record_id", "task", "n")).alias("x")).select("x.*")
    return K.top_per_group(x, ["task"], 20, F.desc("n"), F.col("record_id")).select("record_id", "task", "place")


@query("select source, n, seats from (select source, n, floor(n * 500 / t)::bigint + (row_number() over (order by n * 500 % t desc, source) <= 500 - sum(floor(n * 500 / t)) over ())::int as seats from (select source, count(*) as n, sum(count(*)) over () as t from documents group by source))")
def win3_largest_remainder(t):
    return K.largest_remainder(t(DOCS).groupBy("source").agg(F.count("*").alias("n")), "source", "n", 500)


STRATA = f"select record_id, coalesce(source, '') || chr(31) || coalesce({TASK}, '') as stratum, sha256('7' || chr(0) || 'cohort:' || coalesce(source, '') || chr(31) || coalesce({TASK}, '') || chr(0) || coalesce(source, '') || chr(0) || record_id) as draw from sft_records"


@query(f"with x as ({STRATA}), c as (select stratum, n, floor(n * 500 / t)::bigint + (row_number() over (order by n * 500 % t desc, stratum) <= 500 - sum(floor(n * 500 / t)) over ())::int as seats from (select stratum, count(*) as n, sum(count(*)) over () as t from x group by stratum)) select record_id, stratum from (select record_id, stratum, seats, row_number() over (partition by stratum order by draw) as place from x join c using (stratum)) where place <= seats")
def win4_stratified_sample(t):
    """500 rows, shared over source and task in proportion, drawn within a stratum by a seeded hash."""
    source, task = (F.coalesce(c, F.lit("")) for c in (F.col("source"), task_name()))
    x = t(SFT).select("record_id", source.alias("source"), F.concat_ws("\x1f", source, task).alias("stratum"))
    return K.proportional_sample(x, "stratum", 500, 7, "cohort", ["source", "record_id"]).select("record_id", "stratum")


@query("select candidate_id, benchmark, row_number() over (partition by benchmark order by candidate_id) as turn from bench_candidates")
def win6_round_robin(t):
    return K.round_robin(t(BENCH).select("candidate_id", "benchmark"), "benchmark", F.col("candidate_id"))


@query(f"select record_id from (select record_id, ('0x' || substr(sha256('42:' || coalesce({TASK}, '') || ':' || case when coalesce(len(images), 0) > 0 then 'multi' else 'text' end || ':' || record_id), 1, 16))::ubigint / 18446744073709551616.0 as u from sft_records) where u < 0.25")
def win17_hash_cohort(t):
    """A quarter of the rows by a hash of seed, task, modality and index; a larger share holds every smaller one's rows."""
    modality = F.when(F.size("images") > 0, "multi").otherwise("text")
    return t(SFT).where(K.hash_share(42, F.coalesce(task_name(), F.lit("")), modality, F.col("record_id")) < 0.25).select("record_id")


@query("select event_id, step, value from (select event_id, floor(event_id / 1000)::bigint as step, value, row_number() over (partition by floor(event_id / 1000) order by value desc, event_id) as r from events) where r <= 3")
def win20_top_per_step(t):
    x = t("events").select("event_id", F.floor(F.col("event_id") / 1000).alias("step"), "value")
    return K.top_per_group(x, ["step"], 3, F.desc("value"), F.col("event_id")).select("event_id", "step", "value")




COST = "greatest(1, len(coalesce(list_filter(messages, lambda x: x.role = 'user')[-1].content, '')) // 4) + 256 * coalesce(len(images), 0) + 512"


@query(
    f"with recursive r as (select record_id, cost, (row_number() over (order by cost desc, record_id::varchar) - 1) // 7 as batch from (select record_id, ({COST})::bigint as cost from sft_records)), "
    "s as (select batch, sum(cost)::bigint as load from r group by batch), "
    "g as (select -1::bigint as batch, -1::bigint as worker, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as loads union all "
    "select s.batch, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, i: case when i = list_position(loads, list_min(loads)) then v + load else v end) from g join s on s.batch = g.batch + 1) "
    "select record_id, cost, batch, worker from r join g using (batch)"
)
def win8_cost_balanced_batches(t):
    question = F.coalesce(last_of(F.col("messages"), "user"), F.lit(""))
    cost = F.greatest(F.lit(1), F.floor(F.length(question) / 4)) + 256 * F.coalesce(F.array_size("images"), F.lit(0)) + 512
    return K.cost_balanced_batches(t(SFT).select("record_id", cost.cast("long").alias("cost")), "cost", "record_id", 8).select("record_id", "cost", "batch", "worker")


# -- filters and projections -------------------------------------------------
@query("select record_id, list_filter([case when messages is null or len(messages) = 0 then 'no_messages' end, case when not list_contains(list_transform(messages, lambda x: x.role), 'assistant') then 'no_assistant' end, case when len(list_filter(messages, lambda x: x.content is null or trim(x.content, ' ') = '')) > 0 then 'empty_content' end, case when task is null or trim(task) = '' then 'empty_task' end, case when source is null or trim(source) = '' then 'empty_source' end], lambda x: x is not null) as errors from sft_records")
def flt1_row_errors(t):
    m = F.col("messages")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    rules = {
        "no_messages": m.isNull() | (F.size(m) == 0),
        "no_assistant": ~F.exists(m, lambda x: x["role"] == "assistant"),
        "empty_content": F.exists(m, lambda x: blank(x["content"])),
        "empty_task": blank(F.col("task")),
        "empty_source": blank(F.col("source")),
    }
    return J.rejected(t(SFT), rules).select("record_id", "errors")


@query("select route, count(*) as refs from (select case when img is null or trim(img) = '' then 'empty' when img like 'http%' then 'remote' when img like 'data:%' then 'embedded' when img like '/%' then 'absolute' else 'relative' end as route from (select unnest(images) as img from sft_records)) group by route")
def flt2_image_routes(t):
    i = F.col("img")
    route = F.when(i.isNull() | (F.trim(i) == ""), "empty").when(i.startswith("http"), "remote").when(i.startswith("data:"), "embedded").when(i.startswith("/"), "absolute").otherwise("relative")
    return t(SFT).select(F.explode("images").alias("img")).groupBy(route.alias("route")).agg(F.count("*").alias("refs"))


CANDIDATE = "source_mode = 'text' and coalesce(value_text, '') <> ''"


@query(f"select fact_id, score, case when score >= 0.9 then 'trusted' when score >= 0.75 then 'recheck' else 'quarantine' end as route from (select fact_id, round(least(1e0, case when {CANDIDATE} then 0.35e0 else 0.1e0 end + case when coalesce(numeric_value, '') <> '' then 0.25e0 else 0.1e0 end + case when coalesce(period, '') <> '' then 0.15e0 else 0e0 end + case when coalesce(metric, '') <> '' then 0.1e0 else 0e0 end + case when source_mode = 'image' and coalesce(len(images), 0) > 0 then 0.1e0 else 0e0 end + case when coalesce(scope, '') <> '' then 0.05e0 else 0e0 end), 3) as score from evidence_facts)")
def flt15_confidence_route(t):
    """A text fact whose value stands in the text counts as found by rule."""
    x = t(FACTS).withColumn("candidate", F.coalesce(F.expr(CANDIDATE), F.lit(False)))
    return x.select("fact_id", *A.confidence_route(F.col("candidate")))


@query(f"select record_id, case when not list_contains(list_transform(messages, lambda x: x.role), 'assistant') then 'missing_assistant' when trim(coalesce(list_filter(messages, lambda x: x.role = 'assistant')[-1].content, ''), ' ') = '' then 'empty_supervision' when {TASK} is null then 'empty_task' end as reason, {TASK} as task from sft_records")
def prj3_reject_reason(t):
    a = last_of(F.col("messages"), "assistant")
    has = F.exists("messages", lambda x: x["role"] == "assistant")
    reason = F.when(~has, "missing_assistant").when(F.trim(F.coalesce(a, F.lit(""))) == "", "empty_supervision").when(task_name().isNull(), "empty_task")
    return t(SFT).select("record_id", reason.alias("reason"), task_name().alias("task"))


@query("select record_id, greatest(1, len(array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: coalesce(x.content, '')), chr(10))) / 4.0) + 256.0 * coalesce(len(images), 0) + 2048 / 512.0 as cost from sft_records")
def prj10_cost_model(t):
    images = F.when(F.col("images").isNull(), 0).otherwise(F.size("images"))
    return t(SFT).select("record_id", (F.greatest(F.lit(1.0), F.length(role_text(F.col("messages"), "user")) / 4.0) + 256.0 * images + 2048 / 512.0).alias("cost"))


@query("select bundle_id, list_sort(list_distinct(page_numbers)) as pages, json_extract_string(source_metadata, '$.period') as period from document_bundles")
def prj23_bundle_row(t):
    return t(BUNDLES).select("bundle_id", F.array_sort(F.array_distinct("page_numbers")).alias("pages"), F.get_json_object("source_metadata", "$.period").alias("period"))


# -- scalar functions --------------------------------------------------------
LAST = "coalesce(list_filter(messages, lambda x: x.role = 'assistant')[-1].content, '')"


@query(rf"select record_id, len(list_distinct(list_transform(regexp_extract_all({LAST}, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')))) as atoms, list_transform(regexp_extract_all({LAST}, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', ''))[-1] as gold from sft_records")
def str5_number_atoms(t):
    a = F.coalesce(last_of(F.col("messages"), "assistant"), F.lit(""))
    every = F.transform(F.regexp_extract_all(a, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return t(SFT).select("record_id", F.size(numbers(a)).cast("long").alias("atoms"), F.try_element_at(every, F.lit(-1)).alias("gold"))


@query(rf"select record_id, nullif(regexp_extract({LAST}, '^(?:The answer is |Answer: |Antwort: |答案：|选)?([A-D])(?:$|[.)])', 1), '') as choice from sft_records")
def str21_choice(t):
    return t(SFT).select("record_id", choice(F.coalesce(last_of(F.col("messages"), "assistant"), F.lit(""))).alias("choice"))


@query(r"select doc_id, len(regexp_extract_all(text, '[一-鿿]')) as wide, len(regexp_extract_all(text, '[A-Za-z]+')) as words, len(text) as chars, len(regexp_extract_all(text, '[一-鿿]')) + ceil(len(regexp_replace(text, '[一-鿿]', '', 'g')) / 4.0)::bigint as estimate from documents")
def str20_token_estimate(t):
    wide = F.regexp_count("text", F.lit("[一-鿿]"))
    return t(DOCS).select("doc_id", wide.cast("long").alias("wide"), F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), (wide + F.ceil((F.length("text") - wide) / 4.0)).cast("long").alias("estimate"))


@query("select fact_id, substr(sha256(concat_ws(chr(0), document_id, page, entity, metric, period)), 1, 16) as stable_id from evidence_facts")
def str33_stable_id(t):
    return t(FACTS).select("fact_id", F.substring(F.sha2(F.concat_ws("\x00", "document_id", "page", "entity", "metric", "period"), 256), 1, 16).alias("stable_id"))


@query("select candidate_id, case when choices is not null and len(choices) > 0 then array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr(64 + i::int) || '. ' || choices[i]), ' || ') end as rendered from bench_candidates")
def str31_rendered_choices(t):
    lines = F.transform("choices", lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c))
    return t(BENCH).select("candidate_id", F.when(F.size("choices") > 0, F.array_join(lines, " || ")).alias("rendered"))


@query("select fact_id, sum(len(coalesce(claim, metric, ''))) over (partition by document_id order by fact_id) as upto, sum(len(coalesce(claim, metric, ''))) over (partition by document_id order by fact_id) <= 100 as kept from evidence_facts")
def str35_budgeted_context(t):
    w = Window.partitionBy("document_id").orderBy("fact_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = t(FACTS).select("fact_id", "document_id", F.length(F.coalesce("claim", "metric", F.lit(""))).alias("n"))
    return x.select("fact_id", F.sum("n").over(w).alias("upto"), (F.sum("n").over(w) <= 100).alias("kept"))


# -- set operations and routing ----------------------------------------------
@query("select id, 'sft' as origin from (select record_id as id from sft_records) union all select row_id, 'train' from train_multi_sft_minhash_dedup")
def set1_ordered_union(t):
    return t(SFT).select(F.col("record_id").alias("id"), F.lit("sft").alias("origin")).unionByName(t(TRAIN).select(F.col("row_id").alias("id"), F.lit("train").alias("origin")))


@query("select a.doc_id as first, b.doc_id as second from (select doc_id, row_number() over (order by sha256('3' || chr(0) || 'en' || chr(0) || doc_id), doc_id) as r from documents where lang = 'en') a join (select doc_id, row_number() over (order by sha256('3' || chr(0) || 'zh' || chr(0) || doc_id), doc_id) as r from documents where lang = 'zh') b using (r)")
def set4_balanced_pairs(t):
    def dealt(lang: str, name: str) -> DataFrame:
        """Ranks without one global sort: rows are ranked in ranges of their key, offsets come from the ranges' counts."""
        x = t(DOCS).where(F.col("lang") == lang).select(F.col("doc_id").alias(name), rank_key(3, lang, F.col("doc_id")).alias("draw")).withColumn("part", F.substring("draw", 1, 2))
        parts = x.groupBy("part").agg(F.count("*").alias("n"))
        before = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("before"))
        return x.join(F.broadcast(before), "part").select(name, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("draw", name))).alias("r"))

    return dealt("en", "first").join(dealt("zh", "second"), "r").select("first", "second")


@query("select case when choices is not null then 'choice' when regexp_matches(answer, '^[-−]?[$€£¥]?[0-9.,]+%?$') then 'number' when length(answer) < 20 then 'short' else 'judge' end as route, count(*) as items from bench_candidates group by 1")
def set9_verifier_route(t):
    route = F.when(F.col("choices").isNotNull(), "choice").when(F.col("answer").rlike(r"^[-−]?[$€£¥]?[0-9.,]+%?$"), "number").when(F.length("answer") < 20, "short").otherwise("judge")
    return t(BENCH).groupBy(route.alias("route")).agg(F.count("*").alias("items"))


# -- relational baseline on the star schema ----------------------------------
@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def rel_pricing_summary(t):
    x = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def rel_orders_by_nation(t):
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
