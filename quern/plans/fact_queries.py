"""Queries over facts, rollouts and series: graph edges, group rewards, pass rates, difficulty, growth, ranking.

Rollouts are the events of a user in order, eight to a group; a rollout's
quality is its value over 100, at most 1, and it is accepted from 0.5 on. A
supplier's shipped quantity and revenue per year are the metrics of a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import verify
from quern.functions.text import rank_key
from quern.operators import relational
from quern.operators import reports as A
from quern.plans.core_queries import EDGES_SQL
from quern.plans.record_queries import bigrams
from quern.plans.registry import Registry

R = Registry()
query = R.query
FACTS = "evidence_facts"
ROLLOUTS = "(select user_id * 1000000 + (r - 1) // 8 as grp, user_id, event_id, r, event_type, least(1.0, value / 100) as q, least(1.0, value / 100) >= 0.5 as ok from (select *, row_number() over (partition by user_id order by event_id) as r from events))"


def rollouts(t) -> DataFrame:
    x = t("events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    q = F.least(F.lit(1.0), F.col("value") / 100)
    return x.select((F.col("user_id") * 1000000 + F.floor((F.col("r") - 1) / 8)).alias("grp"), "user_id", "event_id", "r", "event_type", q.alias("q"), (q >= 0.5).alias("ok"))


# -- graph ----------------------------------------------------------------------
FORMULAS = {"net_margin": ["net_profit", "revenue"], "cash_conversion": ["operating_cash_flow", "net_profit", "revenue"], "investment_rate": ["capital_expenditure", "revenue"]}
_KINDS = {"same_company_metric": "entity || '|' || metric", "same_company_period": "entity || '|' || period", "same_metric_period": "metric || '|' || period", "same_source": "source_ref"}
_PLAIN = "(select fact_id, " + ", ".join(f"coalesce({c}, '') as {c}" for c in ("entity", "metric", "period", "scope", "unit", "source_ref")) + " from evidence_facts)"
_FORMULA_SQL = " union all ".join(f"select b.m['{x}'] as a, b.m['{y}'] as b, 'financial_formula:{k}' as type from b where " + " and ".join(f"b.m['{n}'] is not null" for n in ms) for k, ms in FORMULAS.items() for x, y in zip(ms, ms[1:]))


@query(
    f"with f as {_PLAIN}, l as (" + " union all ".join(f"select '{k}' as type, {e} as key, fact_id from f" for k, e in _KINDS.items()) + "), "
    "b as (select map(list(metric), list(id)) as m from (select entity, period, scope, unit, metric, max(fact_id) as id from f where metric <> '' group by all) group by entity, period, scope, unit) "
    "select a, b, type from (select fact_id as a, lead(fact_id) over (partition by type, key order by fact_id) as b, type from l where trim(key, '|') <> '') where b is not null union " + _FORMULA_SQL
)
def jon6_graph_edges(t):
    """Edges between successive facts of four groupings, and between the metrics of a formula within entity, period, scope and unit."""
    f = t(FACTS).select("fact_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("entity", "metric", "period", "scope", "unit", "source_ref")])
    two = lambda a, b: F.concat_ws("|", a, b)
    kinds = {"same_company_metric": two("entity", "metric"), "same_company_period": two("entity", "period"), "same_metric_period": two("metric", "period"), "same_source": F.col("source_ref")}
    lanes = f.select("fact_id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), e.alias("key")) for k, e in kinds.items()])).alias("l")).select("fact_id", "l.*").where(F.regexp_replace("key", r"^\|+|\|+$", "") != "")
    near = lanes.select(F.col("fact_id").alias("a"), F.lead("fact_id").over(Window.partitionBy("type", "key").orderBy("fact_id")).alias("b"), "type").where("b is not null")
    last = f.where("metric <> ''").groupBy("entity", "period", "scope", "unit", "metric").agg(F.max("fact_id").alias("id"))
    by = last.groupBy("entity", "period", "scope", "unit").agg(F.map_from_entries(F.collect_list(F.struct("metric", "id"))).alias("m"))
    out = near
    for k, metrics in FORMULAS.items():
        held = by.where(" and ".join(f"m['{n}'] is not null" for n in metrics))
        for a, b in zip(metrics, metrics[1:]):
            out = out.union(held.select(F.expr(f"m['{a}']"), F.expr(f"m['{b}']"), F.lit(f"financial_formula:{k}")))
    return out.distinct()


@query(
    f"with e as ({EDGES_SQL}), r as (select document_id, count(*) as n, count(distinct nullif(period, '')) as periods, count(distinct nullif(entity, '')) as entities, count(distinct nullif(page, '')) as pages, count(*) filter (where source_mode = 'image') as visuals, count(distinct coalesce(source_mode, '')) as modes from evidence_facts where coalesce(document_id, '') <> '' group by 1), "
    "k as (select x.document_id, count(distinct edge_type) as types from e join evidence_facts x on e.a = x.fact_id join evidence_facts y on e.b = y.fact_id where x.document_id = y.document_id group by 1) "
    "select document_id, score, case when score >= 8.5 then 'hard' when score >= 5.5 then 'medium' else 'easy' end as label from (select document_id, round(n * 0.8e0 + 0.8e0 + greatest(0, periods - 1) * 0.8e0 + greatest(0, entities - 1) * 0.8e0 + visuals * 0.4e0 + case when modes > 1 then 1.5e0 else 0e0 end + coalesce(types, 0) * 0.25e0, 2) as score from r left join k using (document_id))"
)
def agg21_difficulty(t):
    """The difficulty of a document's facts as one bundle, with the kinds of edges between them."""
    f = t(FACTS).where("coalesce(document_id, '') <> ''")
    r = A.bundle_counts(f, "document_id")
    e = relational.evidence_edges(t(FACTS))
    d = t(FACTS).select("fact_id", "document_id")
    e = e.join(d.withColumnRenamed("fact_id", "a"), "a").join(d.toDF("b", "other"), "b").where("document_id = other")
    types = e.groupBy("document_id").agg(F.count_distinct("edge_type").alias("types"))
    x = r.join(types, "document_id", "left")
    return x.select("document_id", *A.difficulty(F.col("required"), F.lit(0), F.lit(1), F.col("periods"), F.col("entities"), F.col("visuals"), F.col("modes"), F.coalesce("types", F.lit(0))))


@query(
    "select document_id, score, flips, case when score >= 10 then 'hard' when score >= 6 then 'medium' else 'easy' end as label from (select document_id, flips, n - 1 + 2 + greatest(0, periods - 1) * 0.75e0 + greatest(0, scopes - 1) * 0.75e0 + flips as score from (select document_id, count(*) as n, count(distinct nullif(period, '')) as periods, count(distinct nullif(scope, '')) as scopes, count(*) filter (where seen <> before) as flips from (select document_id, period, scope, coalesce(len(images), 0) > 0 as seen, lag(coalesce(len(images), 0) > 0) over (partition by document_id order by fact_id) as before from evidence_facts where document_id is not null) group by 1))"
)
def agg22_hop_difficulty(t):
    """Hops, operators (2), distinct periods and scopes, and changes between facts with and without a picture."""
    seen = F.coalesce(F.size("images"), F.lit(0)) > 0
    x = t(FACTS).where("document_id is not null").withColumn("seen", seen)
    x = x.withColumn("before", F.lag("seen").over(Window.partitionBy("document_id").orderBy("fact_id")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    g = x.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct(blank("period")).alias("p"), F.count_distinct(blank("scope")).alias("s"), F.count_if(F.col("seen") != F.col("before")).alias("flips"))
    more = lambda c: F.greatest(F.lit(0), F.col(c) - 1) * 0.75
    score = F.col("n") - 1 + 2 + more("p") + more("s") + F.col("flips")
    return g.select("document_id", score.alias("score"), "flips", F.when(score >= 10, "hard").when(score >= 6, "medium").otherwise("easy").alias("label"))


@query("select document_id, a, b, round(score, 6) as score from (select *, row_number() over (order by score desc, a) as place from (select *, case when u = 0 then 0 else i / u end + 0.01 * assets as score from (select document_id, a, b, assets, len(list_intersect(x, y)) as i, len(list_distinct(list_concat(x, y))) as u from (select document_id, fact_id as a, lead(fact_id) over w as b, g as x, lead(g) over w as y, n + lead(n) over w as assets from (select document_id, page, fact_id, coalesce(len(images), 0) as n, list_distinct(list_transform(range(1, greatest(len(s), 1)), lambda i: substr(s, i::int, 2))) as g from (select *, regexp_replace(coalesce(claim, ''), '[^一-鿿A-Za-z0-9%]', '', 'g') as s from evidence_facts)) window w as (partition by document_id order by page, fact_id)) where b is not null))) where place <= 50")
def win19_neighbours_by_bigrams(t):
    """The 50 pairs of neighbouring facts of a document that share most character pairs, a picture adding 0.01."""
    x = t(FACTS).select("document_id", "page", "fact_id", F.coalesce(F.size("images"), F.lit(0)).alias("n"), bigrams(F.col("claim")).alias("g"))
    w = Window.partitionBy("document_id").orderBy("page", "fact_id")
    x = x.select("document_id", F.col("fact_id").alias("a"), F.lead("fact_id").over(w).alias("b"), F.col("g").alias("x"), F.lead("g").over(w).alias("y"), (F.col("n") + F.lead("n").over(w)).alias("assets")).where("b is not null")
    u = F.size(F.array_union("x", "y"))
    score = F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / u) + 0.01 * F.col("assets")
    return x.withColumn("score", score).orderBy(F.desc("score"), "a").limit(50).select("document_id", "a", "b", F.round("score", 6).alias("score"))


@query("select document_id, fact_id from (select document_id, fact_id, row_number() over (partition by document_id order by d) as place from (select document_id, fact_id, sha256('6' || chr(0) || 'bundle' || chr(0) || fact_id) as d, row_number() over (partition by document_id, metric order by sha256('6' || chr(0) || 'bundle' || chr(0) || fact_id)) as r from evidence_facts where coalesce(document_id, '') <> '' and coalesce(metric, '') <> '') where r = 1) where place <= 4")
def win27_diverse_bundle(t):
    """Up to 4 facts of a document, all of different metrics, by a seeded order."""
    x = t(FACTS).where("coalesce(document_id, '') <> '' and coalesce(metric, '') <> ''").select("document_id", "metric", "fact_id", rank_key(6, "bundle", F.col("fact_id")).alias("d"))
    x = x.groupBy("document_id", "metric").agg(F.min(F.struct("d", "fact_id")).alias("x"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("x.d"))).where("place <= 4").select("document_id", "x.fact_id")


@query("with f as (select unit_id, fact_id, numeric_value from evidence_facts where coalesce(numeric_value, '') <> '' and coalesce(unit_id, '') <> ''), g as (select unit_id, min(fact_id) as a, min_by(numeric_value, fact_id) as x from f group by 1) select f.unit_id, a, min(fact_id) as b from f join g using (unit_id) where numeric_value <> x group by all")
def udf7_negatives(t):
    """Per unit its first fact and the first of another value: a rule-made contradiction."""
    f = t(FACTS).where("coalesce(numeric_value, '') <> '' and coalesce(unit_id, '') <> ''").select("unit_id", "fact_id", "numeric_value")
    g = f.groupBy("unit_id").agg(F.min(F.struct("fact_id", "numeric_value")).alias("g"))
    x = f.join(g, "unit_id").where("numeric_value <> g.numeric_value")
    return x.groupBy("unit_id").agg(F.first("g.fact_id").alias("a"), F.min("fact_id").alias("b"))


# -- group rewards and pass rates --------------------------------------------------
@query(
    f"with r as {ROLLOUTS}, g as (select grp, count(*) as n, count(*) filter (where ok) as k from r group by 1) "
    "select event_id, round(case when n = 8 and k = 0 then 0 when n = 8 and k = 8 then 1 else (8 * ok::int + 0.5 * (2 * q - 1 + 1)) / 9 end, 6) as reward, case when n = 8 and k = 0 then 'all_rejected_zero' when n = 8 and k = 8 then 'all_accepted_one' when n = 8 then 'mixed_quality_fallback' else 'incomplete_group_quality_fallback' end as policy from r join g using (grp)"
)
def agg18_group_policy(t):
    return A.group_policy(rollouts(t), "grp", F.col("ok"), F.col("q"), 8).select("event_id", F.round("reward", 6).alias("reward"), "policy")


@query(f"with r as {ROLLOUTS}, c as (select grp, event_type, count(*) as n, avg(ok::int) as p from r group by 1, 2), s as (select grp, event_id, event_type, q, 4 * p * (1 - p) as learnability, var_pop(q) over (partition by grp, event_type) as v, avg(q) over (partition by grp, event_type) as m from r join c using (grp, event_type)) select event_id, round(learnability, 6) as learnability, round(case when v > 1e-12 then (q - m) / sqrt(v) else 0 end, 6) as z from s")
def agg17_criterion_signal(t):
    """Per group and criterion: pass rate p, learnability 4p(1 - p) and the rollout's quality in deviations from the mean."""
    r = rollouts(t)
    c = r.groupBy("grp", "event_type").agg(F.avg(F.col("ok").cast("int")).alias("p"), F.var_pop("q").alias("v"), F.avg("q").alias("m"))
    z = F.when(F.col("v") > 1e-12, (F.col("q") - F.col("m")) / F.sqrt("v")).otherwise(0.0)
    return r.join(c, ["grp", "event_type"]).select("event_id", F.round(4 * F.col("p") * (1 - F.col("p")), 6).alias("learnability"), F.round(z, 6).alias("z"))


@query(f"with r as {ROLLOUTS}, b as (select grp, ok, count(*) as n, avg(q) as m, stddev_pop(q) as s from r group by 1, 2) select event_id, round(case when n > 1 and s > 1e-9 then (q - m) / s else 0 end, 6) as signal from r join b using (grp, ok)")
def agg19_bucket_signal(t):
    """The same inside buckets of a group and outcome, 0 in buckets of one."""
    r = rollouts(t)
    b = r.groupBy("grp", "ok").agg(F.count("*").alias("n"), F.avg("q").alias("m"), F.stddev_pop("q").alias("s"))
    return r.join(b, ["grp", "ok"]).select("event_id", F.round(F.when((F.col("n") > 1) & (F.col("s") > 1e-9), (F.col("q") - F.col("m")) / F.col("s")).otherwise(0.0), 6).alias("signal"))


@query(f"with r as {ROLLOUTS}, d as (select user_id, event_type, sum((1 + r % 3) * q) / sum(1 + r % 3) as mean, bool_or(q < 0.001) as hard_fail from r group by 1, 2) select user_id, round(sum(length(event_type) * mean) / sum(length(event_type)), 6) as quality, bool_or(hard_fail) as hard_fail, not bool_or(hard_fail) and sum(length(event_type) * mean) / sum(length(event_type)) >= 0.4 as accepted from d group by 1")
def agg20_rubric_score(t):
    """Points weighted by importance within a dimension, dimensions weighted among each other, a hard fail and a threshold."""
    r = rollouts(t)
    w = 1 + F.col("r") % 3
    d = r.groupBy("user_id", "event_type").agg((F.sum(w * F.col("q")) / F.sum(w)).alias("mean"), F.bool_or(F.col("q") < 0.001).alias("hard"))
    n = F.length("event_type")
    g = d.groupBy("user_id").agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("x"), F.bool_or("hard").alias("hard_fail"))
    return g.select("user_id", F.round("x", 6).alias("quality"), "hard_fail", (~F.col("hard_fail") & (F.col("x") >= 0.4)).alias("accepted"))


PER_GROUP = f"(select grp, user_id, count(*) as n, count(*) filter (where ok) as k, min(r) filter (where ok) - min(r) + 1 as first_ok, avg(q) as mean, bool_or(ok and (r - 1) % 8 = 0) as first_passes from {ROLLOUTS} group by 1, 2)"


def per_group(t) -> DataFrame:
    ok, r = F.col("ok"), F.col("r")
    return rollouts(t).groupBy("grp", "user_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("k"), (F.min(F.when(ok, r)) - F.min("r") + 1).alias("first_ok"), F.avg("q").alias("mean"), F.bool_or(ok & ((r - 1) % 8 == 0)).alias("first_passes"))


@query(f"select round(avg(first_passes::int), 6) as pass_1, round(avg((k > 0)::int), 6) as pass_8, round(count(*) filter (where n = 8) / count(*), 6) as completed, round(avg(k / 8.0), 6) as mean_correct from {PER_GROUP}")
def agg4_pass_rates(t):
    g = per_group(t)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return g.agg(share(F.col("first_passes")).alias("pass_1"), share(F.col("k") > 0).alias("pass_8"), share(F.col("n") == 8).alias("completed"), F.round(F.avg(F.col("k") / 8.0), 6).alias("mean_correct"))


@query(f"select user_id, round(avg(k / 8.0), 6) as mean_correct from {PER_GROUP} where n = 8 group by 1")
def agg5_mean_correct(t):
    return per_group(t).where("n = 8").groupBy("user_id").agg(F.round(F.avg(F.col("k") / 8.0), 6).alias("mean_correct"))


@query(f"select case when k = 0 then 'hard' when k <= 3 then 'medium' else 'easy' end as difficulty, count(*) as groups, round(avg(k), 6) as mean from {PER_GROUP} where n = 8 group by 1")
def agg6_difficulty_buckets(t):
    bucket = F.when(F.col("k") == 0, "hard").when(F.col("k") <= 3, "medium").otherwise("easy")
    return per_group(t).where("n = 8").groupBy(bucket.alias("difficulty")).agg(F.count("*").alias("groups"), F.round(F.avg("k"), 6).alias("mean"))


@query(f"select grp, n, k, first_ok from {PER_GROUP}")
def agg26_first_correct(t):
    return per_group(t).select("grp", "n", "k", "first_ok")


@query(f"select grp, k, k > 0 as passes, round(k / n, 6) as rate, round(mean, 8) as mean from {PER_GROUP}")
def agg27_group_success(t):
    return per_group(t).select("grp", "k", (F.col("k") > 0).alias("passes"), F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round("mean", 8).alias("mean"))


@query(f"select event_id, grp, event_type from (select *, row_number() over (order by place, event_type) as o from (select *, row_number() over (partition by event_type order by q desc, event_id) as place from (select grp, max_by(event_id, struct_pack(q := q, e := event_id)) as event_id, max_by(event_type, struct_pack(q := q, e := event_id)) as event_type, max(q) as q from {ROLLOUTS} group by grp))) where o <= 200")
def win7_best_then_round_robin(t):
    """The best rollout of each group, then 200 of them in turns over their types, best first."""
    best = rollouts(t).groupBy("grp").agg(F.max(F.struct("q", "event_id", "event_type")).alias("b")).select("grp", "b.*")
    w = Window.partitionBy("event_type").orderBy(F.desc("q"), "event_id")
    x = best.withColumn("place", F.row_number().over(w)).where("place <= 200")
    return x.orderBy("place", "event_type").limit(200).select("event_id", "grp", "event_type")


# -- distributions ----------------------------------------------------------------
LANGS = "select coalesce(doc_type, 'unknown') as kind, count(*) as samples, sum(ceil(len(text) / 4.0))::bigint as tokens from documents group by 1"


@query(f"select kind, samples, tokens, round(samples / sum(samples) over (), 6) as sample_share, round(tokens / sum(tokens) over (), 6) as token_share from ({LANGS})")
def agg8_distribution(t):
    x = t("documents").groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("samples"), F.sum(F.ceil(F.length("text") / 4.0)).cast("long").alias("tokens"))
    total = x.agg(F.sum("samples").alias("s"), F.sum("tokens").alias("k"))
    return x.join(F.broadcast(total)).select("kind", "samples", "tokens", F.round(F.col("samples") / F.col("s"), 6).alias("sample_share"), F.round(F.col("tokens") / F.col("k"), 6).alias("token_share"))


@query("select dataset, fact_type, confidence, count(*) as facts, count(distinct entity) as entities from evidence_facts group by all")
def agg11_fact_counters(t):
    return t(FACTS).groupBy("dataset", "fact_type", "confidence").agg(F.count("*").alias("facts"), F.count_distinct("entity").alias("entities"))


@query("select benchmark, count(*) as candidates, least(count(*), 100) as selected, greatest(0, 100 - count(*)) as shortfall, max(h) as tasks from bench_candidates join (select benchmark, string_agg(coalesce(task, '') || ':' || n, ',' order by coalesce(task, '')) as h from (select benchmark, task, count(*) as n from bench_candidates group by all) group by 1) using (benchmark) group by 1")
def agg12_summary(t):
    b = t("bench_candidates")
    h = b.groupBy("benchmark", F.coalesce("task", F.lit("")).alias("task")).count().groupBy("benchmark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "count"))), lambda x: F.concat(x["task"], F.lit(":"), x["count"].cast("string"))), ",").alias("tasks"))
    n = F.count("*")
    return b.groupBy("benchmark").agg(n.alias("candidates"), F.least(n, F.lit(100)).alias("selected"), F.greatest(F.lit(0), 100 - n).alias("shortfall")).join(h, "benchmark")


@query("select round(avg((len(regexp_extract_all(coalesce(list_filter(messages, lambda x: x.role = 'assistant')[-1].content, ''), '[一-鿿]|[A-Za-z0-9]+')) < 16)::int), 6) as share, count(*) as rows from sft_records")
def agg25_short_answers(t):
    from quern.plans.record_queries import answer

    short = F.regexp_count(answer(), F.lit("[一-鿿]|[A-Za-z0-9]+")) < 16
    return t("sft_records").agg(F.round(F.avg(short.cast("double")), 6).alias("share"), F.count("*").alias("rows"))


# -- series -----------------------------------------------------------------------
SERIES = "(select l_suppkey as s, year(l_shipdate) as y, round(sum(l_extendedprice), 2) as v, sum(l_quantity) as n from lineitem group by all)"


def series(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_suppkey").alias("s"), F.year("l_shipdate").cast("long").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"), F.sum("l_quantity").alias("n"))


def by_year():
    return Window.partitionBy("s").orderBy("y")


@query(f"select s, y, round(((v - b) / b - (b - a) / a) * 100, 4) as change from (select s, y, v, lag(v, 2) over w as a, lag(v) over w as b from {SERIES} window w as (partition by s order by y)) where a <> 0 and b <> 0")
def win22_growth_acceleration(t):
    """Three successive periods: the later growth in percent less the earlier one."""
    x = series(t).select("s", "y", "v", F.lag("v", 2).over(by_year()).alias("a"), F.lag("v").over(by_year()).alias("b")).where("a <> 0 and b <> 0")
    v, a, b = (F.col(c) for c in "vab")
    return x.select("s", "y", F.round(((v - b) / b - (b - a) / a) * 100, 4).alias("change"))


@query(f"select s, y, round(v / n - lag(v / n) over (partition by s order by y), 4) as change from {SERIES} where n <> 0 qualify change is not null")
def win23_ratio_change(t):
    """Two metrics over two periods: the later ratio less the earlier one."""
    ratio = F.col("v") / F.col("n")
    return series(t).where("n <> 0").select("s", "y", F.round(ratio - F.lag(ratio).over(by_year()), 4).alias("change")).where("change is not null")


@query(f"with g as (select s, y, (v / b - 1) * 100 as g from (select s, y, v, lag(v) over (partition by s order by y) as b from {SERIES}) where b <> 0) select x.s as a, z.s as b, x.y, round(x.g - z.g, 4) as gap from g x join g z on z.s = x.s + 1 and z.y = x.y")
def win24_peer_growth_gap(t):
    """Growth in percent of an entity less that of its neighbour over the same two periods."""
    g = series(t).select("s", "y", "v", F.lag("v").over(by_year()).alias("p")).where("p <> 0").select("s", "y", ((F.col("v") / F.col("p") - 1) * 100).alias("g"))
    z = g.select((F.col("s") - 1).alias("s"), "y", F.col("s").alias("b"), F.col("g").alias("h"))
    return g.join(z, ["s", "y"]).select(F.col("s").alias("a"), "b", "y", F.round(F.col("g") - F.col("h"), 4).alias("gap"))


@query(f"select s, y, round(v - b, 2) as difference, round((v - b) / b * 100, 4) as percent from (select s, y, v, lag(v) over (partition by s order by y) as b from {SERIES}) where b <> 0")
def win25_period_change(t):
    x = series(t).select("s", "y", "v", F.lag("v").over(by_year()).alias("b")).where("b <> 0")
    return x.select("s", "y", F.round(F.col("v") - F.col("b"), 2).alias("difference"), F.round((F.col("v") - F.col("b")) / F.col("b") * 100, 4).alias("percent"))


@query(f"select grp, y, chr(65 + max_by(s - grp * 4, v)::int) as letter from (select s // 4 as grp, s, y, v from {SERIES}) group by grp, y having count(*) >= 3 and count(distinct v) = count(*)")
def win26_ranking_letter(t):
    """The letter of the entity with the highest value among groups of up to four, all values different."""
    x = series(t).withColumn("grp", F.floor(F.col("s") / 4))
    g = x.groupBy("grp", "y").agg(F.max(F.struct("v", "s")).alias("m"), F.count("*").alias("n"), F.count_distinct("v").alias("d")).where("n >= 3 and d = n")
    return g.select("grp", "y", F.char(F.lit(65) + (F.col("m.s") - F.col("grp") * 4).cast("int")).alias("letter"))


@query(f"select s, y, printf('subtract(%.2f,%.2f),divide(#0,%.2f),multiply(#1,100)', v, b, b) as program, round((v - b) / b * 100, 6) as result from (select s, y, v, lag(v) over (partition by s order by y) as b from {SERIES}) where b <> 0")
def str11_programs(t):
    """Step programs of the growth of each series, run by the interpreter."""
    d = lambda c: F.col(c).cast("decimal(20,2)").cast("string")
    x = series(t).select("s", "y", "v", F.lag("v").over(by_year()).alias("b")).where("b <> 0")
    x = x.withColumn("program", F.concat(F.lit("subtract("), d("v"), F.lit(","), d("b"), F.lit("),divide(#0,"), d("b"), F.lit("),multiply(#1,100)")))
    x = x.withColumn("key", F.concat_ws(":", "s", "y"))
    done = verify.program_results(x, "key", "program")
    return x.join(done, "key").select("s", "y", "program", F.round(F.col("result").cast("double"), 6).alias("result"))
