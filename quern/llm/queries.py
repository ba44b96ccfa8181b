"""Queries of the training-data problems that are tagged llm, and their SQL where there is any.

The SQL of problems 1, 2 and 4 compares all pairs, which small tables bear. For
problems 3, 7 and 8, whose results are one of many right ones, it states what
must hold of any result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import edits, leakage, mixing, overlap, packing, pairs, sampling, spam


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per stratum: its rows, and whether the sample holds the rows wanted, to within one and a half, and no more than there are."""
    r = sampling.p3_strata(spark, d)
    held = (F.abs(F.col("sampled") - F.col("target_rows")) <= 1.5) & (F.col("sampled") <= F.col("available"))
    return r.select("plan_name", "task", "source", "available", held.alias("on_target"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per pack spec: texts packed, containers over capacity, texts cut though they fit, and whether over nine tenths of the space is used."""
    specs = spark.read.parquet(f"{d}/pack_specs.parquet")
    x = packing.p7_containers(spark, d).join(F.broadcast(specs), "pack_name")
    boxes = x.groupBy("pack_name", "container").agg(F.sum("tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    boxes = boxes.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("c")).alias("overfull"), (F.sum("n") > 0.9 * F.sum("c")).alias("well_used"))
    texts = x.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("parts"), F.first("capacity_tokens").alias("c"))
    texts = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.count_if((F.col("n") <= F.col("c")) & (F.col("parts") > 1)).alias("cut"))
    return boxes.join(texts, "pack_name").select("pack_name", "texts", "overfull", "cut", "well_used")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per source with texts: whether its share is within a hundredth of its target, and no text is used too often."""
    r = mixing.p8_shares(spark, d).where("tokens > 0")
    total = r.agg(F.sum("target_share").alias("t"))
    near = F.abs(F.col("actual_share") - F.col("target_share") / F.col("t")) <= 0.01
    return r.join(F.broadcast(total)).select("source", near.alias("on_target"), (F.col("most_copies") <= F.col("repeats")).alias("within_repeats"))


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (
        overlap.p1_found, overlap.p1_report, leakage.p2_found, leakage.p2_items, sampling.p3_sample, sampling.p3_strata, p3_invariants,
        edits.p4_found, edits.p4_groups, pairs.p5_found, pairs.p5_defects, packing.p7_containers, packing.p7_fill, p7_invariants,
        mixing.p8_mixture, mixing.p8_shares, p8_invariants, spam.p9_found, spam.p9_reasons,
    )}


PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
LABEL = r"nullif(regexp_replace(lower(trim({}, ' ')), '[\s\-]+', '_', 'g'), '')"
ROLE = "lower(trim(coalesce(m.role, ''), ' '))"
_SAID = f"array_to_string(list_transform(list_filter(messages, lambda m: {ROLE} <> 'system'), lambda m: coalesce(m.content, '')), '')"
_RECORDS = f"""t as (select record_id, coalesce(lower(trim(split, ' ')) in ('train', 'training'), false) as train, split, source,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(images, []), lambda p: p is not null), lambda p: regexp_extract(p, '([^/\\\\]*)$', 1)))), chr(31)) as pics,
  {PLAIN.format(_SAID)} as x from sft_records where record_id is not null),
 g as (select record_id, train, pics, unnest(list_distinct(list_transform(range(1, len(x) - 3), lambda i: x[i:i + 4]))) as s from t where len(x) >= 5),
 n as (select record_id, count(*) as n from g group by 1)"""
_SIMILAR = "from c join n p on p.record_id = c.a join n q on q.record_id = c.b where k >= 0.7 * (p.n + q.n - k) - 1e-9"
_P1 = f"{_RECORDS}, c as (select x.record_id as a, y.record_id as b, count(*) as k from g x join g y using (s) where not x.train and y.train group by 1, 2), f as (select a, b {_SIMILAR})"
_P4 = f"{_RECORDS}, c as (select x.record_id as a, y.record_id as b, count(*) as k from g x join g y using (pics, s) where x.record_id < y.record_id group by 1, 2), f as (select a, b {_SIMILAR})"
_TEXT = """case when starts_with(ltrim(m.content), '[') and json_valid(m.content) then array_to_string(list_transform(from_json(m.content, '[{"type":"VARCHAR","text":"VARCHAR"}]'), lambda p: coalesce(p.text, '')), '') else coalesce(m.content, '') end"""
_P2 = f"""i as (select candidate_id, x, case when 2 * len(regexp_extract_all(x, '[㐀-鿿]')) > len(x) then 20 else 60 end as k from (select candidate_id, {PLAIN.format("question")} as x from bench_candidates where candidate_id is not null and question is not null)),
 ir as (select candidate_id, k, p, x[p:p + k - 1] as s from (select candidate_id, x, k, unnest(range(1, len(x) - k + 2)) as p from i)),
 r as (select row_id, array_to_string(list_transform(list_filter(messages, lambda m: {ROLE} in ('user', 'assistant')), lambda m: {PLAIN.format(_TEXT)}), ' ') as x from train_multi_sft_minhash_dedup where row_id is not null),
 rr as (select distinct row_id, k, x[p:p + k - 1] as s from (select row_id, x, k, unnest(range(1, len(x) - k + 2)) as p from r, (select unnest([20, 60]) as k))),
 h as (select distinct row_id, candidate_id, k, p from ir join rr using (k, s)),
 v as (select row_id, candidate_id, count(distinct spot) as n from (select row_id, candidate_id, unnest(range(p, p + k)) as spot from h) group by 1, 2),
 f as (select row_id, candidate_id, n / len(x) as share from v join i using (candidate_id) where n >= 0.5 * len(x) - 1e-9)"""


def oracle_sql() -> dict[str, str]:
    label, stratum = LABEL.format, "(t.{0} is null or t.{0} = r.{0})"
    return {
        "p1_found": f"with {_P1} select least(a, b) as record_id_a, greatest(a, b) as record_id_b from f",
        "p1_report": f"with {_P1}, l as (select a, count(*) as links from f group by 1) select {label('split')} as split, {label('source')} as source, count(*) as records, count(links) as overlapping, coalesce(sum(links), 0)::bigint as pairs from t left join l on t.record_id = l.a where not train group by 1, 2",
        "p2_found": f"with {_P2} select row_id, candidate_id from f",
        "p2_items": f"with {_P2} select candidate_id, count(*) as rows, max(share) as largest_share from f group by 1",
        "p3_invariants": f"""with t as (select plan_name, {label('task')} as task, {label('source')} as source from sample_targets where plan_name is not null and target_share is not null),
            r as (select {label('task')} as task, {label('source')} as source from sft_records where record_id is not null)
            select plan_name, task, source, (select count(*) from r where {stratum.format('task')} and {stratum.format('source')}) as available, true as on_target from t where task is not null or source is not null""",
        "p4_found": f"with {_P4} select a as record_id_a, b as record_id_b from f",
        "p4_groups": f"with {_P4}, e as (select a, b from f union all select b, a from f) select a as record_id, least(a, min(b)) as group_id from e group by a",
        "p7_invariants": "select pack_name, (select count(distinct doc_id) from documents where text <> '') as texts, 0 as overfull, 0 as cut, true as well_used from pack_specs where pack_name is not null and capacity_tokens > 0",
        "p8_invariants": f"select distinct {label('m.source')} as source, true as on_target, true as within_repeats from mix_targets m join documents d on {label('m.source')} = {label('d.source')} where d.text <> '' and target_share > 0",
    }
