"""Evaluation facts derived from general tables, in SQL that Spark and other engines read alike.

A view names its inputs in braces; `view` resolves them as DataFrames, `sql_of` as nested queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

KEY = "concat('o', lpad(cast(o_orderkey as string), 10, '0'))"

VIEWS: dict[str, str] = {
    # Cases, and one run's results over them, from orders.
    "v_cases": f"select {KEY} as case_key, o_orderkey, case when o_orderkey % 101 = 0 then cast(null as string) else cast(o_orderkey * 7 as string) end as input_hash, concat('p', cast(o_orderkey % 977 as string)) as prompt, cast(o_orderkey % 1931 as string) as content_hash, o_orderpriority as tag_a, o_orderstatus as tag_b from {{orders}}",
    "v_case_results": f"""select 'r1' as run_id, {KEY} as case_key, o_orderkey,
        case when o_orderkey % 20 = 0 then 'failed' when o_orderkey % 41 = 0 then 'pending' else 'complete' end as status,
        case when o_orderkey % 60 = 0 then 'target' when o_orderkey % 60 = 20 then 'input' when o_orderkey % 60 = 40 then 'infrastructure' end as failure_class,
        case when o_orderkey % 60 = 0 then 'exception' when o_orderkey % 60 = 20 then 'oversize' when o_orderkey % 60 = 40 then 'timeout' end as failure_kind,
        case when o_orderkey % 20 <> 0 and o_orderkey % 41 <> 0 then concat(o_orderpriority, repeat('x', cast(o_orderkey % 37 as int))) end as output,
        case when o_orderkey % 50 = 1 then '{{{{"truncated": true}}}}' when o_orderkey % 50 = 2 then '{{{{"truncated": false}}}}' end as target_meta,
        cast(0 as int) as retry_round, cast(o_orderkey % 500 as double) as duration_ms from {{orders}}""",
    "v_evaluator_results": """select run_id, case_key, o_orderkey, evaluator_key, status,
        case when status = 'failed' then case when o_orderkey % 2 = 0 then 'evaluator' else 'infrastructure' end end as failure_class,
        case when status = 'failed' then case when o_orderkey % 2 = 0 then 'invalid_output' else 'rate_limited' end end as failure_kind,
        case when status = 'ok' then case when o_orderkey % 29 = 0 then 'UNCERTAIN' when (o_orderkey + shift) % 3 = 0 then 'FAIL' else 'PASS' end end as verdict,
        case when status = 'ok' then case when o_orderkey % 31 = 0 then '{{"failed_gates": ["tone"]}}' else '{{"failed_gates": []}}' end end as detail,
        cast((o_orderkey + shift) % 300 as double) as duration_ms
        from (select c.run_id, c.case_key, c.o_orderkey, e.evaluator_key, e.shift,
            case when c.status = 'failed' then 'skipped' when (c.o_orderkey + e.shift) % 11 = 0 then 'not_applicable' when (c.o_orderkey + e.shift) % 13 = 0 then 'failed' else 'ok' end as status
            from {v_case_results} c cross join (select 'exact_match:em' as evaluator_key, 0 as shift union all select 'llm_judge:quality' as evaluator_key, 1 as shift) e where c.status <> 'pending') x""",
    "v_totals": "select 'r1' as run_id, count(*) as total from {orders}",
    "v_order_scores": "select l_orderkey, greatest(cast(0 as double), least(cast(1 as double), 1 - avg(l_discount) * 10)) as score, max(case when l_returnflag = 'R' then cast(1 as double) else cast(0 as double) end) as hit from {lineitem} group by l_orderkey",
    "v_metrics": """select r.run_id, r.case_key, r.evaluator_key, case when r.evaluator_key = 'exact_match:em' then 'match' else 'score' end as name, case when r.evaluator_key = 'exact_match:em' then s.hit else s.score end as value
        from {v_evaluator_results} r join {v_order_scores} s on s.l_orderkey = r.o_orderkey where r.status = 'ok'""",
    # Two runs: the candidate shifts scores down and up and lacks some cases.
    "v_side_b": f"select {KEY} as case_key, cast(o_orderkey * 7 as string) as input_hash, case when o_orderkey % 20 = 0 then 'failed' else 'complete' end as status, case when o_orderkey % 20 = 0 then 'target' end as failure_class, cast(o_orderkey % 500 as double) as duration_ms from {{orders}}",
    "v_side_c": f"select {KEY} as case_key, cast(case when o_orderkey % 89 = 0 then o_orderkey else o_orderkey * 7 end as string) as input_hash, case when o_orderkey % 23 = 0 then 'failed' else 'complete' end as status, case when o_orderkey % 23 = 0 then 'target' end as failure_class, cast((o_orderkey * 3) % 520 as double) as duration_ms from {{orders}} where o_orderkey % 97 <> 0",
    "v_two_metrics": """select run_id, concat('o', lpad(cast(l_orderkey as string), 10, '0')) as case_key, evaluator_key, name, value from (
        select 'b' as run_id, l_orderkey, 'llm_judge:quality' as evaluator_key, 'score' as name, score as value from {v_order_scores}
        union all select 'b' as run_id, l_orderkey, 'exact_match:em' as evaluator_key, 'match' as name, hit as value from {v_order_scores}
        union all select 'c' as run_id, l_orderkey, 'llm_judge:quality' as evaluator_key, 'score' as name, case when l_orderkey % 7 = 0 then greatest(cast(0 as double), score - cast(0.1 as double)) when l_orderkey % 11 = 0 then least(cast(1 as double), score + cast(0.05 as double)) else score end as value from {v_order_scores} where l_orderkey % 97 <> 0
        union all select 'c' as run_id, l_orderkey, 'exact_match:em' as evaluator_key, 'match' as name, case when l_orderkey % 7 = 0 then cast(0 as double) when l_orderkey % 11 = 0 then cast(1 as double) else hit end as value from {v_order_scores} where l_orderkey % 97 <> 0) u""",
    # Ranked parts of an order with grades.
    "v_ranked": """select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by pos, l_partkey) as rank, grade from (
        select l_orderkey, l_partkey, min(l_linenumber) as pos, case when max(l_quantity) >= 40 then 2 when max(l_quantity) >= 25 then 1 else 0 end as grade from {lineitem} group by l_orderkey, l_partkey) p""",
    # Calls, from events.
    "v_attempts": """select event_id as seq, case when user_id % 2 = 0 then 'r1' else 'r2' end as run_id, case when event_type in ('click', 'view') then 'target' else 'evaluator' end as scope, cast(user_id as string) as case_key, cast(null as string) as evaluator_key,
        row_number() over (partition by user_id, event_type in ('click', 'view') order by event_id) as n, case when event_type = 'error' then 'failed' else 'ok' end as outcome, case when event_type = 'error' then 'infrastructure' end as failure_class, case when event_type = 'error' then 'timeout' end as failure_kind,
        'acme' as provider, concat('m', cast(user_id % 5 as string)) as model, case when event_id % 17 <> 0 then event_id % 100 end as input_tokens, case when event_id % 19 <> 0 then event_id % 50 end as output_tokens, value as duration_ms, case when event_type = 'signup' then true else false end as cache_hit, cast(event_id % 3 as int) as retry_round, case when event_id % 4 = 0 then 'p1' when event_id % 4 = 1 then 'p2' end as price_version from {events}""",
    "v_prices": "select 'acme' as provider, 'm0' as model, cast(1.5 as double) as input_per_mtok, cast(7.5 as double) as output_per_mtok union all select 'acme', 'm1', cast(3 as double), cast(15 as double) union all select 'acme', 'm2', cast(0.25 as double), cast(1.25 as double)",
    # Reviews of evaluations by people, and the judge's own verdicts.
    "v_reviews": """select evaluation_id as case_key, 'judge' as evaluator_key, sample, reviewer, verdict, created_at, id as seq from (
        select id, max(evaluation_id) as evaluation_id, max(sample) as sample, max(lower(trim(reviewer))) as reviewer, max(upper(trim(verdict))) as verdict, max(created_at) as created_at from {reviews} group by id) r where evaluation_id is not null and verdict is not null""",
    "v_judged": "select id as case_key, 'judge' as evaluator_key, 'ok' as status, max(verdict) as verdict, max(overall_score) as score from {evaluations} where status = 'ok' group by id",
    "v_verdicts": """select case_key, evaluator_key, evaluator_key <> 'exact_match:em' as is_judge, verdict, score from (
        select r.case_key, r.evaluator_key, r.verdict, s.score from {v_evaluator_results} r join {v_order_scores} s on s.l_orderkey = r.o_orderkey where r.status = 'ok'
        union all select r.case_key, 'llm_judge:second' as evaluator_key, case when s.score > cast(0.5 as double) then 'PASS' else 'UNCERTAIN' end as verdict, case when r.o_orderkey % 5 = 0 then 1 - s.score else s.score end as score from {v_evaluator_results} r join {v_order_scores} s on s.l_orderkey = r.o_orderkey where r.status = 'ok' and r.evaluator_key = 'llm_judge:quality') u""",
    # The cases table, each case once.
    "v_real_cases": "select id, max(case_key) as case_key, max(dataset_version_id) as dataset_version_id, max(content_hash) as content_hash, max(prompt) as prompt, max(output) as output, max(reference) as reference, max(context) as context from {cases} group by id",
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **inputs) if inputs else spark.sql(VIEWS[name])


def sql_of(name: str) -> str:
    """A view as a nested query over the tables."""
    if name not in VIEWS:
        return name
    return "(" + _NAME.sub(lambda m: sql_of(m.group(1)), VIEWS[name]).replace("{{", "{").replace("}}", "}") + ")"


def oracle(text: str) -> str:
    """SQL with views in braces, as plain SQL."""
    return _NAME.sub(lambda m: sql_of(m.group(1)), text)
