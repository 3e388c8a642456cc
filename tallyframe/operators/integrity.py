"""Lint of datasets, verification of runs, checks before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5

#: Failure taxonomy: class, kind, retryable, systemic, and where it may stand (fixed values of this package).
TAXONOMY = [
    ("input", "invalid_case", False, False, "both"), ("input", "oversize", False, False, "both"), ("input", "missing_field", False, False, "both"), ("input", "duplicate_key", False, False, "both"), ("input", "bad_config", False, True, "both"),
    ("target", "exception", False, False, "case"), ("target", "timeout", True, False, "case"), ("target", "contract_violation", False, False, "case"), ("target", "blocked", False, False, "case"), ("target", "empty_output", False, False, "case"),
    ("evaluator", "invalid_output", False, False, "evaluator"), ("evaluator", "truncated", False, False, "evaluator"), ("evaluator", "refused", False, False, "evaluator"), ("evaluator", "bad_request", False, True, "evaluator"), ("evaluator", "internal_error", False, False, "evaluator"),
    ("infrastructure", "rate_limited", True, False, "both"), ("infrastructure", "provider_unavailable", True, False, "both"), ("infrastructure", "timeout", True, False, "both"), ("infrastructure", "connection", True, False, "both"), ("infrastructure", "auth", False, True, "both"),
    ("infrastructure", "quota_exhausted", False, True, "both"), ("infrastructure", "storage", False, False, "both"), ("infrastructure", "budget_exceeded", True, False, "both"), ("infrastructure", "deadline_exceeded", True, False, "both"), ("infrastructure", "cancelled", False, False, "both"), ("infrastructure", "internal_error", False, False, "both"),
]


def taxonomy(spark) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "failure_class string, failure_kind string, retryable boolean, systemic boolean, stage string")


def retry_eligible(failure_class: Column, failure_kind: Column, retry_round: Column, max_rounds: int = 3, blocked: list[tuple[str, str]] = (), also: list[tuple[str, str]] = ()) -> Column:
    """Whether a failure may be tried in another round: retryable and not blocked, or listed besides."""
    pair = F.concat_ws("/", failure_class, failure_kind)
    retryable = [f"{c}/{k}" for c, k, r, _, _ in TAXONOMY if r and (c, k) not in set(blocked)]
    return (retry_round < max_rounds) & (pair.isin(*retryable) | (pair.isin(*[f"{c}/{k}" for c, k in also]) if also else F.lit(False)))


# lint


def lint(cases: DataFrame) -> DataFrame:
    """(check, n): surplus copies of content, prompts with several contents, empty outputs and references,
    outputs in only some cases, rankings without labels. Null and empty are both empty here."""
    content = cases.groupBy("content_hash").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_content").alias("check"), "n")
    prompts = cases.groupBy("prompt").agg(F.count("*").alias("c"), F.countDistinct("content_hash").alias("d")).where("d > 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).select(F.lit("duplicate_prompt").alias("check"), "n")
    blank = lambda c: F.col(c).isNotNull() & (F.trim(c) == "")
    one = cases.agg(
        F.count_if(blank("output")).alias("empty_output"), F.count_if(blank("reference")).alias("empty_reference"), F.count_if(F.col("output").isNull()).alias("no_output"), F.count("output").alias("with_output"), F.count_if(F.col("retrieved").isNotNull() & F.col("relevance").isNull()).alias("retrieved_without_relevance")
    )
    mixed = F.when((F.col("no_output") > 0) & (F.col("with_output") > 0), F.least("no_output", "with_output")).otherwise(0)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("n")) for k, v in (("empty_output", F.col("empty_output")), ("empty_reference", F.col("empty_reference")), ("mixed_output_presence", mixed), ("retrieved_without_relevance", F.col("retrieved_without_relevance")))])).alias("r")).select("r.*")
    return content.unionByName(prompts).unionByName(rows)


def duplicate_prompts(cases: DataFrame) -> DataFrame:
    """The cases whose prompt has more than one content."""
    bad = cases.groupBy("prompt").agg(F.countDistinct("content_hash").alias("d")).where("d > 1").select("prompt")
    return cases.join(bad, "prompt", "left_semi")


def lint_examples(cases: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """(check, case_key): the first keys of each row-level check."""
    checks = {"empty_output": F.col("output").isNotNull() & (F.trim("output") == ""), "empty_reference": F.col("reference").isNotNull() & (F.trim("reference") == ""), "retrieved_without_relevance": F.col("retrieved").isNotNull() & F.col("relevance").isNull()}
    out = None
    for name, cond in checks.items():
        t = cases.where(cond).orderBy("case_key").limit(k).select(F.lit(name).alias("check"), "case_key")
        out = t if out is None else out.unionByName(t)
    return out


def contamination(cases: DataFrame, template: str, min_chars: int = 20) -> DataFrame:
    """(case_key, field): prompts or references of at least min_chars that stand word for word in a template."""
    rows = cases.select("case_key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("prompt", "reference")])).alias("r"))
    return rows.where((F.length("r.text") >= min_chars) & F.contains(F.lit(template), F.col("r.text"))).select("case_key", "r.field")


# verification of runs


def verify_run(runs: DataFrame, cases: DataFrame, case_results: DataFrame, evaluator_results: DataFrame, metrics: DataFrame, attempts: DataFrame | None = None, history: DataFrame | None = None, evaluators: DataFrame | None = None) -> DataFrame:
    """(check, run_id, unit): one row per violation; none means the runs are sound.

    runs (run_id, dataset_version_id, status, ...), cases (dataset_version_id, case_key)."""
    row = lambda df, check, unit="case_key": df.select(F.lit(check).alias("check"), "run_id", F.col(unit).cast("string").alias("unit"))
    r = runs.select("run_id", F.col("dataset_version_id").alias("_version"), F.col("status").alias("_run_status"))
    cr = case_results.join(r, "run_id")
    kinds = taxonomy(cases.sparkSession)
    parts = [
        row(case_results.join(runs.select("run_id"), "run_id", "left_anti"), "unknown_run"),
        row(cr.join(cases.select(F.col("case_key").alias("_c"), F.col("dataset_version_id").alias("_v")), (F.col("case_key") == F.col("_c")) & (F.col("_version") == F.col("_v")), "left_anti"), "orphan_case"),
        row(case_results.groupBy("run_id", "case_key").count().where("count > 1"), "duplicate_case_result"),
        row(case_results.where("status not in ('pending', 'complete', 'failed')"), "unknown_status"),
        row(case_results.where("(status = 'complete' and (output is null or failure_class is not null)) or (status = 'failed' and (failure_class is null or failure_kind is null)) or (status = 'pending' and (output is not null or failure_class is not null))"), "status_fit"),
        row(case_results.where("status = 'failed'").join(kinds.where("stage in ('both', 'case')"), ["failure_class", "failure_kind"], "left_anti"), "unknown_case_failure"),
        row(evaluator_results.join(case_results.select("run_id", "case_key"), ["run_id", "case_key"], "left_anti"), "result_without_case"),
        row(evaluator_results.groupBy("run_id", "case_key", "evaluator_key").count().where("count > 1"), "duplicate_evaluator_result"),
        row(evaluator_results.where("status not in ('ok', 'not_applicable', 'failed', 'skipped')"), "unknown_evaluator_status"),
        row(evaluator_results.where("status = 'failed'").join(kinds.where("stage in ('both', 'evaluator')"), ["failure_class", "failure_kind"], "left_anti"), "unknown_evaluator_failure"),
        row(evaluator_results.alias("e").join(case_results.select("run_id", "case_key", F.col("status").alias("_s")), ["run_id", "case_key"]).where("(e.status = 'skipped') <> (_s = 'failed')"), "skipped_iff_failed"),
        row(evaluator_results.where("status = 'ok'").join(metrics.select("run_id", "case_key", "evaluator_key").distinct(), ["run_id", "case_key", "evaluator_key"], "left_anti"), "ok_without_metric"),
        row(metrics.join(evaluator_results.where("status = 'ok'").select("run_id", "case_key", "evaluator_key"), ["run_id", "case_key", "evaluator_key"], "left_anti"), "metric_without_ok"),
        row(metrics.where("value is null or isnan(value) or abs(value) = double('Infinity')"), "metric_not_finite"),
    ]
    if evaluators is not None:
        parts.append(row(evaluator_results.join(evaluators.select("run_id", "evaluator_key"), ["run_id", "evaluator_key"], "left_anti"), "unknown_evaluator", "evaluator_key"))
        n = evaluators.groupBy("run_id").agg(F.count("*").alias("_e"))
        per = cr.where("_run_status = 'succeeded'").join(evaluator_results.groupBy("run_id", "case_key").agg(F.count("*").alias("_n")), ["run_id", "case_key"], "left").join(n, "run_id")
        parts.append(row(per.where("status = 'pending' or coalesce(_n, 0) < _e"), "succeeded_incomplete"))
    if attempts is not None:
        from tallyframe.operators.ledger import attempt_gaps

        parts.append(row(attempt_gaps(attempts), "attempt_numbers"))
    if history is not None:
        h = history.where("evaluator_key is null").groupBy("run_id", "case_key").agg(F.count("*").alias("_h"))
        parts.append(row(case_results.join(h, ["run_id", "case_key"], "left").where("coalesce(retry_round, 0) <> coalesce(_h, 0)"), "retry_round"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preflight(cases: DataFrame, requires: dict[str, tuple[str, ...]]) -> DataFrame:
    """(evaluator_key, field, missing, total): nulls of every field an evaluator needs, in one pass over the cases."""
    fields = sorted({f for fs in requires.values() for f in fs if f in cases.columns})
    t = cases.agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    need = [F.struct(F.lit(k).alias("evaluator_key"), F.lit(f).alias("field"), (F.col(f) if f in fields else F.col("total")).alias("missing"), F.col("total")) for k, fs in sorted(requires.items()) for f in fs]
    if not need:
        return cases.sparkSession.createDataFrame([], "evaluator_key string, field string, missing bigint, total bigint")
    return t.select(F.explode(F.array(*need)).alias("r")).select("r.*")


def call_plan(cases: DataFrame, calls: dict[str, tuple[int, int, float | None, float | None]]) -> DataFrame:
    """(stage, n_cases, most_calls, most_tokens, most_cost) of stages that call a model, before any call is made.

    calls: per stage the most calls a case can take, the answer's token limit, and the prices of a million tokens in and
    out; without prices the cost is null. A case's prompt, context, reference and output all count as input."""
    from tallyframe.operators.ledger import OVERHEAD_TOKENS

    size = F.lit(0)
    for c in ("prompt", "context", "reference", "output"):
        if c in cases.columns:
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
    t = cases.agg(F.count("*").alias("n_cases"), F.coalesce(F.sum(size + OVERHEAD_TOKENS), F.lit(0)).alias("tokens_in"))
    row = lambda name, k, limit, a, b: F.struct(
        F.lit(name).alias("stage"), F.col("n_cases"), (F.col("n_cases") * k).alias("most_calls"), (F.lit(k) * (F.col("tokens_in") + F.col("n_cases") * limit)).alias("most_tokens"),
        (F.lit(k) * (F.col("tokens_in") * F.lit(a).cast("double") + F.col("n_cases") * limit * F.lit(b).cast("double")) / 1e6).alias("most_cost"),
    )
    if not calls:
        return t.sparkSession.createDataFrame([], "stage string, n_cases bigint, most_calls bigint, most_tokens bigint, most_cost double")
    return t.select(F.explode(F.array(*[row(name, *v) for name, v in sorted(calls.items())])).alias("r")).select("r.*")
