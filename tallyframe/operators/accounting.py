"""Accounting over the facts of runs: every case in exactly one outcome, denominators that say so.

Facts: case_results (run_id, case_key, status, failure_class, failure_kind, duration_ms, ...),
evaluator_results (run_id, case_key, evaluator_key, status, failure_class, failure_kind, verdict,
duration_ms, detail), metrics (run_id, evaluator_key, case_key, name, value), totals (run_id, total)
with the number of cases of each run. All operators work on any number of runs at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import hashing, stats
from tallyframe.operators import ledger

MIN_COVERAGE, SMALL_SAMPLE, MIN_SLICE = 0.95, 30, 10
LENGTH_BIAS_N, LENGTH_BIAS_RHO, NA_SHARE = 10, 0.5, 0.5


def case_accounting(case_results: DataFrame) -> DataFrame:
    return case_results.groupBy("run_id", "status", F.coalesce("failure_class", F.lit("")).alias("failure_class")).agg(F.count("*").alias("n"))


def evaluator_accounting(evaluator_results: DataFrame) -> DataFrame:
    return evaluator_results.groupBy("run_id", "evaluator_key", "status", F.coalesce("failure_class", F.lit("")).alias("failure_class")).agg(F.count("*").alias("n"))


def case_stages(case_results: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per run: complete, pending, failed by class, and missing, which have no result at all."""
    failed = lambda c: F.count_if((F.col("status") == "failed") & (F.col("failure_class") == c)).alias(f"failed_{c}")
    t = case_results.groupBy("run_id").agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "pending").alias("pending"), failed("target"), failed("input"), failed("infrastructure"))
    done = [F.coalesce(c, F.lit(0)).alias(c) for c in ("complete", "pending", "failed_target", "failed_input", "failed_infrastructure")]
    out = totals.join(t, "run_id", "left").select("run_id", "total", *done)
    return out.withColumn("missing", F.col("total") - F.col("complete") - F.col("pending") - F.col("failed_target") - F.col("failed_input") - F.col("failed_infrastructure"))


def evaluator_coverage(evaluator_results: DataFrame, stages: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Counts and coverage per evaluator. `missing` is relative to the cases that ended; coverage is ok over
    applicable cases and null where nothing applies."""
    status = lambda s: F.count_if(F.col("status") == s)
    failed = lambda c: F.count_if((F.col("status") == "failed") & (F.col("failure_class") == c)).alias(f"failed_{c}")
    t = evaluator_results.groupBy("run_id", "evaluator_key").agg(status("ok").alias("ok"), status("not_applicable").alias("not_applicable"), status("skipped").alias("skipped"), failed("evaluator"), failed("infrastructure"), failed("input"))
    terminal = F.col("complete") + F.col("failed_target") + F.col("s_input") + F.col("s_infra")
    s = stages.select("run_id", "total", "complete", "failed_target", F.col("failed_input").alias("s_input"), F.col("failed_infrastructure").alias("s_infra"))
    known = F.col("ok") + F.col("not_applicable") + F.col("skipped") + F.col("failed_evaluator") + F.col("failed_infrastructure") + F.col("failed_input")
    applicable = F.col("total") - F.col("not_applicable")
    attempted = F.col("ok") + F.col("not_applicable") + F.col("failed_evaluator") + F.col("failed_infrastructure") + F.col("failed_input")
    j = t.join(s, "run_id").withColumn("missing", F.greatest(F.lit(0), terminal - known)).withColumn("applicable", applicable)
    coverage = F.when(applicable > 0, F.col("ok") / applicable)
    return j.select(
        "run_id", "evaluator_key", "ok", "not_applicable", "skipped", "failed_evaluator", "failed_infrastructure", "failed_input", "missing", "applicable",
        F.round(coverage, 9).alias("coverage"), F.coalesce(coverage >= min_coverage, F.lit(False)).alias("sufficient"),
        F.round(F.try_divide(F.col("not_applicable"), F.col("total")), 9).alias("na_share"), F.round(F.try_divide(F.col("failed_evaluator"), attempted), 9).alias("evaluator_failure_rate"),
    )


def metric_summary(metrics: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Per metric: n, mean, the headline value (null where coverage is insufficient), quantiles, a flag for
    0/1 metrics, and the interval that needs no resampling: Wilson for 0/1, else normal."""
    v = F.col("value")
    t = metrics.groupBy("run_id", "evaluator_key", "name").agg(
        F.count("*").alias("n"), stats.mean(v).alias("mean"), stats.stdev(v).alias("stdev"), F.sum(v).alias("sum"), F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.min(v).alias("min"), F.max(v).alias("max"), stats.is_binary(v).alias("binary")
    )
    wl, wh = stats.wilson(F.round("sum"), F.col("n"))
    nl, nh = stats.normal_interval(F.col("mean"), F.col("stdev"), F.col("n"))
    r = lambda c: F.round(c, 9)
    out = t.select(
        "run_id", "evaluator_key", "name", "n", r(F.col("mean")).alias("mean"), r(F.col("stdev")).alias("stdev"), r(F.col("q")[0]).alias("p10"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("p90"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), "binary",
        r(F.when(F.col("binary"), wl).otherwise(nl)).alias("ci_low"), r(F.when(F.col("binary"), wh).otherwise(nh)).alias("ci_high"), F.when(F.col("binary"), "wilson").when(F.col("n") < 2, "none").otherwise("normal").alias("ci_method"), (F.col("n") < SMALL_SAMPLE).alias("small_sample"),
    )
    if coverage is not None:
        out = out.join(coverage.select("run_id", "evaluator_key", "sufficient"), ["run_id", "evaluator_key"], "left").withColumn("value", F.when(F.col("sufficient"), F.col("mean"))).drop("sufficient")
    return out


def metric_summary_bootstrap(metrics: DataFrame, seed: int = 0) -> DataFrame:
    """metric_summary with bootstrap intervals for metrics that are not 0/1 and have fewer than 5000 values."""
    seeded = metrics.withColumn("_seed", hashing.metric_seed(seed, F.col("evaluator_key"), F.col("name")).cast("string"))
    keys = ["run_id", "evaluator_key", "name"]
    ci = stats.mean_interval(seeded, keys, "value", "_seed").select(*keys, F.col("ci_low").alias("bl"), F.col("ci_high").alias("bh"), F.col("ci_method").alias("bm"))
    j = metric_summary(metrics).join(ci, keys)
    pick = lambda a, b: F.when(F.col("binary"), F.col(a)).otherwise(F.col(b))
    return j.withColumns({"ci_low": pick("ci_low", "bl"), "ci_high": pick("ci_high", "bh"), "ci_method": pick("ci_method", "bm")}).drop("bl", "bh", "bm")


def verdict_counts(evaluator_results: DataFrame) -> DataFrame:
    v = lambda x: F.count_if(F.col("verdict") == x)
    return evaluator_results.where("status = 'ok'").groupBy("run_id", "evaluator_key").agg(v("PASS").alias("n_pass"), v("FAIL").alias("n_fail"), v("UNCERTAIN").alias("n_uncertain"), F.count_if(F.col("verdict").isNull()).alias("n_none"))


def pass_rates(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Pass rate over confident verdicts with Wilson bounds, its bounds if uncertain ones all failed or passed, and the strict rate over all cases."""
    k, n = F.col("n_pass"), F.col("n_pass") + F.col("n_fail")
    low, high = stats.wilson(k, n)
    u = n + F.col("n_uncertain")
    r = lambda c: F.round(c, 9)
    return counts.join(totals, "run_id").select(
        "run_id", "evaluator_key", r(F.try_divide(k, n)).alias("pass_rate"), r(low).alias("ci_low"), r(high).alias("ci_high"), r(F.try_divide(k, u)).alias("if_failed"), r(F.try_divide(k + F.col("n_uncertain"), u)).alias("if_passed"), r(F.try_divide(k, F.col("total"))).alias("strict")
    )


def latency_summary(case_results: DataFrame, evaluator_results: DataFrame) -> DataFrame:
    """n, mean, p50 and p95 of durations: of the target over complete cases, and of every evaluator over ok results."""
    rows = case_results.where("status = 'complete'").select("run_id", F.lit("target").alias("stage"), "duration_ms").unionByName(evaluator_results.where("status = 'ok'").select("run_id", F.col("evaluator_key").alias("stage"), "duration_ms"))
    ms = F.col("duration_ms").cast("double")
    t = rows.where("duration_ms is not null").groupBy("run_id", "stage").agg(F.count("*").alias("n"), F.avg(ms).alias("m"), F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return t.select("run_id", "stage", "n", F.round("m", 9).alias("mean"), F.round(F.col("q")[0], 9).alias("p50"), F.round(F.col("q")[1], 9).alias("p95"))


def tag_slices(metrics: DataFrame, cases: DataFrame, min_n: int = MIN_SLICE) -> DataFrame:
    """Mean of every metric over the cases with a tag, where there are at least min_n."""
    tagged = cases.select("case_key", F.explode(F.array_distinct("tags")).alias("tag"))
    t = metrics.join(tagged, "case_key").groupBy("run_id", "tag", "evaluator_key", "name").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return t.where(F.col("n") >= min_n).select("run_id", "tag", "evaluator_key", "name", "n", F.round("m", 9).alias("mean"))


def length_bias(metrics: DataFrame, outputs: DataFrame, name: str = "score") -> DataFrame:
    """Spearman correlation of a metric with the output's length in characters, per evaluator, and whether to warn."""
    rows = metrics.where(F.col("name") == name).join(outputs.select("run_id", "case_key", F.length("output").alias("chars")), ["run_id", "case_key"])
    t = stats.spearman(rows.select("run_id", "evaluator_key", "value", "chars"), ["run_id", "evaluator_key"], "value", "chars")
    return t.select("run_id", "evaluator_key", "n", F.when(F.col("n") >= LENGTH_BIAS_N, F.round("rho", 9)).alias("rho"), F.coalesce((F.col("n") >= LENGTH_BIAS_N) & (F.abs("rho") >= LENGTH_BIAS_RHO), F.lit(False)).alias("warn"))


def failures(case_results: DataFrame, evaluator_results: DataFrame) -> DataFrame:
    """Every failure of both stages: (run_id, case_key, evaluator_key (null: the target), failure_class, failure_kind)."""
    a = case_results.where("status = 'failed'").select("run_id", "case_key", F.lit(None).cast("string").alias("evaluator_key"), "failure_class", "failure_kind")
    return a.unionByName(evaluator_results.where("status = 'failed'").select("run_id", "case_key", "evaluator_key", "failure_class", "failure_kind"))


def failure_counts(case_results: DataFrame, evaluator_results: DataFrame) -> DataFrame:
    scope = F.when(F.col("evaluator_key").isNull(), "target").otherwise("evaluator").alias("scope")
    return failures(case_results, evaluator_results).groupBy("run_id", scope, "failure_class", "failure_kind").agg(F.count("*").alias("n"))


def list_failures(case_results: DataFrame, evaluator_results: DataFrame, failure_class: str | None = None, limit: int = 1000) -> DataFrame:
    """Failures by case, the target's first; at most `limit` rows."""
    rows = failures(case_results, evaluator_results)
    rows = rows if failure_class is None else rows.where(F.col("failure_class") == failure_class)
    return rows.orderBy("run_id", "case_key", F.asc_nulls_first("evaluator_key")).limit(limit)


def run_counts(case_results: DataFrame, evaluator_results: DataFrame, totals: DataFrame) -> DataFrame:
    """Cases by status, and evaluator results by status, one row per run."""
    s = lambda x: F.count_if(F.col("status") == x)
    c = case_results.groupBy("run_id").agg(s("pending").alias("pending"), s("complete").alias("complete"), s("failed").alias("failed"), F.count("*").alias("n"))
    e = evaluator_results.groupBy("run_id").agg(s("ok").alias("e_ok"), s("not_applicable").alias("e_not_applicable"), s("failed").alias("e_failed"), s("skipped").alias("e_skipped"))
    j = totals.join(c, "run_id", "left").join(e, "run_id", "left").fillna(0)
    return j.select("run_id", "total", "pending", "complete", "failed", (F.col("total") - F.col("n")).alias("missing"), "e_ok", "e_not_applicable", "e_failed", "e_skipped")


def truncated(case_results: DataFrame) -> Column:
    return (F.col("status") == "complete") & F.coalesce(F.get_json_object("target_meta", "$.truncated") == "true", F.lit(False))


def warnings(stages: DataFrame, coverage: DataFrame, runs: DataFrame, bias: DataFrame | None = None, truncated_counts: DataFrame | None = None, family_shared: DataFrame | None = None) -> DataFrame:
    """(run_id, evaluator_key, warning): run not succeeded, target not pinned, low coverage, mostly not
    applicable, length bias, judge of the target's family, truncated outputs."""
    run_level = lambda df, cond, name: df.where(cond).select("run_id", F.lit(None).cast("string").alias("evaluator_key"), F.lit(name).alias("warning"))
    eval_level = lambda df, cond, name: df.where(cond).select("run_id", "evaluator_key", F.lit(name).alias("warning"))
    parts = [run_level(runs, F.col("status") != "succeeded", "not_succeeded"), eval_level(coverage, ~F.col("sufficient"), "low_coverage"), eval_level(coverage, F.col("na_share") >= NA_SHARE, "mostly_not_applicable"), run_level(stages, F.col("missing") > 0, "missing_cases")]
    if "pinned" in runs.columns:
        parts.append(run_level(runs, ~F.col("pinned"), "unpinned_target"))
    if bias is not None:
        parts.append(eval_level(bias, F.col("warn"), "length_bias"))
    if truncated_counts is not None:
        parts.append(run_level(truncated_counts, F.col("n_truncated") > 0, "truncated_outputs"))
    if family_shared is not None:
        parts.append(eval_level(family_shared, F.col("shared"), "self_preference"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def truncated_counts(case_results: DataFrame) -> DataFrame:
    """Complete outputs of a run and how many of them were truncated."""
    done = case_results.where("status = 'complete'").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.get_json_object("target_meta", "$.truncated") == "true", F.lit(False))).alias("n_truncated"))
    return done.withColumn("share", F.round(F.col("n_truncated") / F.col("n"), 9))


def summarize(case_results: DataFrame, evaluator_results: DataFrame, metrics: DataFrame, totals: DataFrame, cases: DataFrame | None = None, runs: DataFrame | None = None, priced: DataFrame | None = None) -> dict[str, DataFrame]:
    """All summaries of all runs: one aggregation per fact table, none of them collected. With `cases`, also slices by
    tag; with `priced` attempts, what calls used and cost; with `runs` (run_id, status, pinned), the warnings."""
    stages = case_stages(case_results, totals)
    coverage = evaluator_coverage(evaluator_results, stages)
    counts = verdict_counts(evaluator_results)
    out = {
        "stages": stages, "coverage": coverage, "metrics": metric_summary(metrics, coverage), "verdicts": counts, "pass_rates": pass_rates(counts, totals),
        "latency": latency_summary(case_results, evaluator_results), "failures": failure_counts(case_results, evaluator_results), "truncated": truncated_counts(case_results),
        "length_bias": length_bias(metrics, case_results.where("status = 'complete'")),
    }
    if cases is not None and "tags" in cases.columns:
        out["slices"] = tag_slices(metrics, cases)
    if priced is not None:
        calls = ledger.attempt_stats(priced)
        out |= {"calls": calls, "usage": ledger.usage(calls, totals)}
    if runs is not None:
        out["warnings"] = warnings(stages, coverage, runs, out["length_bias"], out["truncated"])
    return out


def snapshot(summary: dict[str, DataFrame], path: str) -> None:
    """An immutable copy of a summary, whole or not there: written beside its place and moved into it. Refuses a path that exists."""
    spark = next(iter(summary.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staged-{uuid.uuid4().hex}")
    fs = place.getFileSystem(conf)
    if fs.exists(place):
        raise FileExistsError(path)
    try:
        for name, df in summary.items():
            df.write.parquet(f"{staged}/{name}.parquet")
        if not fs.rename(staged, place):
            raise FileExistsError(path)
    finally:
        fs.delete(staged, True)
