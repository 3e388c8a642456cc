"""Comparison of two runs, case by case.

Pairs are cases with equal (case_key, input_hash); a null hash never pairs. Everything up to the
per-metric results stays distributed: one equi join of the runs' cases, one of their metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats

PAIRED_MIN_N, GAP_WARNING, EXTREMES, MAX_EVALUATORS = 30, 0.05, 10, 32
SIDES = ("baseline", "candidate")


def match_evaluators(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(kind, name, baseline_key, candidate_key, match): same key comparable, same kind and name confounded, else informational."""
    b, c = baseline.select("kind", "name", F.col("evaluator_key").alias("baseline_key")), candidate.select("kind", "name", F.col("evaluator_key").alias("candidate_key"))
    match = F.when(F.col("baseline_key") == F.col("candidate_key"), "comparable").when(F.col("baseline_key").isNotNull() & F.col("candidate_key").isNotNull(), "confounded").otherwise("informational")
    return b.join(c, ["kind", "name"], "full_outer").withColumn("match", match)


#: What confounds a comparison if it differs, and what is only told (fixed values of this package).
CONFOUNDERS, INFORMATIONAL = ("evaluator_params", "scoring_version", "endpoints", "validation_retries"), ("dataset", "target", "policy", "timeouts")


def confounders(baseline: dict, candidate: dict) -> dict[str, list[str]]:
    """Which facts of two runs differ, by weight."""
    differs = lambda names: [n for n in names if baseline.get(n) != candidate.get(n)]
    return {"confounding": differs(CONFOUNDERS), "informational": differs(INFORMATIONAL)}


def check_comparable(baseline: dict, candidate: dict, allow: bool = False) -> dict[str, list[str]]:
    """The confounders of two runs' facts; refuses runs that differ in what confounds, unless that is allowed."""
    found = confounders(baseline, candidate)
    if found["confounding"] and not allow:
        raise ValueError(f"the runs are not comparable: {', '.join(found['confounding'])} differ")
    return found


def case_outcomes(case_results: DataFrame, cases: DataFrame, run_id: object) -> DataFrame:
    """One row per case of the run's dataset: status (null without a result), failure class, duration, input hash."""
    r = case_results.where(F.col("run_id") == run_id).select(F.col("case_key").alias("_k"), "status", "failure_class", "duration_ms")
    return cases.select("case_key", "input_hash").join(r, F.col("case_key") == F.col("_k"), "left").drop("_k")


def pair(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The common cases, with both sides' status, failure class and duration."""
    b, c = (df.select("case_key", "input_hash", *[F.col(x).alias(f"{x}_{s}") for x in ("status", "failure_class", "duration_ms")]) for df, s in ((baseline, "b"), (candidate, "c")))
    return b.join(c, ["case_key", "input_hash"])


def unpaired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: common, input_changed, only_baseline, only_candidate."""
    b, c = baseline.select("case_key", F.col("input_hash").alias("hb"), F.lit(True).alias("in_b")), candidate.select("case_key", F.col("input_hash").alias("hc"), F.lit(True).alias("in_c"))
    j = b.join(c, "case_key", "full_outer")
    both = F.col("in_b").isNotNull() & F.col("in_c").isNotNull()
    same = F.coalesce(F.col("hb") == F.col("hc"), F.lit(False))
    return j.agg(F.count_if(both & same).alias("common"), F.count_if(both & ~same).alias("input_changed"), F.count_if(F.col("in_c").isNull()).alias("only_baseline"), F.count_if(F.col("in_b").isNull()).alias("only_candidate"))


def exclusion_reason(status: Column, failure_class: Column, evaluator_status: Column) -> Column:
    """Why a case has no score: no_result, pending, <class>_failure, missing, not_applicable, skipped, evaluator failure, in this order; null if scored."""
    return (
        F.when(status.isNull(), "no_result").when(status == "pending", "pending").when(status == "failed", F.concat(failure_class, F.lit("_failure"))).when(evaluator_status.isNull(), "missing")
        .when(evaluator_status.isin("not_applicable", "skipped"), evaluator_status).when(evaluator_status == "failed", "evaluator_failure")
    )


def exclusions(pairs: DataFrame, evaluator_results: DataFrame, evaluators: DataFrame, baseline: object, candidate: object) -> DataFrame:
    """(side, evaluator_key, reason, n) over the common cases, each case once per side and evaluator."""
    keys = [r[0] for r in evaluators.select("evaluator_key").distinct().limit(MAX_EVALUATORS + 1).collect()]
    if not 0 < len(keys) <= MAX_EVALUATORS:
        raise ValueError(f"a run has 1 to {MAX_EVALUATORS} evaluators")
    grid = pairs.withColumn("evaluator_key", F.explode(F.array(*map(F.lit, sorted(keys)))))
    out = None
    for side, run, s in ((SIDES[0], baseline, "b"), (SIDES[1], candidate, "c")):
        e = evaluator_results.where(F.col("run_id") == run).select("case_key", "evaluator_key", F.col("status").alias("e_status"))
        j = grid.join(e, ["case_key", "evaluator_key"], "left").withColumn("reason", exclusion_reason(F.col(f"status_{s}"), F.col(f"failure_class_{s}"), F.col("e_status")))
        t = j.where("reason is not null").groupBy(F.lit(side).alias("side"), "evaluator_key", "reason").agg(F.count("*").alias("n"))
        out = t if out is None else out.unionByName(t)
    return out


def paired_values(pairs: DataFrame, metrics: DataFrame, baseline: object, candidate: object) -> DataFrame:
    """(evaluator_key, name, case_key, base, cand, diff): metrics that both sides have, over common complete cases."""
    keys = pairs.where("status_b = 'complete' and status_c = 'complete'").select("case_key")
    b = metrics.where(F.col("run_id") == baseline).select("case_key", "evaluator_key", "name", F.col("value").alias("base"))
    c = metrics.where(F.col("run_id") == candidate).select("case_key", "evaluator_key", "name", F.col("value").alias("cand"))
    return b.join(c, ["case_key", "evaluator_key", "name"]).join(keys, "case_key", "left_semi").withColumn("diff", F.col("cand") - F.col("base"))


def paired_stats(values: DataFrame) -> DataFrame:
    """Per metric: n, means, mean difference with its normal interval, sd, smallest detectable effect, moves, and McNemar's p for 0/1 metrics."""
    d, n = F.col("diff"), F.col("n")
    t = values.groupBy("evaluator_key", "name").agg(
        F.count("*").alias("n"), F.avg("base").alias("mb"), F.avg("cand").alias("mc"), F.avg(d).alias("md"), stats.stdev(d).alias("sd"), F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"), F.count_if(d == 0).alias("tied"), (stats.is_binary(F.col("base")) & stats.is_binary(F.col("cand"))).alias("binary")
    )
    low, high = stats.normal_interval(F.col("md"), F.col("sd"), n)
    r = lambda c, a: F.round(c, 9).alias(a)
    return t.select(
        "evaluator_key", "name", "n", r(F.col("mb"), "mean_base"), r(F.col("mc"), "mean_cand"), r(F.col("md"), "mean_diff"), r(F.col("sd"), "sd_diff"), r(low, "ci_low"), r(high, "ci_high"), r(stats.minimum_detectable_effect(F.col("sd"), n), "mde"), "higher", "lower", "tied", "binary",
        F.when(F.col("binary"), F.round(stats.mcnemar_exact(F.col("lower"), F.col("higher")), 9)).alias("mcnemar_p"),
    )


def paired_stats_bootstrap(values: DataFrame, seed: int = 0) -> DataFrame:
    """paired_stats with seeded bootstrap intervals below 5000 pairs."""
    from tallyframe.functions import hashing

    keys = ["evaluator_key", "name"]
    seeded = values.withColumn("_seed", hashing.metric_seed(seed, F.col("evaluator_key"), F.col("name")).cast("string"))
    ci = stats.mean_interval(seeded, keys, "diff", "_seed").select(*keys, F.col("ci_low").alias("bl"), F.col("ci_high").alias("bh"), "ci_method")
    return paired_stats(values).join(ci, keys).withColumn("ci_low", F.coalesce("bl", "ci_low")).withColumn("ci_high", F.coalesce("bh", "ci_high")).drop("bl", "bh")


def extremes(values: DataFrame, k: int = EXTREMES) -> DataFrame:
    """(evaluator_key, name, side, rank, case_key, diff): the k worst (negative) and best (positive) cases, ties by key."""
    worst = Window.partitionBy("evaluator_key", "name").orderBy("diff", "case_key")
    best = Window.partitionBy("evaluator_key", "name").orderBy(F.desc("diff"), F.desc("case_key"))
    pick = lambda rows, w, side: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("evaluator_key", "name", F.lit(side).alias("side"), "rank", "case_key", F.round("diff", 9).alias("diff"))
    return pick(values.where("diff < 0"), worst, "worst").unionByName(pick(values.where("diff > 0"), best, "best"))


def target_failure_values(pairs: DataFrame) -> DataFrame:
    """The derived 0/1 metric target_failure_rate over common cases that ended on both sides."""
    failed = lambda s: ((F.col(f"status_{s}") == "failed") & (F.col(f"failure_class_{s}") == "target")).cast("double")
    ended = pairs.where("status_b in ('complete', 'failed') and status_c in ('complete', 'failed')")
    v = ended.select(F.lit("run").alias("evaluator_key"), F.lit("target_failure_rate").alias("name"), "case_key", failed("b").alias("base"), failed("c").alias("cand"))
    return v.withColumn("diff", F.col("cand") - F.col("base"))


def latency_compare(pairs: DataFrame) -> DataFrame:
    """One row: n, p50 and p95 of both sides over common complete cases, and relative changes (null where the base is not positive)."""
    q = lambda s: F.percentile(F.col(f"duration_ms_{s}").cast("double"), F.array(F.lit(0.5), F.lit(0.95)))
    t = pairs.where("status_b = 'complete' and status_c = 'complete' and duration_ms_b is not null and duration_ms_c is not null").agg(F.count("*").alias("n"), q("b").alias("b"), q("c").alias("c"))
    out = t.select("n", *[F.round(F.col(s)[i], 9).alias(f"{p}_{name}") for s, name in (("b", "base"), ("c", "cand")) for i, p in ((0, "p50"), (1, "p95"))])
    change = lambda p: F.round(F.when(F.col(f"{p}_base") > 0, F.col(f"{p}_cand") / F.col(f"{p}_base") - 1), 9).alias(f"{p}_change")
    return out.select("*", change("p50"), change("p95"))


def gaps(coverage_b: DataFrame, coverage_c: DataFrame) -> DataFrame:
    """Per evaluator: differences of coverage and of the not-applicable share, and whether they are worth a warning."""
    b, c = (df.select("evaluator_key", F.col("coverage").alias(f"coverage_{s}"), F.col("na_share").alias(f"na_{s}")) for df, s in ((coverage_b, "b"), (coverage_c, "c")))
    cov, na = F.col("coverage_c") - F.col("coverage_b"), F.col("na_c") - F.col("na_b")
    return b.join(c, "evaluator_key").select("evaluator_key", F.round(cov, 9).alias("coverage_gap"), F.round(na, 9).alias("na_gap"), (F.abs(cov) > GAP_WARNING).alias("coverage_warning"), (F.abs(na) > GAP_WARNING).alias("na_warning"))


def truncation_gap(case_results_b: DataFrame, case_results_c: DataFrame) -> DataFrame:
    """One row: the share of complete outputs that were truncated on either side, the gap, and whether it is worth a warning;
    a side without complete outputs has a null share."""
    cut = F.coalesce(F.get_json_object("target_meta", "$.truncated") == "true", F.lit(False)).cast("double")
    b, c = (df.where("status = 'complete'").agg(F.avg(cut).alias(f"share_{s}")) for df, s in ((case_results_b, "b"), (case_results_c, "c")))
    gap = F.col("share_c") - F.col("share_b")
    one = b.join(c)  # a row each
    return one.select(F.round("share_b", 9).alias("share_base"), F.round("share_c", 9).alias("share_cand"), F.round(gap, 9).alias("gap"), F.coalesce(F.abs(gap) > GAP_WARNING, F.lit(False)).alias("warning"))


def noise_floor(paired: DataFrame) -> DataFrame:
    """For two runs of one identity: what a difference must exceed to be more than noise."""
    half = (F.col("ci_high") - F.col("ci_low")) / 2
    return paired.select("evaluator_key", "name", F.round(F.greatest(F.abs("mean_diff"), half), 9).alias("noise_floor"))


def decide(paired: DataFrame, gates: DataFrame) -> DataFrame:
    """(evaluator_key, name, decision) for gates (evaluator_key, name, direction, delta, rel_delta, min_n).

    The difference is turned so that up is better; the margin is delta or rel_delta of the base mean.
    Too few pairs are inconclusive; an interval below -margin is a regression, above margin an
    improvement, within a positive margin equivalent, anything else inconclusive."""
    g = gates.select("evaluator_key", "name", "direction", "delta", "rel_delta", F.coalesce("min_n", F.lit(PAIRED_MIN_N)).alias("min_n"))
    j = g.join(paired, ["evaluator_key", "name"], "left")
    up = F.col("direction") == "higher"
    lo, hi = F.when(up, F.col("ci_low")).otherwise(-F.col("ci_high")), F.when(up, F.col("ci_high")).otherwise(-F.col("ci_low"))
    margin = F.coalesce(F.col("delta"), F.col("rel_delta") * F.abs("mean_base"))
    decision = F.when(F.col("n").isNull() | (F.col("n") < F.col("min_n")), "inconclusive").when(hi < -margin, "regression").when(lo > margin, "improvement").when((margin > 0) & (lo >= -margin) & (hi <= margin), "equivalent").otherwise("inconclusive")
    return j.select("evaluator_key", "name", "n", F.round(margin, 9).alias("margin"), decision.alias("decision"))


def decide_points(values: DataFrame) -> DataFrame:
    """(metric, decision) for (metric, base, cand, direction, tolerance): relative change against a tolerance, no interval."""
    change = F.when(F.col("base") > 0, F.col("cand") / F.col("base") - 1)
    worse = F.when(F.col("direction") == "lower", change).otherwise(-change)
    decision = F.when(worse.isNull(), "inconclusive").when(worse > F.col("tolerance"), "regression").when(worse < -F.col("tolerance"), "improvement").otherwise("equivalent")
    return values.select("metric", F.round(change, 9).alias("change"), decision.alias("decision"))
