"""Human reviews against evaluators, reviewers against each other, evaluators against each other.

reviews: (case_key, evaluator_key, sample, reviewer, verdict, created_at, seq). FAIL is the positive class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import hashing, stats

CALIBRATED_N, TAU = 30, 0.25


def majority(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_pass, n_fail, verdict): the majority, null at a tie."""
    t = reviews.groupBy(*keys).agg(F.count_if(F.col("verdict") == "PASS").alias("n_pass"), F.count_if(F.col("verdict") == "FAIL").alias("n_fail"))
    return t.withColumn("verdict", F.when(F.col("n_pass") > F.col("n_fail"), "PASS").when(F.col("n_fail") > F.col("n_pass"), "FAIL"))


def calibrate(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per evaluator: its verdicts (outcomes: case_key, evaluator_key, verdict) against the majority of random reviews.

    Excluded, in this order: only targeted reviews, tie, no verdict, uncertain. A reviewer's repeated
    reviews all count."""
    random = majority(reviews.where("sample = 'random'"), ["evaluator_key", "case_key"]).withColumnRenamed("verdict", "human")
    all_ = reviews.select("evaluator_key", "case_key").distinct()
    j = all_.join(random, ["evaluator_key", "case_key"], "left").join(outcomes.select("evaluator_key", "case_key", "verdict"), ["evaluator_key", "case_key"], "left")
    reason = F.when(F.col("n_pass").isNull(), "targeted_only").when(F.col("human").isNull(), "tie").when(F.col("verdict").isNull(), "no_verdict").when(F.col("verdict") == "UNCERTAIN", "uncertain")
    c = lambda cond: F.count_if(cond)
    ok, h, v = F.col("reason").isNull(), F.col("human") == "FAIL", F.col("verdict") == "FAIL"
    t = j.withColumn("reason", reason).groupBy("evaluator_key").agg(
        c(ok & h & v).alias("tp"), c(ok & ~h & v).alias("fp"), c(ok & h & ~v).alias("fn"), c(ok & ~h & ~v).alias("tn"), *[c(F.col("reason") == r).alias(f"excluded_{r}") for r in ("targeted_only", "tie", "no_verdict", "uncertain")]
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    low, high = stats.wilson(tp + tn, n)
    po = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    r = lambda x: F.round(x, 9)
    return t.select(
        "evaluator_key", n.cast("long").alias("n"), "tp", "fp", "fn", "tn", r(po).alias("accuracy"), r(low).alias("ci_low"), r(high).alias("ci_high"), r(F.try_divide(tp, F.nullif(tp + fp, F.lit(0.0)))).alias("precision"), r(F.try_divide(tp, F.nullif(tp + fn, F.lit(0.0)))).alias("recall"),
        r(F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))).alias("kappa"), (n < CALIBRATED_N).alias("uncalibrated"), "excluded_targeted_only", "excluded_tie", "excluded_no_verdict", "excluded_uncertain",
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Each reviewer's last verdict of each case and evaluator."""
    return reviews.groupBy("evaluator_key", "case_key", "reviewer").agg(F.max_by("verdict", F.struct("created_at", "seq")).alias("verdict"))


def reviewer_agreement(reviews: DataFrame) -> DataFrame:
    """Per evaluator over all unordered pairs of reviewers of a case: n, share of agreement, pooled kappa."""
    last = latest_reviews(reviews).where("verdict is not null")
    a, b = last.alias("a"), last.alias("b")
    pairs = a.join(b, (F.col("a.evaluator_key").eqNullSafe(F.col("b.evaluator_key"))) & (F.col("a.case_key") == F.col("b.case_key")) & (F.col("a.reviewer") < F.col("b.reviewer"))).select("a.evaluator_key", F.col("a.verdict").alias("va"), F.col("b.verdict").alias("vb"))
    t = stats.kappa(pairs, ["evaluator_key"], "va", "vb")
    return t.select("evaluator_key", "n", F.round(F.col("agreed") / F.col("n"), 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def review_queue(outcomes: DataFrame, reviews: DataFrame, strategy: str, n: int, seed: int = 0, disagreeing: DataFrame | None = None) -> DataFrame:
    """(case_key, evaluator_key, rank): unreviewed ok outcomes to review next, in the seeded order.

    random: all; stratified: n // 2 each of FAIL and PASS, failures first; uncertain: UNCERTAIN verdicts;
    disagreement: cases of `disagreeing`."""
    rows = outcomes.where("status = 'ok'").join(reviews.select("case_key", "evaluator_key").distinct(), ["case_key", "evaluator_key"], "left_anti")
    rows = rows.withColumn("_o", hashing.seeded_order(seed, F.col("case_key")))
    if strategy == "stratified":
        w = Window.partitionBy("verdict").orderBy("_o", "case_key", "evaluator_key")
        rows = rows.where("verdict in ('PASS', 'FAIL')").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n // 2)
        ranked = rows.orderBy("verdict", "_k")
    elif strategy in ("random", "uncertain", "disagreement"):
        if strategy == "uncertain":
            rows = rows.where("verdict = 'UNCERTAIN'")
        if strategy == "disagreement":
            rows = rows.join(disagreeing.select("case_key").distinct(), "case_key", "left_semi")
        ranked = rows.orderBy("_o", "case_key", "evaluator_key")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    top = ranked.limit(n)
    order = ["verdict", "_k"] if strategy == "stratified" else ["_o", "case_key", "evaluator_key"]
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("case_key", "evaluator_key", "rank")  # at most n rows


def disagreements(outcomes: DataFrame, tau: float = TAU) -> DataFrame:
    """(case_key, kind, evaluator_a, evaluator_b, score_gap) for outcomes (case_key, evaluator_key, is_judge, verdict, score).

    Per case the first pair of evaluators, in key order, with different confident verdicts; where there is
    none, every pair of judges whose scores differ by at least tau."""
    a, b = outcomes.alias("a"), outcomes.alias("b")
    pairs = a.join(b, (F.col("a.case_key") == F.col("b.case_key")) & (F.col("a.evaluator_key") < F.col("b.evaluator_key"))).select(
        F.col("a.case_key"), F.col("a.evaluator_key").alias("evaluator_a"), F.col("b.evaluator_key").alias("evaluator_b"), F.col("a.is_judge").alias("ja"), F.col("b.is_judge").alias("jb"), F.col("a.verdict").alias("va"), F.col("b.verdict").alias("vb"), F.abs(F.col("a.score") - F.col("b.score")).alias("gap")
    )
    confident = F.col("va").isin("PASS", "FAIL") & F.col("vb").isin("PASS", "FAIL") & (F.col("va") != F.col("vb"))
    w = Window.partitionBy("case_key").orderBy("evaluator_a", "evaluator_b")
    kind = F.when(F.col("ja") != F.col("jb"), "judge_vs_deterministic").otherwise("verdict_disagreement")
    first = pairs.where(confident).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("case_key", kind.alias("kind"), "evaluator_a", "evaluator_b", F.lit(None).cast("double").alias("score_gap"))
    scores = pairs.where(F.col("ja") & F.col("jb") & (F.col("gap") >= tau)).join(first.select("case_key"), "case_key", "left_anti").select("case_key", F.lit("score_gap").alias("kind"), "evaluator_a", "evaluator_b", F.round("gap", 9).alias("score_gap"))
    return first.unionByName(scores)


def disagreement_rate(outcomes: DataFrame, found: DataFrame) -> DataFrame:
    """One row: cases with two confident verdicts or more, disagreements, distinct disagreeing cases, and their rate among them."""
    confident = outcomes.where("verdict in ('PASS', 'FAIL')").groupBy("case_key").agg((F.count("*") >= 2).cast("int").alias("two"))
    per = confident.join(found.groupBy("case_key").agg(F.count("*").alias("found")), "case_key", "full_outer").select(F.coalesce("two", F.lit(0)).alias("two"), F.coalesce("found", F.lit(0)).alias("found"))
    hit = (F.col("found") > 0).cast("int")
    t = per.agg(F.coalesce(F.sum("two"), F.lit(0)).alias("comparable"), F.coalesce(F.sum("found"), F.lit(0)).alias("disagreements"), F.coalesce(F.sum(hit), F.lit(0)).alias("disagreeing_cases"), F.sum(hit * F.col("two")).alias("k"))
    return t.select("comparable", "disagreements", "disagreeing_cases", F.round(F.try_divide(F.col("k"), F.col("comparable")), 9).alias("rate"))


def judge_check(fixtures: DataFrame) -> DataFrame:
    """Accuracy per category of judged fixtures (category, expected, status, verdict); what could not be judged is wrong."""
    right = (F.col("status") == "ok") & (F.col("verdict") == F.col("expected"))
    t = fixtures.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("correct"), F.count_if(F.col("status") != "ok").alias("unjudgeable"))
    return t.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 9))


def check_reviews(reviews: DataFrame, evaluators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): exactly one subject, a known sample and verdict, an evaluator that belongs to the run, a score in [0, 1]."""
    one = F.col("evaluation_id").isNull() != F.col("case_result_id").isNull()
    good = one & F.col("sample").isin("random", "targeted") & (F.col("verdict").isNull() | F.col("verdict").isin("PASS", "FAIL")) & (F.col("score").isNull() | F.col("score").between(0, 1)) & F.coalesce(F.trim("reviewer") != "", F.lit(False))
    known = evaluators.select("evaluator_key").distinct().withColumn("_known", F.lit(True))
    rows = reviews.join(known, "evaluator_key", "left").withColumn("_ok", F.coalesce(good, F.lit(False)) & (F.col("evaluator_key").isNull() | F.col("_known").isNotNull())).drop("_known")
    return rows.where("_ok").drop("_ok"), rows.where("not _ok").drop("_ok")
