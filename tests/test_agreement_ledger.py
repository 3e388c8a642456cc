import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import agreement, compare, integrity, ledger


def test_calibration_confusion(spark):
    rng = random.Random(6)
    pairs = [(rng.choice(["PASS", "FAIL"]), rng.choice(["PASS", "PASS", "FAIL"])) for _ in range(37)]
    count = Counter(pairs)  # (judge, reviewer); a failure is what is to be found
    outcomes = [(f"k{i}", "j", v) for i, (v, _) in enumerate(pairs)] + [("vague", "j", "UNCERTAIN"), ("void", "j", None)]
    reviews = [(f"k{i}", "j", "random", f"w{i % 3}", v, 1, i) for i, (_, v) in enumerate(pairs)]
    reviews += [("vague", "j", "random", "w1", "FAIL", 1, 90), ("void", "j", "random", "w2", "PASS", 1, 91), ("picked", "j", "targeted", "w1", "FAIL", 1, 92), ("k4", "j", "targeted", "w2", "PASS", 1, 93), ("split", "j", "random", "w1", "FAIL", 1, 94), ("split", "j", "random", "w2", "PASS", 1, 95)]
    outcomes = spark.createDataFrame(outcomes, "case_key string, evaluator_key string, verdict string")
    reviews = spark.createDataFrame(reviews, "case_key string, evaluator_key string, sample string, reviewer string, verdict string, created_at int, seq int")
    r = agreement.calibrate(reviews, outcomes).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (count["FAIL", "FAIL"], count["FAIL", "PASS"], count["PASS", "FAIL"], count["PASS", "PASS"]) and r["n"] == 37
    assert r["accuracy"] == pytest.approx(sum(a == b for a, b in pairs) / 37)
    assert (r["excluded_targeted_only"], r["excluded_tie"], r["excluded_no_verdict"], r["excluded_uncertain"]) == (1, 1, 1, 1)
    assert agreement.calibrate(reviews.limit(0), outcomes).count() == 0


def test_last_verdict_counts_for_agreement(spark):
    reviews = spark.createDataFrame([("a", "j", "x", "PASS", 1, 1), ("a", "j", "x", "FAIL", 2, 2), ("a", "j", "y", "FAIL", 1, 3)], "case_key string, evaluator_key string, reviewer string, verdict string, created_at int, seq int")
    r = agreement.reviewer_agreement(reviews).first()
    assert (r["n"], r["agreement"], r["kappa"]) == (1, 1.0, None)


def test_disagreements_in_key_order(spark):
    rows = [("1", "a", False, "PASS", 1.0), ("1", "b", True, "FAIL", 0.0), ("1", "c", True, "FAIL", 0.9), ("2", "b", True, "PASS", 0.9), ("2", "c", True, "PASS", 0.5), ("3", "b", True, "UNCERTAIN", None), ("3", "c", True, "FAIL", 0.1)]
    df = spark.createDataFrame(rows, "case_key string, evaluator_key string, is_judge boolean, verdict string, score double")
    got = {(r["case_key"], r["kind"], r["evaluator_a"], r["evaluator_b"], r["score_gap"]) for r in agreement.disagreements(df).collect()}
    assert got == {("1", "judge_vs_deterministic", "a", "b", None), ("2", "score_gap", "b", "c", 0.4)}
    rate = agreement.disagreement_rate(df, agreement.disagreements(df)).first()
    assert (rate["comparable"], rate["disagreeing_cases"], rate["rate"]) == (2, 2, 1.0)


def test_review_queue_is_nested_and_unreviewed(spark):
    outcomes = spark.createDataFrame([(f"c{i}", "j", "ok", "FAIL" if i % 4 == 0 else "PASS") for i in range(40)], "case_key string, evaluator_key string, status string, verdict string")
    reviews = outcomes.where("case_key = 'c3'")
    keys = lambda n: [r["case_key"] for r in agreement.review_queue(outcomes, reviews, "random", n, 5).orderBy("rank").collect()]
    assert keys(5) == keys(10)[:5] and "c3" not in keys(39)
    q = agreement.review_queue(outcomes, reviews, "stratified", 6).join(outcomes.select("case_key", "verdict"), "case_key").orderBy("rank").collect()
    assert [r["verdict"] for r in q] == ["FAIL"] * 3 + ["PASS"] * 3
    with pytest.raises(ValueError):
        agreement.review_queue(outcomes, reviews, "best", 3)


ATTEMPT = "seq int, run_id string, scope string, case_key string, evaluator_key string, n int, outcome string, failure_class string, failure_kind string, provider string, model string, input_tokens int, output_tokens int, duration_ms double, cache_hit boolean, retry_round int"


def attempts(spark, rows):
    base = {"run_id": "r", "scope": "target", "case_key": "c", "evaluator_key": None, "n": 1, "outcome": "ok", "failure_class": None, "failure_kind": None, "provider": "p", "model": "m", "input_tokens": 1_000_000, "output_tokens": 0, "duration_ms": 1.0, "cache_hit": False, "retry_round": 0}
    return spark.createDataFrame([(i, *(base | r).values()) for i, r in enumerate(rows)], ATTEMPT)


def test_unknown_cost_is_null_and_a_hit_is_free(spark):
    prices = spark.createDataFrame([("p", "m", 2.0, 4.0)], "provider string, model string, input_per_mtok double, output_per_mtok double")
    df = ledger.price(attempts(spark, [{}, {"model": "x"}, {"input_tokens": None}, {"cache_hit": True, "model": "x"}]), prices)
    assert [(r["cost_status"], r["cost"]) for r in df.orderBy("seq").collect()] == [("priced", 2.0), ("unpriced", None), ("no_usage", None), ("cached", 0.0)]
    use = ledger.usage(ledger.attempt_stats(df), spark.createDataFrame([("r", 10)], "run_id string, total bigint")).first()
    assert use["provider_calls"] == 3 and use["cost"] == 2.0 and not use["cost_complete"] and use["cost_per_1k_cases"] is None


def test_breaker_and_systemic_rule(spark):
    down = {"outcome": "failed", "failure_class": "infrastructure", "failure_kind": "timeout"}
    assert ledger.breaker_open(attempts(spark, [down] * 10)).count() == 1
    assert ledger.breaker_open(attempts(spark, [down] * 5 + [{}] + [down] * 9)).count() == 0
    auth = down | {"failure_kind": "auth"}
    assert ledger.systemic(attempts(spark, [auth, auth, down, auth])).first()["streak"] == 3
    assert ledger.systemic(attempts(spark, [auth, auth, {}, auth])).count() == 0


def test_attempts_are_numbered_without_gaps(spark):
    df = attempts(spark, [{"n": 1}, {"n": 2}, {"case_key": "d", "n": 2}, {"case_key": "e", "n": 1}, {"case_key": "e", "n": 3}])
    assert {r["case_key"] for r in ledger.attempt_gaps(df).collect()} == {"d", "e"}


def test_null_hash_never_pairs(spark):
    rows = [("a", None, "complete", None, 1.0), ("b", "h", "complete", None, 1.0), ("c", "h2", "complete", None, 1.0)]
    df = spark.createDataFrame(rows, "case_key string, input_hash string, status string, failure_class string, duration_ms double")
    assert {r["case_key"] for r in compare.pair(df, df).collect()} == {"b", "c"}
    u = compare.unpaired(df, df.where("case_key <> 'c'").withColumn("input_hash", F.lit("h"))).first()
    assert tuple(u) == (1, 1, 1, 0)


def test_decisions(spark):
    paired = spark.createDataFrame([("e", m, n, 1.0, lo, hi) for m, n, lo, hi in (("worse", 50, -0.3, -0.2), ("better", 50, 0.2, 0.3), ("same", 50, -0.05, 0.05), ("open", 50, -0.2, 0.05), ("few", 5, -0.3, -0.2))], "evaluator_key string, name string, n int, mean_base double, ci_low double, ci_high double")
    gates = paired.select("evaluator_key", "name", F.lit("higher").alias("direction"), F.lit(0.1).alias("delta"), F.lit(None).cast("double").alias("rel_delta"), F.lit(30).alias("min_n"))
    got = {r["name"]: r["decision"] for r in compare.decide(paired, gates).collect()}
    assert got == {"worse": "regression", "better": "improvement", "same": "equivalent", "open": "inconclusive", "few": "inconclusive"}


def test_taxonomy_is_closed(spark):
    t = integrity.taxonomy(spark)
    assert t.count() == 26 and t.where("failure_class = 'target' and stage <> 'case'").count() == 0
    df = spark.createDataFrame([("infrastructure", "timeout", 0), ("infrastructure", "timeout", 3), ("target", "exception", 0)], "c string, k string, r int")
    assert [r[0] for r in df.select(integrity.retry_eligible(F.col("c"), F.col("k"), F.col("r"))).collect()] == [True, False, False]
