"""The ledger of external calls: usage, cost, cache, budget, retries.

attempts: (run_id, scope target|evaluator, case_key, evaluator_key, n, outcome, provider, model,
input_tokens, output_tokens, duration_ms, cache_hit, cost, retry_round). prices: (provider, model,
input_per_mtok, output_per_mtok). A cost that can't be known is null, never 0; a cache hit costs 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD_TOKENS, BREAKER, SYSTEMIC = 64, 10, 3


def price(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """attempts with cost and cost_status: cached, priced, unpriced (no price), no_usage (tokens unknown)."""
    p = prices.select(F.col("provider").alias("_provider"), F.col("model").alias("_model"), "input_per_mtok", "output_per_mtok")
    j = attempts.drop("cost").join(p, (F.col("provider") == F.col("_provider")) & (F.col("model") == F.col("_model")), "left")
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    status = F.when(F.col("cache_hit"), "cached").when(F.col("input_per_mtok").isNull(), "unpriced").when(~known, "no_usage").otherwise("priced")
    spent = (F.col("input_tokens") * F.col("input_per_mtok") + F.col("output_tokens") * F.col("output_per_mtok")) / F.lit(1e6)
    j = j.withColumn("cost_status", status)
    return j.withColumn("cost", F.when(F.col("cost_status") == "cached", 0.0).when(F.col("cost_status") == "priced", spent)).drop("_provider", "_model", "input_per_mtok", "output_per_mtok")


def attempt_stats(priced: DataFrame) -> DataFrame:
    """Per run, scope, provider and model: attempts, failures, retries, tokens, time, cache, cost."""
    hit = F.coalesce("cache_hit", F.lit(False))
    return priced.groupBy("run_id", "scope", "provider", "model").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("n") > 1).alias("retries"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("duration_ms"), 6).alias("duration_ms"), F.count_if(hit).alias("cache_hits"), F.count_if(F.col("cache_hit").isNotNull()).alias("lookups"), F.round(F.sum("cost"), 9).alias("cost"), F.count_if(F.col("cost_status") == "priced").alias("priced"),
        F.count_if(F.col("cost_status") == "unpriced").alias("unpriced"), F.count_if(F.col("cost_status") == "no_usage").alias("unknown_usage"), F.count_if(F.coalesce("retry_round", F.lit(0)) > 0).alias("retry_round_attempts"),
    )


def usage(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Per run: calls, hit rate, tokens per case, cost if anything is priced, and cost per 1000 cases if all of it is known."""
    s = lambda c: F.sum(c).alias(c)
    t = stats.groupBy("run_id").agg(*[s(c) for c in ("attempts", "failed", "retries", "input_tokens", "output_tokens", "cache_hits", "lookups", "cost", "priced", "unpriced", "unknown_usage")])
    complete = (F.col("unpriced") == 0) & (F.col("unknown_usage") == 0)
    cost = F.when(F.col("priced") + F.col("cache_hits") > 0, F.col("cost"))
    return t.join(totals, "run_id").select(
        "run_id", (F.col("attempts") - F.col("cache_hits")).alias("provider_calls"), F.round(F.try_divide(F.col("cache_hits"), F.col("lookups")), 9).alias("hit_rate"), "input_tokens", "output_tokens",
        F.round(F.try_divide(F.col("input_tokens") + F.col("output_tokens"), F.col("total")), 9).alias("tokens_per_case"), F.round(cost, 9).alias("cost"), complete.alias("cost_complete"), F.round(F.when(complete, F.try_divide(cost * 1000, F.col("total"))), 9).alias("cost_per_1k_cases"),
    )


def price_versions(attempts: DataFrame) -> DataFrame:
    return attempts.where("price_version is not null").select("run_id", "price_version").distinct()


def spend_totals(priced: DataFrame) -> DataFrame:
    return priced.groupBy("run_id").agg(F.count("*").alias("attempts"), F.count_if(~F.coalesce("cache_hit", F.lit(False))).alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"), F.round(F.sum("cost"), 9).alias("cost"))


def retry_stats(history: DataFrame) -> DataFrame:
    """history (run_id, case_key, evaluator_key, round): superseded failures per run, by stage, and the units they belong to."""
    unit = F.concat_ws("\t", "case_key", F.coalesce("evaluator_key", F.lit("")))
    return history.groupBy("run_id").agg(F.count_if(F.col("evaluator_key").isNull()).alias("case_failures"), F.count_if(F.col("evaluator_key").isNotNull()).alias("evaluator_failures"), F.countDistinct(unit).alias("units"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """cache (key, model, response, created_at): entries, bytes, oldest and newest per model."""
    return cache.groupBy("model").agg(F.count("*").alias("entries"), F.sum(F.octet_length("response")).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def call_bound(prompt: Column, max_tokens: int, input_per_mtok: float | None = None, output_per_mtok: float | None = None) -> Column:
    """Most tokens a call can use: a token per byte of the prompt and some overhead, and the answer's limit; or its cost."""
    inputs = F.octet_length(prompt) + OVERHEAD_TOKENS
    if input_per_mtok is None or output_per_mtok is None:
        return inputs + max_tokens
    return (inputs * input_per_mtok + max_tokens * output_per_mtok) / F.lit(1e6)


def budget_status(spend: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """Per run and limited quantity (calls, tokens, cost): limit, spent, remaining, exhausted."""
    rows = [F.struct(F.lit(k).alias("quantity"), F.lit(float(v)).alias("limit"), F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias("spent")) for k, v in sorted(limits.items()) if v is not None]
    t = spend.select("run_id", F.explode(F.array(*rows)).alias("b")).select("run_id", "b.*")
    return t.withColumn("remaining", F.greatest(F.lit(0.0), F.col("limit") - F.col("spent"))).withColumn("exhausted", F.col("spent") >= F.col("limit"))


def attempt_gaps(attempts: DataFrame) -> DataFrame:
    """Owners whose attempts are not numbered 1, 2, ... without gaps."""
    t = attempts.groupBy("run_id", "scope", "case_key", "evaluator_key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("count"), F.countDistinct("n").alias("distinct"))
    return t.where("lo <> 1 or hi <> count or distinct <> count")


def failure_streaks(attempts: DataFrame, keys: list[str], order: list[str], kind: str | None = None) -> DataFrame:
    """(*keys, streak, started): the longest run of failures in a row between successes, per group.

    Islands are numbered by the successes before them; with `kind`, only equal kinds count together."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("_island", F.sum((F.col("outcome") != "failed").cast("int")).over(w)).where("outcome = 'failed'")
    per = rows.groupBy(*keys, "_island", *([kind] if kind else [])).agg(F.count("*").alias("streak"), F.min(order[0]).alias("started"))
    best = Window.partitionBy(*keys).orderBy(F.desc("streak"), "started", *([kind] if kind else []))
    return per.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_island")


def breaker_open(attempts: DataFrame, threshold: int = BREAKER) -> DataFrame:
    return failure_streaks(attempts.where("failure_class = 'infrastructure' or outcome <> 'failed'"), ["run_id"], ["seq"]).where(F.col("streak") >= threshold)


def systemic(attempts: DataFrame, threshold: int = SYSTEMIC) -> DataFrame:
    """Providers and models with `threshold` failures of one kind and no success between."""
    return failure_streaks(attempts, ["run_id", "provider", "model"], ["seq"], "failure_kind").where(F.col("streak") >= threshold)


def resolve_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests (key, ...) with a cached response, and one request per key without. First writer wins."""
    first = cache.groupBy("key").agg(F.min_by("response", F.struct("created_at", "response")).alias("response"))
    return requests.join(first, "key"), requests.join(first, "key", "left_anti").dropDuplicates(["key"])


def run_status(counts: DataFrame, spend: DataFrame, retries: DataFrame, use: DataFrame) -> DataFrame:
    """One row per run with its cases, calls, cache, cost and retries."""
    return counts.join(spend.select("run_id", "attempts", "calls", "tokens"), "run_id", "left").join(use.select("run_id", "hit_rate", "cost", "cost_complete"), "run_id", "left").join(retries, "run_id", "left")
