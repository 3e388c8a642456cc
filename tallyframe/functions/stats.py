"""Statistics as column expressions over grouped data, and the few that need a Python function.

Undefined is null, never 0 and never NaN. All are safe under ANSI mode.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z, MDE_FACTOR, RESAMPLES, BOOTSTRAP_BELOW = 1.959963984540054, 2.8, 2000, 5000


def mean(c: Column) -> Column:
    return F.avg(c)


def stdev(c: Column) -> Column:
    """Sample standard deviation; 0 for a single value, null for none."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def quantile(c: Column, q: float) -> Column:
    """Linear interpolation between order statistics (type 7)."""
    return F.percentile(c, F.lit(q))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson bounds of k of n, kept within [0, 1] and around k / n; (0, 1) for none."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / n, F.lit(Z * Z)
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), F.lit(Z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), F.least(p, centre - half)), F.least(F.lit(1.0), F.greatest(p, centre + half))
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))


def normal_interval(m: Column, s: Column, n: Column) -> tuple[Column, Column]:
    half = F.when(n >= 2, F.lit(Z) * s / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return m - half, m + half


def minimum_detectable_effect(s: Column, n: Column) -> Column:
    return F.when(n >= 2, F.lit(MDE_FACTOR) * s / F.sqrt(n.cast("double")))


def is_binary(c: Column) -> Column:
    return F.bool_and((c == 0) | (c == 1))


def bootstrap_interval(values: list[float], seed: int, resamples: int = RESAMPLES, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile bootstrap of the mean, seeded; values are sorted first, so that their order doesn't count."""
    rng, values = random.Random(seed), sorted(values)
    means = sorted(math.fsum(rng.choices(values, k=len(values))) / len(values) for _ in range(resamples))
    return means[math.floor(alpha / 2 * resamples)], means[math.ceil((1 - alpha / 2) * resamples) - 1]


def bootstrap_by(df: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    """(*keys, ci_low, ci_high) for groups of 2 to BOOTSTRAP_BELOW - 1 values; `seed` names a column of seeds."""
    sizes = Window.partitionBy(*keys)
    small = df.select(*keys, F.col(value).cast("double").alias("v"), F.col(seed).cast("string").alias("s")).withColumn("n", F.count("*").over(sizes)).where(f"n >= 2 and n < {BOOTSTRAP_BELOW}")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(g["v"].tolist(), int(g["s"].iloc[0]))
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in keys}, "ci_low": low, "ci_high": high}])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", ci_low double, ci_high double"
    return small.groupBy(*keys).applyInPandas(run, schema)


def mean_interval(df: DataFrame, keys: list[str], value: str, seed: str) -> DataFrame:
    """(*keys, n, ci_low, ci_high, ci_method): none below 2 values, bootstrap below BOOTSTRAP_BELOW, else normal."""
    v = F.col(value).cast("double")
    base = df.groupBy(*keys).agg(F.count(v).alias("n"), mean(v).alias("m"), stdev(v).alias("s"))
    low, high = normal_interval(F.col("m"), F.col("s"), F.col("n"))
    boot = bootstrap_by(df, keys, value, seed)
    joined = base.join(boot.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ci_low").alias("bl"), F.col("ci_high").alias("bh")), F.expr(" and ".join(f"`{k}` <=> `_{k}`" for k in keys)), "left")
    big = F.col("n") >= BOOTSTRAP_BELOW
    return joined.select(*keys, "n", F.when(big, low).otherwise(F.col("bl")).alias("ci_low"), F.when(big, high).otherwise(F.col("bh")).alias("ci_high"), F.when(big, "normal").when(F.col("n") >= 2, "bootstrap").otherwise("none").alias("ci_method"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank of each value within its group, ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(*keys, n, rho): null under 3 pairs or where one side doesn't vary."""
    if not keys:
        return spearman(df.withColumn("_all", F.lit(1)), ["_all"], x, y).drop("_all")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, keys, x, "_rx"), keys, y, "_ry")
    t = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_rx").alias("mx"), F.avg("_ry").alias("my"), F.avg(F.col("_rx") * F.col("_ry")).alias("mxy"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    rho = F.try_divide(F.col("mxy") - F.col("mx") * F.col("my"), F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)))
    return t.select(*keys, "n", F.when((F.col("n") >= 3) & rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact p of b against c discordant pairs; 1 for none."""

    def p(x: int, y: int) -> float:
        n, k = int(x + y), int(min(x, y))
        if n == 0:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(v - top) for v in logs))

    return pd.Series([p(x, y) for x, y in zip(b, c)])


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(*keys, n, agreed, kappa) of two label columns: null without pairs or where chance agreement is 1."""
    if not keys:
        return kappa(df.withColumn("_all", F.lit(1)), ["_all"], a, b).drop("_all")
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    sides = cells.select(*keys, F.col("_a").alias("label"), F.col("c").alias("x"), F.lit(0).alias("y"), F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0).alias("same")).unionByName(
        cells.select(*keys, F.col("_b").alias("label"), F.lit(0).alias("x"), F.col("c").alias("y"), F.lit(0).alias("same"))
    )
    labels = sides.groupBy(*keys, "label").agg(F.sum("x").cast("double").alias("x"), F.sum("y").cast("double").alias("y"), F.sum("same").alias("same"))
    t = labels.groupBy(*keys).agg(F.sum("x").alias("n"), F.sum("same").alias("agreed"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("agreed") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return t.select(*keys, F.col("n").cast("long").alias("n"), F.col("agreed").cast("long").alias("agreed"), F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("kappa"))
