"""Single evaluations: records judged by a rubric, one row each, stored and listed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import scorers
from tallyframe.sources.clients import ModelClient
from tallyframe.sources.store import FactStore


def evaluate(store: FactStore, records: DataFrame, rubric: scorers.Rubric, client: ModelClient, attempts: int = 2) -> DataFrame:
    """Judges records (id, prompt, output, ...) and stores them: ok rows have a score and a verdict, error rows have neither.

    The rubric's label is bound to its content first. Records that are stored already are not judged again."""
    store.bind_label(rubric.version, rubric.hash)
    todo = records if not store.exists("evaluations") else records.join(store.read("evaluations").select("id"), "id", "left_anti")
    spec = scorers.EvaluatorSpec("llm_judge", "single", {"rubric": rubric, "client": client, "validation_retries": attempts - 1})
    for c in ("context", "reference"):
        if c not in todo.columns:
            todo = todo.withColumn(c, F.lit(None).cast("string"))
    scored = scorers.score(todo.withColumnRenamed("id", "case_key"), spec)
    ok = F.col("outcome.status") == "ok"
    rows = scored.select(
        F.col("case_key").alias("id"), F.when(ok, "ok").otherwise("error").alias("status"), F.col("outcome.failure_kind").alias("error"), F.when(ok, F.try_element_at("outcome.metrics", F.lit("score"))).alias("overall_score"), F.when(ok, F.col("outcome.verdict")).alias("verdict"),
        F.lit(rubric.version).alias("rubric_version"),
    )
    batch = uuid.uuid4().hex
    store.append("evaluations", rows.withColumn("batch", F.lit(batch)))
    return store.read("evaluations").where(F.col("batch") == batch).drop("batch")


def get(store: FactStore, ident: str) -> DataFrame:
    return store.read("evaluations").where(F.col("id") == ident)
