"""Checks a judge against fixtures whose verdicts are known, before it is trusted with a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import strictjson
from tallyframe.operators import agreement, integrity, scorers

FIELDS = ("id", "category", "prompt", "output", "context", "reference", "expected")
#: Fixtures that are judged first: if all of them fail for a reason that passes for no one, the rest is not tried.
PROBE = 3


def load_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, prompt, output, context, reference, expected) of a JSONL file of fixtures, a few hundred at most.

    Strict: known fields only, an id once, a category, a prompt, an output, and PASS or FAIL as what is expected."""
    rows, seen = [], set()
    with open(path, encoding="utf-8") as f:
        for no, line in enumerate(f, 1):
            if not line.strip():
                continue
            v = strictjson.loads(line)
            if not isinstance(v, dict) or v.keys() - set(FIELDS) or any(not isinstance(v.get(k), str) or not v[k] for k in ("id", "category", "prompt", "output")) or v.get("expected") not in ("PASS", "FAIL") or v["id"] in seen:
                raise ValueError(f"line {no}: not a fixture: {json.dumps(v)[:120]}")
            seen.add(v["id"])
            rows.append(tuple(v.get(k) for k in FIELDS))
    if not rows:
        raise ValueError("no fixtures")
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in FIELDS))


def check_judge(fixtures: DataFrame, spec: scorers.EvaluatorSpec, least: float = 0.8) -> tuple[DataFrame, DataFrame, bool]:
    """(per category, outcomes, passed): accuracy of a judge per category; passed if every category reaches `least`.

    A few fixtures are judged first; raises if each of them fails for a systemic reason."""
    cases = fixtures.withColumnRenamed("id", "case_key")
    systemic = [k for _, k, _, s, _ in integrity.TAXONOMY if s]
    keys = [r["case_key"] for r in cases.select("case_key").orderBy("case_key").limit(PROBE).collect()]
    judge = lambda df: [(r["case_key"], r["outcome"]["status"], r["outcome"]["failure_kind"], r["outcome"]["verdict"]) for r in scorers.judge_calls(df, spec).select("case_key", "outcome").collect()]  # noqa: E731 - a row per fixture
    first = judge(cases.where(F.col("case_key").isin(keys)))
    if all(status == "failed" and kind in systemic for _, status, kind, _ in first):
        raise RuntimeError(f"the judge can't be called: {first[0][2]}")
    rows = first + judge(cases.where(~F.col("case_key").isin(keys)))
    judged = cases.sparkSession.createDataFrame(rows, "case_key string, status string, failure_kind string, verdict string")
    outcomes = cases.select("case_key", "category", "expected").join(judged, "case_key")
    per = agreement.judge_check(outcomes)
    return per, outcomes, all(r["accuracy"] >= least for r in per.collect())  # a row per category
