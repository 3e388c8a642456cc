"""Command line over the stores: datasets, runs, summaries, comparison with gates, reports.

Exit codes: 0 done, 1 refused, 2 usage, 3 a gate failed, 4 inconclusive under --strict.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import accounting, agreement, compare, gates, ledger
from tallyframe.operators import integrity
from tallyframe.operators.scorers import Criterion, EvaluatorSpec, Rubric
from tallyframe.plans import judgecheck, report, runs, single
from tallyframe.plans.session import prepare
from tallyframe.sources import datasets, store


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tallyframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(rows: list[dict] | DataFrame) -> None:
    for r in [r.asDict() for r in rows.limit(1000).collect()] if isinstance(rows, DataFrame) else rows:
        print(json.dumps(r, default=str, ensure_ascii=False))


def load_function(name: str):
    """The function of `package.module:function`."""
    module, sep, function = name.partition(":")
    if not sep:
        raise ValueError("a function is named package.module:function")
    return getattr(importlib.import_module(module), function)


def load_evaluator(e: dict) -> EvaluatorSpec:
    """An evaluator of a configuration; a judge's client is a function without arguments, its rubric a table."""
    params = dict(e.get("params", {}))
    if e["kind"] == "llm_judge":
        params["client"] = load_function(params["client"])()
        rubric = dict(params["rubric"])
        criteria = tuple(Criterion(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()} | ({"scale": None} if "labels" in c else {})) for c in rubric.pop("criteria"))
        params["rubric"] = Rubric(criteria=criteria, **rubric)
    return EvaluatorSpec(e["kind"], e["name"], params).resolve()


def load_run(path: str) -> runs.RunConfig:
    c = store.load_config(path, {"run_id", "dataset", "target", "evaluators", "seed", "missing", "min_coverage", "wave", "max_calls", "max_tokens", "max_usd", "tokens_per_call", "breaker", "systemic"})
    t = dict(c.pop("target"))
    if "function" in t:
        t["function"] = load_function(t["function"])
    if "client" in t:
        t["client"] = load_function(t["client"])()
    specs = [load_evaluator(e) for e in c.pop("evaluators")]
    return runs.RunConfig(target=runs.Target(**t), specs=specs, **c)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyframe")
    p.add_argument("--root", default="tallyframe-data")
    p.add_argument("--prices", help="a price file, for costs and budgets of money")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", **v)

    verb("dataset-import", "name", "path")
    verb("dataset-list")
    verb("dataset-show", "ref", key={})
    verb("dataset-export", "ref", "path")
    verb("dataset-lint", "ref")
    verb("dataset-verify", "ref")
    verb("run-create", "config")
    verb("run-execute", "config")
    verb("run-retry", "config")
    verb("run-preflight", "config")
    verb("run-recover", "run_id")
    verb("run-list", status={})
    verb("run-status", "run_id")
    verb("run-failures", "run_id", failure_class={})
    verb("run-verify", "run_id")
    verb("run-show", "run_id")
    verb("run-tag", "run_id", "tag")
    verb("review-add", "path")
    verb("calibrate", "run_id")
    verb("queue", "run_id", strategy={"default": "random"}, n={"type": int, "default": 20})
    verb("disagreements", "run_id")
    verb("compare", "baseline", "candidate", gates={}, strict={"action": "store_true"}, allow_confounded={"action": "store_true"})
    verb("report", "run_id", "path", baseline={}, gates={})
    verb("judge-check", "config", "fixtures", least={"type": float, "default": 0.8})
    verb("evaluate", "config", "path")
    verb("evaluation-list", tag={}, limit={"type": int, "default": 50})
    verb("evaluation-show", "id")
    verb("cache-stats")
    verb("cache-clear")
    return p


class App:
    def __init__(self, spark: SparkSession, root: str, prices: str | None = None):
        self.spark = spark
        self.prices = store.load_prices(spark, prices) if prices else spark.createDataFrame([], "provider string, model string, input_per_mtok double, output_per_mtok double")
        self.datasets = datasets.DatasetStore(spark, f"{root}/datasets")
        self.facts = store.FactStore(spark, f"{root}/facts")
        self.controller = runs.Controller(spark, self.facts, store.EventLog(), self.prices if prices else None)

    def of(self, table: str, run_id: str, keys: list[str]) -> DataFrame:
        return self.controller.current(table, run_id, keys).withColumn("run_id", F.lit(run_id))

    def run_facts(self, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        run = self.facts.read("runs").where(F.col("id") == run_id).first()
        if run is None:
            raise LookupError(f"no run {run_id}")
        cases = self.datasets.cases(run["dataset"])
        keys = ["case_key", "evaluator_key"]
        return cases, self.of("case_results", run_id, ["case_key"]), self.of("evaluator_results", run_id, keys), self.of("metrics", run_id, [*keys, "name"])

    def attempts(self, run_id: str) -> DataFrame | None:
        return ledger.price(self.facts.read("attempts").where(F.col("run_id") == run_id), self.prices) if self.facts.exists("attempts") else None

    def summary(self, run_id: str) -> dict[str, DataFrame]:
        cases, cr, er, m = self.run_facts(run_id)
        totals = cases.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("total"))
        run = self.spark.createDataFrame([(run_id, self.controller.status(run_id), self.controller.facts(run_id)["pinned"])], "run_id string, status string, pinned boolean")
        return accounting.summarize(cr, er, m, totals, cases, run, self.attempts(run_id))

    def run_status(self, run_id: str) -> DataFrame:
        cases, cr, er, _ = self.run_facts(run_id)
        totals = cases.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("total"))
        counts = accounting.run_counts(cr, er, totals)
        priced = self.attempts(run_id)
        if priced is None:
            return counts
        return ledger.run_status(counts, ledger.spend_totals(priced), ledger.retry_stats(self.controller.history(run_id)), ledger.usage(ledger.attempt_stats(priced), totals))

    def baseline(self, ref: str, candidate: str) -> str:
        """A run's id, or for `tag:<tag>` the latest succeeded run with the tag on the candidate's dataset."""
        if not ref.startswith("tag:"):
            return ref
        if not self.facts.exists("run_tags"):
            raise LookupError("no run has a tag")
        last = self.facts.read("run_status").groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.min("at").alias("created_at"))
        of = self.facts.read("runs").select(F.col("id").alias("run_id"), F.col("dataset").alias("dataset_name")).join(last, "run_id")
        row = gates.resolve_baseline(of, self.facts.read("run_tags"), ref[4:], self.controller.facts(candidate)["dataset"], candidate).first()
        if row is None:
            raise LookupError(f"no succeeded run of this dataset has the tag {ref[4:]}")
        return row["run_id"]

    def comparison(self, a: str, b: str, allow: bool) -> dict[str, object]:
        """Everything a comparison tells, and the rows that gates read."""
        found = compare.check_comparable(self.controller.facts(a), self.controller.facts(b), allow)
        cases, cr_a, er_a, m_a = self.run_facts(a)
        other, cr_b, er_b, m_b = self.run_facts(b)
        out_a, out_b = compare.case_outcomes(cr_a, cases, a), compare.case_outcomes(cr_b, other, b)
        pairs = compare.pair(out_a, out_b)
        if pairs.isEmpty():
            raise ValueError("the runs have no case in common")
        values = compare.paired_values(pairs, m_a.unionByName(m_b), a, b).unionByName(compare.target_failure_values(pairs), allowMissingColumns=True)
        s, base = self.summary(b), self.summary(a)
        return {
            "confounders": [{"weight": k, "differs": ", ".join(v)} for k, v in found.items() if v], "unpaired": compare.unpaired(out_a, out_b), "paired": compare.paired_stats(values), "extremes": compare.extremes(values), "latency": compare.latency_compare(pairs),
            "gaps": compare.gaps(base["coverage"], s["coverage"]), "truncation": compare.truncation_gap(cr_a, cr_b), "summary": s, "base": base, "must_pass": gates.must_pass_failures(er_b),
        }

    def gated(self, got: dict, run_id: str, path: str, strict: bool) -> dict:
        g = gates.parse(store.load_config(path, {"gates", *[f for f in gates.Gates.__dataclass_fields__ if f not in ("metrics", "floors")]}))
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 - a row per evaluator or metric
        cut = got["summary"]["truncated"].first()
        return gates.evaluate(
            g.as_strict() if strict else g, rows(got["paired"]), rows(got["summary"]["metrics"]), rows(got["summary"]["coverage"]), rows(got["base"]["coverage"]), rows(got["must_pass"]),
            pinned=bool(self.controller.facts(run_id)["pinned"]), truncated_share=(cut["share"] or 0.0) if cut else 0.0,
        )

    def compare(self, a: str, b: str, path: str | None, strict: bool, allow: bool = False) -> int:
        got = self.comparison(self.baseline(a, b), b, allow)
        for part in ("confounders", "paired", "unpaired", "gaps", "truncation", "latency"):
            _show(got[part])
        if path is None:
            return 0
        result = self.gated(got, b, path, strict)
        print(json.dumps(result))
        return result["exit_code"]

    def report(self, run_id: str, path: str, baseline: str | None, gate_path: str | None) -> None:
        """Summary, slices, calls, warnings, failures; with a baseline the comparison and its gates; calibration where there are reviews."""
        cases, cr, er, _ = self.run_facts(run_id)
        sections: dict[str, object] = {f"Run: {k}": v for k, v in self.summary(run_id).items()}
        extremes = None
        if baseline:
            got = self.comparison(self.baseline(baseline, run_id), run_id, True)
            extremes = got["extremes"]
            sections |= {f"Comparison: {k}": got[k] for k in ("confounders", "unpaired", "paired", "extremes", "gaps", "truncation", "latency")}
            if gate_path:
                result = self.gated(got, run_id, gate_path, False)
                sections["Gates"] = [{"status": result["status"], "failure": None, "of": None}, *[{"status": "failed", "failure": k, "of": of} for k, of in result["failures"]], *[{"status": d, "failure": None, "of": k} for k, d in result["decisions"].items()]]
        if self.facts.exists("reviews"):
            reviews = self.facts.read("reviews")
            sections |= {"Calibration": agreement.calibrate(reviews, er), "Reviewers": agreement.reviewer_agreement(reviews)}
        sections["Disagreements"] = agreement.disagreement_rate(self._outcomes(run_id), self._disagreements(run_id))
        sections["Operations"] = self.run_status(run_id)
        run = self.facts.read("runs").where(F.col("id") == run_id).first()
        sections["Environment"] = [{"what": k, "value": v} for k, v in sorted(json.loads(run["environment"]).items())]
        chosen = report.case_selection(accounting.failures(cr, er), extremes, cases)
        report.write(path, report.render(f"Run {run_id}", sections, chosen.join(cases, "case_key").select("case_key", "why", "prompt", "reference")))

    def preflight(self, config: runs.RunConfig, cases: DataFrame) -> int:
        """What is missing, what the run can use at most, and what lint says; 1 if a budget can't hold the whole run."""
        _show(integrity.preflight(cases, {s.key: tuple(f for f in s.definition.requires if f != "output" or config.target.kind == "precomputed") for s in config.specs}))
        price = {r["model"]: (r["input_per_mtok"], r["output_per_mtok"]) for r in self.prices.collect()}  # a row per model of a price file
        calls = {}
        if config.target.paid:
            c = config.target.client
            calls["target"] = (runs._most_calls(c), config.tokens_per_call, *price.get(c.name, (None, None)))
        for s in config.judges:
            c = s.params["client"]
            calls[s.key] = ((1 + s.params["validation_retries"]) * runs._most_calls(c), s.params["max_tokens"], *price.get(c.name, (None, None)))
        most = integrity.call_plan(cases, calls)
        _show(most)
        _show(integrity.lint(cases))
        total = most.agg(F.sum("most_calls").alias("calls"), F.sum("most_tokens").alias("tokens"), F.sum("most_cost").alias("usd")).first()
        over = [k for k, limit in (("calls", config.max_calls), ("tokens", config.max_tokens), ("usd", config.max_usd)) if limit is not None and (total[k] or 0) > limit]
        _show([{"beyond_budget": over, "unpriced": sorted(k for k, v in calls.items() if v[2] is None)}])
        return 1 if over else 0

    def main(self, a: argparse.Namespace) -> int:
        v = a.verb
        if v == "dataset-import":
            m, created = self.datasets.import_jsonl(a.name, a.path)
            _show([{**m, "created": created}])
        elif v == "dataset-list":
            _show(self.datasets.datasets())
        elif v == "dataset-show":
            _show(self.datasets.case(a.ref, a.key) if a.key else [self.datasets.resolve(a.ref)])
        elif v == "dataset-export":
            _show([{"cases": self.datasets.export_jsonl(a.ref, a.path)}])
        elif v == "dataset-lint":
            _show(integrity.lint(self.datasets.cases(a.ref)))
        elif v == "dataset-verify":
            bad = self.datasets.verify(a.ref)
            _show([{"violations": bad}])
            return 1 if bad else 0
        elif v in ("run-create", "run-execute", "run-retry"):
            config = load_run(a.config)
            cases = self.datasets.cases(config.dataset)
            if v == "run-create":
                _show([{"identity_hash": self.controller.create(config, cases)}])
            else:
                _show([self.controller.execute(config, cases) if v == "run-execute" else self.controller.retry_failed(config, cases)])
        elif v == "run-preflight":
            config = load_run(a.config)
            return self.preflight(config, self.datasets.cases(config.dataset))
        elif v == "run-recover":
            self.controller.recover(a.run_id)
        elif v == "judge-check":
            c = store.load_config(a.config, {"evaluators", "run_id", "dataset", "target", "seed", "missing", "min_coverage", "wave", "max_calls", "max_tokens", "max_usd", "tokens_per_call", "breaker", "systemic"})
            fixtures, passed = judgecheck.load_fixtures(self.spark, a.fixtures), True
            for e in c["evaluators"]:
                if e["kind"] == "llm_judge":
                    per, _, ok = judgecheck.check_judge(fixtures, load_evaluator(e), a.least)
                    passed &= ok
                    _show(per)
            return 0 if passed else 3
        elif v == "evaluate":
            c = store.load_config(a.config, {"evaluators"})
            judge = next(load_evaluator(e) for e in c["evaluators"] if e["kind"] == "llm_judge")
            records = self.spark.read.schema("id string, prompt string, output string, context string, reference string").json(a.path)
            _show(single.evaluate(self.facts, records, judge.params["rubric"], judge.params["client"]))
        elif v == "evaluation-list":
            rows = self.facts.read("evaluations")
            _show(rows.orderBy("id").limit(a.limit) if a.tag is None and "created_at" not in rows.columns else store.list_evaluations(rows, a.tag, a.limit))
        elif v == "evaluation-show":
            _show(single.get(self.facts, a.id))
        elif v == "cache-clear":
            _show([{"removed": self.facts.drop("llm_cache")}])
        elif v == "run-list":
            status = self.facts.read("run_status").groupBy("run_id").agg(F.max_by("status", "at").alias("status"))
            _show(status if a.status is None else status.where(F.col("status") == a.status))
        elif v == "run-status":
            _show(self.run_status(a.run_id))
        elif v == "run-failures":
            _, cr, er, _ = self.run_facts(a.run_id)
            _show(accounting.list_failures(cr, er, a.failure_class))
        elif v == "run-verify":
            cases, cr, er, m = self.run_facts(a.run_id)
            run = self.spark.createDataFrame([(a.run_id, "v", self.controller.status(a.run_id))], "run_id string, dataset_version_id string, status string")
            keys = self.spark.createDataFrame([(a.run_id, k) for k in json.loads(self.facts.read("runs").where(F.col("id") == a.run_id).first()["evaluators"])], "run_id string, evaluator_key string")
            bad = integrity.verify_run(run, cases.withColumn("dataset_version_id", F.lit("v")), cr, er, m, self.attempts(a.run_id), self.controller.history(a.run_id), keys)
            _show(bad)
            return 0 if bad.isEmpty() else 1
        elif v == "run-show":
            for df in self.summary(a.run_id).values():
                _show(df)
        elif v == "run-tag":
            self.facts.replay("run_tags", self.spark.createDataFrame([(a.run_id, a.tag)], "run_id string, tag string"), ["run_id", "tag"])
        elif v == "review-add":
            reviews = self.spark.read.schema("case_key string, evaluator_key string, sample string, reviewer string, verdict string, score double, comment string, created_at string, seq bigint").json(a.path)
            known = self.facts.read("evaluator_results").select("evaluator_key")
            subject = reviews.withColumns({"case_result_id": F.col("case_key"), "evaluation_id": F.lit(None).cast("string")})
            _, bad = agreement.check_reviews(subject, known)
            if not bad.isEmpty():
                raise ValueError("a review lacks a reviewer or a subject, or has an unknown sample, verdict, score or evaluator")
            self.facts.append("reviews", reviews)
        elif v == "calibrate":
            _, _, er, _ = self.run_facts(a.run_id)
            _show(agreement.calibrate(self.facts.read("reviews"), er))
            _show(agreement.reviewer_agreement(self.facts.read("reviews")))
        elif v == "queue":
            _, _, er, _ = self.run_facts(a.run_id)
            reviews = self.facts.read("reviews") if self.facts.exists("reviews") else er.limit(0)
            _show(agreement.review_queue(er, reviews, a.strategy, a.n, disagreeing=self._disagreements(a.run_id)))
        elif v == "disagreements":
            _show(self._disagreements(a.run_id))
        elif v == "compare":
            return self.compare(a.baseline, a.candidate, a.gates, a.strict, a.allow_confounded)
        elif v == "report":
            self.report(a.run_id, a.path, a.baseline, a.gates)
        elif v == "cache-stats":
            _show(ledger.cache_stats(self.facts.read("llm_cache")))
        return 0

    def _outcomes(self, run_id: str) -> DataFrame:
        _, _, er, m = self.run_facts(run_id)
        score = m.where("name = 'score'").select("case_key", "evaluator_key", F.col("value").alias("score"))
        return er.where("status = 'ok'").join(score, ["case_key", "evaluator_key"], "left").withColumn("is_judge", F.col("evaluator_key").startswith("llm_judge:"))

    def _disagreements(self, run_id: str) -> DataFrame:
        return agreement.disagreements(self._outcomes(run_id))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return App(prepare(spark or _spark()), a.root, a.prices).main(a)
    except (ValueError, LookupError, FileExistsError, RuntimeError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
