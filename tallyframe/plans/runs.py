"""Runs: plan, targets, evaluators, waves, recovery and retries, as DataFrames over append-only facts.

Stages that cost nothing run as one plan over all owed units. Targets and judges that call a model run
in waves: before each wave the attempts say what is spent, and the wave is cut so that its worst
case stays within the budgets of calls, tokens and money; between waves the breaker and the systemic
rule look at it.

What a stage makes is written once, calls and all: `case_results` by targets, `scored` by evaluators.
Attempts, evaluator results, metrics and cached responses are derived from these rows, each only if it is
not there yet. So nothing is called twice, and a run that stopped anywhere goes on where it was.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import platform
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import hashing
from tallyframe.operators import integrity, ledger, scorers
from tallyframe.sources.clients import CALL, ModelClient, failure_of, timed_call
from tallyframe.sources.store import EventLog, FactStore, check_transition

MAX_META = 4096
CASE_RESULT = f"case_key string, status string, output string, target_meta string, retrieved array<string>, failure_class string, failure_kind string, duration_ms double, attempts array<{CALL}>"
CASE_FIELDS = ["case_key", "status", "output", "target_meta", "retrieved", "failure_class", "failure_kind", "duration_ms", "attempts"]


def plan(cases: DataFrame, case_results: DataFrame | None, seed: int) -> DataFrame:
    """The cases without a result, with their processing order."""
    rows = cases if case_results is None else cases.join(case_results.select("case_key"), "case_key", "left_anti")
    return rows.withColumn("ord", hashing.seeded_order(seed, F.col("case_key")))


def units_owed(cases: DataFrame, case_results: DataFrame, evaluator_results: DataFrame, n_evaluators: int, seed: int, max_rounds: int = 0) -> DataFrame:
    """(case_key, phase, ord): ended cases with too few evaluator results, retryable failures, then pending and new cases."""
    done = evaluator_results.groupBy("case_key").agg(F.count("*").alias("e"))
    j = cases.select("case_key").join(case_results.select("case_key", "status", "failure_class", "failure_kind", F.coalesce("retry_round", F.lit(0)).alias("round")), "case_key", "left").join(done, "case_key", "left")
    retry = F.coalesce(integrity.retry_eligible(F.col("failure_class"), F.col("failure_kind"), F.col("round"), max_rounds), F.lit(False))
    phase = F.when((F.col("status") == "failed") & retry, "retry").when(F.col("status").isin("complete", "failed") & (F.coalesce("e", F.lit(0)) < n_evaluators), "recovery").when(F.coalesce("status", F.lit("pending")) == "pending", "pending")
    return j.withColumn("phase", phase).where("phase is not null").select("case_key", "phase", hashing.seeded_order(seed, F.col("case_key")).alias("ord"))


# targets


@dataclass(frozen=True)
class Target:
    """kind: precomputed (the case's own output), reuse (another run's results), callable, model (a template and a client)."""

    kind: str
    name: str
    function: Callable | None = None
    client: ModelClient | None = None
    template: str = "{prompt}"
    source_run: str | None = None
    pinned: bool = True
    max_output_bytes: int = 256 << 10

    @property
    def paid(self) -> bool:
        return self.kind == "model"


def _checked(row: dict, limit: int) -> dict:
    """A target's answer if it keeps the contract: a text, or {output, meta, retrieved}."""
    out = row.pop("answer")
    meta = retrieved = bad = None
    if isinstance(out, dict):
        out, meta, retrieved = out.get("output"), out.get("meta"), out.get("retrieved")
    if not isinstance(out, str):
        bad = "contract_violation"
    elif not out:
        bad = "empty_output"
    elif len(out.encode()) > limit or meta is not None and len(json.dumps(meta, ensure_ascii=False).encode()) > MAX_META:
        bad = "contract_violation"
    elif retrieved is not None and not (isinstance(retrieved, list) and all(isinstance(x, str) and x for x in retrieved)):
        bad = "contract_violation"
    if bad:
        return row | {"status": "failed", "failure_class": "target", "failure_kind": bad}
    return row | {"status": "complete", "output": out, "target_meta": json.dumps(meta, ensure_ascii=False) if meta is not None else None, "retrieved": retrieved}


def target_stage(cases: DataFrame, target: Target, source_results: DataFrame | None = None) -> DataFrame:
    """One result per case, with its calls. A target sees a case's key, prompt and context, and nothing else of it."""
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    if target.kind == "precomputed":
        ok = F.col("output").isNotNull()
        return cases.select(
            "case_key", F.when(ok, "complete").otherwise("failed").alias("status"), "output", none("target_meta"), none("retrieved", "array<string>"), F.when(~ok, "input").alias("failure_class"), F.when(~ok, "missing_field").alias("failure_kind"), none("duration_ms", "double"),
            none("attempts", f"array<{CALL}>"),
        )
    if target.kind == "reuse":
        rows = source_results.select(*[c for c in CASE_FIELDS if c != "attempts"], none("attempts", f"array<{CALL}>"))
        return cases.select("case_key").join(rows, "case_key")
    function, client, template, limit = target.function, target.client, target.template, target.max_output_bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                t0, calls = time.monotonic(), []
                row = dict.fromkeys(CASE_FIELDS) | {"case_key": r["case_key"], "attempts": calls}
                view = {k: hashing._plain(r[k]) for k in ("case_key", "prompt", "context")}
                try:
                    if client is None:
                        row = _checked({**row, "answer": function(view)}, limit)
                    else:
                        got = timed_call(client, {"prompt": template.format(**{k: v or "" for k, v in view.items()})}, calls)
                        if got.get("error_code"):
                            c, k = failure_of(got["error_code"])
                            row |= {"status": "failed", "failure_class": c, "failure_kind": k}
                        else:
                            meta = {"stop_reason": got.get("stop_reason"), "truncated": got.get("stop_reason") in ("max_tokens", "length"), "usage": {k: got.get(k) for k in ("input_tokens", "output_tokens")}}
                            row = _checked({**row, "answer": {"output": got.get("text"), "meta": meta, "retrieved": got.get("retrieved")}}, limit)
                except Exception:  # noqa: BLE001 - whatever a target raises is its failure
                    row |= {"status": "failed", "failure_class": "target", "failure_kind": "exception"}
                out.append(row | {"duration_ms": (time.monotonic() - t0) * 1000})
            yield pd.DataFrame(out, columns=CASE_FIELDS)

    return cases.select("case_key", "prompt", "context").mapInPandas(run, CASE_RESULT)


SCORED = ["case_key", "evaluator_key", "outcome", "attempts", "cache_key", "response"]


def merged_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The complete cases as evaluators see them: the target's output, meta and ranking in place of the case's own."""
    ranked = [F.col("retrieved").alias("_ranked")] if "retrieved" in results.columns else [F.lit(None).cast("array<string>").alias("_ranked")]
    done = results.where("status = 'complete'").select("case_key", "output", "target_meta", *ranked)
    rows = cases.drop("output", "target_meta").join(done, "case_key")
    own = F.col("retrieved") if "retrieved" in cases.columns else F.lit(None).cast("array<string>")
    return rows.withColumn("retrieved", F.coalesce("_ranked", own)).drop("_ranked")


def free_scores(merged: DataFrame, specs: list[scorers.EvaluatorSpec], missing: str) -> DataFrame:
    """(case_key, evaluator_key, outcome, ...) of evaluators that call no model."""
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    return scorers.score_all(merged, specs, missing).select("case_key", "evaluator_key", "outcome", none("attempts", f"array<{CALL}>"), none("cache_key"), none("response"))


#: Classes of evaluator failures that are not the evaluator's own (fixed values).
_CLASS = {k: c for c, k, _, _, stage in integrity.TAXONOMY if stage in ("both", "evaluator") and c in ("input", "infrastructure") and k != "internal_error"}


def results_of(scored: DataFrame) -> DataFrame:
    """Evaluator results of scored rows. Column scorers of one scan have no time of their own per row."""
    o = F.col("outcome")
    classes = F.create_map(*[F.lit(x) for kv in sorted(_CLASS.items()) for x in kv])
    failure = F.when(o["status"] == "failed", F.coalesce(F.try_element_at(classes, o["failure_kind"]), F.lit("evaluator")))
    ms = F.aggregate(F.coalesce("attempts", F.array().cast(f"array<{CALL}>")), F.lit(0.0), lambda a, x: a + F.coalesce(x["duration_ms"], F.lit(0.0)))
    return scored.select("case_key", "evaluator_key", o["status"].alias("status"), failure.alias("failure_class"), o["failure_kind"].alias("failure_kind"), o["verdict"].alias("verdict"), o["detail"].alias("detail"), F.when(F.size("attempts") > 0, ms).alias("duration_ms"))


def skipped_of(failed: DataFrame, specs: list[scorers.EvaluatorSpec]) -> DataFrame:
    """Evaluator results of failed cases: every evaluator skips them."""
    keys = F.explode(F.array(*[F.lit(s.key) for s in specs]))
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    return failed.select("case_key", keys.alias("evaluator_key"), F.lit("skipped").alias("status"), none("failure_class"), none("failure_kind"), none("verdict"), none("detail"), none("duration_ms", "double"))


# the run


@contextlib.contextmanager
def run_lock(root: str, run_id: str) -> Iterator[None]:
    """One executor of a run at a time on this driver."""
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{run_id}.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise RuntimeError(f"run {run_id} is being executed") from None
        yield


def environment(spark: SparkSession) -> dict:
    """What a run was executed with."""
    import numpy
    import pyarrow

    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")}
    return {"python": platform.python_version(), "spark": spark.version, "platform": sys.platform, "machine": platform.machine(), "numpy": numpy.__version__, "pandas": pd.__version__, "pyarrow": pyarrow.__version__, "executors": spark.sparkContext.defaultParallelism, **conf}


@dataclass(frozen=True)
class Budget:
    """Limits over all calls of a run, targets' and judges'. A call that is yet to come counts with the most it can use."""

    calls: int | None = None
    tokens: int | None = None
    usd: float | None = None
    tokens_per_call: int = 8192


@dataclass
class RunConfig:
    run_id: str
    dataset: str
    target: Target
    specs: list[scorers.EvaluatorSpec]
    seed: int = 0
    missing: str = "fail"
    min_coverage: float = 0.95
    wave: int = 1000
    max_calls: int | None = None
    max_tokens: int | None = None
    max_usd: float | None = None
    tokens_per_call: int = 8192
    breaker: int = ledger.BREAKER
    systemic: int = ledger.SYSTEMIC
    extra: dict = field(default_factory=dict)

    @property
    def budget(self) -> Budget:
        return Budget(self.max_calls, self.max_tokens, self.max_usd, self.tokens_per_call)

    @property
    def judges(self) -> list[scorers.EvaluatorSpec]:
        return [s for s in self.specs if s.kind == "llm_judge"]

    @property
    def free(self) -> list[scorers.EvaluatorSpec]:
        return [s for s in self.specs if s.kind != "llm_judge"]

    def hashes(self) -> tuple[str, str]:
        identity = {"dataset": self.dataset, "target": {"kind": self.target.kind, "name": self.target.name, "template": self.target.template}, "evaluators": sorted(s.key for s in self.specs), "missing": self.missing, "seed": self.seed}
        execution = {"wave": self.wave, "max_calls": self.max_calls, "max_tokens": self.max_tokens, "max_usd": self.max_usd, "breaker": self.breaker, "extra": self.extra}
        return hashing.run_hashes(identity, execution)


def _most_calls(client: object) -> int:
    """Calls that one request to a client can become."""
    policy = getattr(client, "policy", None)
    return policy.attempts if policy is not None else _most_calls(client.client) if hasattr(client, "client") else 1


class Controller:
    """Creates, executes, resumes and retries runs over a FactStore. prices: (provider, model, input_per_mtok, output_per_mtok)."""

    def __init__(self, spark: SparkSession, store: FactStore, events: EventLog | None = None, prices: DataFrame | None = None):
        self.spark, self.store, self.events, self.prices = spark, store, events or EventLog(), prices

    def create(self, config: RunConfig, cases: DataFrame) -> str:
        """Checks the run against its cases and freezes its configuration; gives the identity hash."""
        if not config.specs:
            raise ValueError("a run has at least one evaluator")
        keys = [s.key for s in config.specs]
        if len(set(keys)) != len(keys):
            raise ValueError("an evaluator is listed twice")
        if config.max_usd is not None:
            clients = [config.target.client] * config.target.paid + [s.params["client"] for s in config.judges]
            unpriced = sorted({c.name for c in clients} - {m for _, m, _ in self._prices()})
            if unpriced:
                raise ValueError(f"a budget of money needs prices of {unpriced}")
        missing = integrity.preflight(cases, {s.key: tuple(f for f in s.definition.requires if f != "output" or config.target.kind == "precomputed") for s in config.specs})
        bad = missing.where("missing = total and total > 0").collect()  # a row per evaluator and field
        if bad:
            raise ValueError(f"no case has {bad[0]['field']}, which {bad[0]['evaluator_key']} needs")
        identity, execution = config.hashes()
        facts = {"evaluator_params": sorted(keys), "scoring_version": sorted({s.definition.version for s in config.specs}), "endpoints": sorted({s.params["client"].name for s in config.judges}), "validation_retries": sorted({s.resolve().params["validation_retries"] for s in config.judges})}
        facts |= {"dataset": config.dataset, "target": config.target.name, "policy": [config.missing, config.min_coverage], "timeouts": config.extra.get("timeouts")}
        row = (config.run_id, config.dataset, config.target.name, config.target.pinned, json.dumps(keys), identity, execution, json.dumps(environment(self.spark)), json.dumps(facts, sort_keys=True))
        self.store.append("runs", self.spark.createDataFrame([row], "id string, dataset string, target_name string, pinned boolean, evaluators string, identity_hash string, exec_hash string, environment string, facts string"))
        self._status(config.run_id, "created", None)
        return identity

    def facts(self, run_id: str) -> dict:
        """What was frozen when the run was created."""
        row = self.store.read("runs").where(F.col("id") == run_id).first()
        if row is None:
            raise LookupError(f"no run {run_id}")
        return {**json.loads(row["facts"]), "pinned": row["pinned"], "dataset": row["dataset"]}

    def _prices(self) -> list[tuple[str, str, float]]:
        """(provider, model, the dearer price of a million tokens) of the price list."""
        if self.prices is None:
            return []
        return [(r["provider"], r["model"], max(r["input_per_mtok"], r["output_per_mtok"])) for r in self.prices.collect()]  # a row per model of a price file

    def _status(self, run_id: str, status: str, reason: str | None, retry_of: str | None = None) -> None:
        if status != "created":
            check_transition(self.status(run_id), status, retry_of)
        self.store.append("run_status", self.spark.createDataFrame([(run_id, status, reason, time.time_ns())], "run_id string, status string, stop_reason string, at bigint"))
        self.events.emit("status", run_id=run_id, status=status, stop_reason=reason)

    def status(self, run_id: str) -> str:
        return self.store.read("run_status").where(F.col("run_id") == run_id).agg(F.max_by("status", "at")).first()[0]

    def recover(self, run_id: str) -> None:
        """Marks a run whose execution broke off as partial, so that it can go on; refused while it is executed."""
        with run_lock(f"{self.store.root}/locks", run_id):
            if self.status(run_id) == "running":
                self._status(run_id, "partial", "interrupted")

    def current(self, table: str, run_id: str, keys: list[str]) -> DataFrame:
        """A run's latest rows: of every unit that of its last round."""
        rows = self.store.read(table).where(F.col("run_id") == run_id)
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "retry_round").alias("r")).select(*keys, "r.*")

    def _of(self, table: str, run_id: str, round_: int | None = None) -> DataFrame | None:
        if not self.store.exists(table):
            return None
        rows = self.store.read(table).where(F.col("run_id") == run_id)
        return rows if round_ is None else rows.where(F.col("retry_round") == round_)

    def _add(self, table: str, run_id: str, round_: int, rows: DataFrame, keys: list[str]) -> None:
        """Adds the rows that the run's round does not have yet."""
        have = self._of(table, run_id, round_)
        if have is not None:
            rows = rows.join(have.select(*keys), keys, "left_anti")
        self.store.append(table, rows.withColumns({"run_id": F.lit(run_id), "retry_round": F.lit(round_)}))

    def _derive_attempts(self, run_id: str, round_: int, table: str, scope: str) -> None:
        rows = self._of(table, run_id, round_)
        if rows is None:
            return
        owner = ["scope", "case_key", "evaluator_key"]
        key = F.col("evaluator_key") if scope == "evaluator" else F.lit("")
        calls = rows.where("size(attempts) > 0").select(F.lit(scope).alias("scope"), "case_key", key.alias("evaluator_key"), F.explode("attempts").alias("a")).select(*owner, "a.*")
        before = self._of("attempts", run_id)
        if before is not None:  # numbers go on where earlier rounds ended
            last = before.where((F.col("scope") == scope) & (F.col("retry_round") < round_)).groupBy(*owner).agg(F.max("n").alias("_last"))
            calls = calls.join(last, owner, "left").withColumn("n", (F.col("n") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
        self._add("attempts", run_id, round_, calls, [*owner, "n"])

    def derive(self, config: RunConfig, cases: DataFrame, round_: int) -> None:
        """Attempts, evaluator results, metrics and cached responses of what the stages wrote, as far as they lack."""
        run_id = config.run_id
        self._derive_attempts(run_id, round_, "case_results", "target")
        failed = self._of("case_results", run_id, round_)
        scored = self._of("scored", run_id, round_)
        if failed is not None:
            results = skipped_of(failed.where("status = 'failed'"), config.specs)
            if scored is not None:
                results = results.unionByName(results_of(scored))
            self._add("evaluator_results", run_id, round_, results, ["case_key", "evaluator_key"])
        elif scored is not None:
            self._add("evaluator_results", run_id, round_, results_of(scored), ["case_key", "evaluator_key"])
        if scored is None:
            return
        self._add("metrics", run_id, round_, scorers.long_metrics(scored, "case_key"), ["case_key", "evaluator_key", "name"])
        self._derive_attempts(run_id, round_, "scored", "evaluator")
        if any(s.resolve().params["cache"] != "off" for s in config.judges):
            names = F.create_map(*[F.lit(x) for s in config.judges for x in (s.key, s.params["client"].name)])
            new = scored.where("response is not null").select(F.col("cache_key").alias("key"), names[F.col("evaluator_key")].alias("model"), "response", F.current_timestamp().alias("created_at"))
            self.store.replay("llm_cache", new, ["key"])

    def spent(self, run_id: str) -> dict[str, float]:
        """Calls, tokens and money of a run so far; a hit of the cache is no call."""
        rows = self._of("attempts", run_id)
        if rows is None:
            return {"calls": 0, "tokens": 0, "usd": 0.0}
        none = self.spark.createDataFrame([], "provider string, model string, input_per_mtok double, output_per_mtok double")
        r = ledger.spend_totals(ledger.price(rows, self.prices if self.prices is not None else none)).first()
        return {"calls": r["calls"], "tokens": r["tokens"], "usd": r["cost"] or 0.0} if r else {"calls": 0, "tokens": 0, "usd": 0.0}

    def _room(self, config: RunConfig, client: object, calls: int) -> int:
        """Units of a wave whose worst case, `calls` calls each, stays within the budgets."""
        b, room = config.budget, config.wave
        if b.calls is b.tokens is b.usd is None:
            return room
        spent, calls = self.spent(config.run_id), calls * _most_calls(client)
        if b.calls is not None:
            room = min(room, (b.calls - spent["calls"]) // calls)
        if b.tokens is not None:
            room = min(room, (b.tokens - spent["tokens"]) // (calls * b.tokens_per_call))
        if b.usd is not None:
            dearest = max(x for _, m, x in self._prices() if m == client.name)
            room = min(room, int((b.usd - spent["usd"]) / (calls * b.tokens_per_call * dearest / 1e6))) if dearest > 0 else room
        return max(0, int(room))

    def _last_call(self, run_id: str) -> int:
        rows = self._of("attempts", run_id)
        return (rows.agg(F.max("seq")).first()[0] if rows is not None else None) or 0

    def _held(self, config: RunConfig, since: int, calls: int) -> str | None:
        """Why no further wave goes out: failures in a row, or one kind of failure that passes for no one. Looks at the
        last `calls` calls of this execution, those of a wave, and as many before them as a row of failures needs."""
        rows = self._of("attempts", config.run_id)
        if rows is None:
            return None
        rows = rows.where((F.col("seq") > since) & ~F.coalesce("cache_hit", F.lit(False))).orderBy(F.desc("seq")).limit(calls + max(config.breaker, config.systemic))
        systemic = [k for _, k, _, s, _ in integrity.TAXONOMY if s]
        if not ledger.systemic(rows.where((F.col("outcome") != "failed") | F.col("failure_kind").isin(*systemic)), config.systemic).isEmpty():
            return "systemic_failure"
        return "provider_outage" if not ledger.breaker_open(rows, config.breaker).isEmpty() else None

    def _waves(self, config: RunConfig, kind: str, client: object, calls: int, owed: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> str | None:
        """Takes owed units (case_key, ord) wave by wave; why it stopped early, or None."""
        wave, since = 0, self._last_call(config.run_id)
        while True:
            room = self._room(config, client, calls)
            # The keys of a wave, at most config.wave, are taken to the driver: what is owed is read from the
            # table that this wave adds to.
            keys = [(r["case_key"],) for r in owed().orderBy("ord", "case_key").limit(max(room, 1)).select("case_key").collect()]
            if not keys:
                return None
            if room <= 0:
                return "budget"
            write(self.spark.createDataFrame(keys, "case_key string"))
            wave += 1
            self.events.emit("wave", run_id=config.run_id, wave=wave, n=len(keys), stage=kind)
            reason = self._held(config, since, len(keys) * calls * _most_calls(client))
            if reason:
                return reason

    def execute(self, config: RunConfig, cases: DataFrame, source_results: DataFrame | None = None, retry_round: int = 0, units: DataFrame | None = None, pairs: DataFrame | None = None) -> dict:
        """Runs what is owed and closes the run; {status, stop_reason, calls}. In a retry round, `units` are the cases
        whose target runs again, and `pairs` (case_key, evaluator_key) the results that are made again alone."""
        run_id, r = config.run_id, retry_round
        order = hashing.seeded_order(config.seed, F.col("case_key"))
        with run_lock(f"{self.store.root}/locks", run_id):
            self._status(run_id, "running", None, retry_of=str(r) if r else None)
            self.derive(config, cases, r)  # what an earlier execution made and did not come to derive
            before = self.spent(run_id)["calls"]
            todo = cases if units is None else cases.join(units.select("case_key"), "case_key", "left_semi")

            def owed_targets() -> DataFrame:
                return plan(todo, self._of("case_results", run_id, r), config.seed)

            def run_targets(keys: DataFrame | None) -> None:
                rows = owed_targets() if keys is None else cases.join(keys, "case_key", "left_semi")
                self._add("case_results", run_id, r, target_stage(rows, config.target, source_results), ["case_key"])
                self._derive_attempts(run_id, r, "case_results", "target")

            reason = None
            if units is None and r:
                pass  # only evaluators are tried again
            elif config.target.paid:
                reason = self._waves(config, "target", config.target.client, 1, owed_targets, run_targets)
            else:
                run_targets(None)

            def owed_scores(spec: scorers.EvaluatorSpec | None) -> DataFrame:
                """Complete cases of this round, or pairs to be tried again, that an evaluator has not scored in it."""
                results = self.current("case_results", run_id, ["case_key"]).where("status = 'complete'")
                due = results.where(F.col("retry_round") == r).select("case_key")
                if pairs is not None and spec is not None:
                    due = due.unionByName(pairs.where(F.col("evaluator_key") == spec.key).select("case_key").join(results, "case_key", "left_semi")).distinct()
                have = self._of("scored", run_id, r)
                if have is not None and spec is not None:
                    due = due.join(have.where(F.col("evaluator_key") == spec.key).select("case_key"), "case_key", "left_anti")
                return due.withColumn("ord", order)

            results = lambda: self.current("case_results", run_id, ["case_key"])
            if config.free and self.store.exists("case_results"):
                merged = merged_cases(cases.join(owed_scores(None), "case_key", "left_semi"), results())
                self._add("scored", run_id, r, free_scores(merged, config.free, config.missing), ["case_key", "evaluator_key"])
            for spec in config.judges if reason is None else ():
                resolved = spec.resolve()

                def run_judge(keys: DataFrame, spec=spec) -> None:
                    cache = self.store.read("llm_cache") if self.store.exists("llm_cache") else None
                    merged = merged_cases(cases.join(keys, "case_key", "left_semi"), results())
                    made = scorers.judge_calls(merged, spec, cache)
                    if config.missing != "fail":
                        lacking = F.col("outcome.failure_kind") == "missing_field"
                        made = made.withColumn("outcome", F.when(lacking, F.col("outcome").withField("status", F.lit("not_applicable")).withField("failure_kind", F.lit(None).cast("string"))).otherwise(F.col("outcome")))
                    self._add("scored", run_id, r, made.select(*SCORED), ["case_key", "evaluator_key"])
                    self._derive_attempts(run_id, r, "scored", "evaluator")

                reason = self._waves(config, spec.key, resolved.params["client"], 1 + resolved.params["validation_retries"], lambda spec=spec: owed_scores(spec), run_judge)
                if reason:
                    break
            self.derive(config, cases, r)
            status, why = self._finish(config, cases, reason)
            self._status(run_id, status, why)
            return {"status": status, "stop_reason": why, "calls": self.spent(run_id)["calls"] - before}

    def _finish(self, config: RunConfig, cases: DataFrame, reason: str | None) -> tuple[str, str | None]:
        """succeeded if no unit is owed and every evaluator scored enough."""
        if reason:
            return "partial", reason
        results = self.current("case_results", config.run_id, ["case_key"])
        er = self.current("evaluator_results", config.run_id, ["case_key", "evaluator_key"])
        if not units_owed(cases, results, er, len(config.specs), config.seed).isEmpty():
            return "partial", "incomplete"
        per = {x["evaluator_key"]: x for x in er.groupBy("evaluator_key").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "not_applicable").alias("na")).collect()}  # a row per evaluator
        total = cases.count()
        if any(s.key not in per or per[s.key]["ok"] == 0 or per[s.key]["ok"] < config.min_coverage * (total - per[s.key]["na"]) for s in config.specs):
            return "partial", "insufficient_coverage"
        return "succeeded", None

    def retry_failed(self, config: RunConfig, cases: DataFrame, max_rounds: int = 3) -> dict:
        """Another round over retryable failures, of targets and of evaluators. Earlier rounds stay as history;
        successes are never repeated."""
        eligible = lambda df: df.where((F.col("status") == "failed") & integrity.retry_eligible(F.col("failure_class"), F.col("failure_kind"), F.col("retry_round"), max_rounds))
        units = eligible(self.current("case_results", config.run_id, ["case_key"])).select("case_key", "retry_round")
        pairs = eligible(self.current("evaluator_results", config.run_id, ["case_key", "evaluator_key"])).select("case_key", "evaluator_key", "retry_round")
        last = units.select("retry_round").unionByName(pairs.select("retry_round")).agg(F.max("retry_round")).first()[0]
        if last is None:
            return {"status": self.status(config.run_id), "stop_reason": None, "calls": 0}
        # What is tried again is fixed before the round adds to the tables it is read from.
        table = f"{config.run_id}-{last + 1}"
        self._fix("retry_units", table, units.select("case_key", F.lit("").alias("evaluator_key")).unionByName(pairs.select("case_key", "evaluator_key")))
        chosen = self.store.read("retry_units").where(F.col("retry") == table)
        units, pairs = chosen.where("evaluator_key = ''").select("case_key"), chosen.where("evaluator_key <> ''").select("case_key", "evaluator_key")
        return self.execute(config, cases, retry_round=last + 1, units=units, pairs=pairs)

    def _fix(self, table: str, name: str, rows: DataFrame) -> None:
        if not self.store.exists(table) or self.store.read(table).where(F.col("retry") == name).isEmpty():
            self.store.append(table, rows.withColumn("retry", F.lit(name)))

    def history(self, run_id: str) -> DataFrame:
        """(run_id, case_key, evaluator_key, round): superseded results of cases (a null evaluator) and of evaluators."""
        out = None
        for table, keys in (("case_results", ["case_key"]), ("evaluator_results", ["case_key", "evaluator_key"])):
            rows = self._of(table, run_id).where("status = 'failed'" if table == "evaluator_results" else "true")
            last = self._of(table, run_id).groupBy(*keys).agg(F.max("retry_round").alias("last"))
            key = F.col("evaluator_key") if table == "evaluator_results" else F.lit(None).cast("string").alias("evaluator_key")
            part = rows.join(last, keys).where("retry_round < last").select("run_id", "case_key", key, F.col("retry_round").alias("round"))
            out = part if out is None else out.unionByName(part)
        return out


def describe(config: RunConfig) -> dict:
    return {"run_id": config.run_id, "dataset": config.dataset, "target": config.target.name, "evaluators": [s.key for s in config.specs], "seed": config.seed}
