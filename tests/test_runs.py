import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import hashing
from tallyframe.operators import accounting, compare, gates, integrity, ledger, scorers
from tallyframe.operators.scorers import EvaluatorSpec
from tallyframe.plans import report, runs
from tallyframe.sources import datasets, store
from tallyframe.sources.clients import ScriptedClient


def write_jsonl(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n", encoding="utf-8")
    return str(path)


def cases_of(n):
    return [{"case_key": f"c{i:03d}", "prompt": f"What is {i}+{i}?", "reference": str(2 * i), "output": str(2 * i if i % 3 else 0), "tags": ["even" if i % 2 == 0 else "odd"]} for i in range(1, n + 1)]


def test_import_is_strict_atomic_and_idempotent(spark, tmp_path):
    s = datasets.DatasetStore(spark, str(tmp_path / "ds"))
    m, created = s.import_jsonl("sums", write_jsonl(tmp_path / "a.jsonl", cases_of(20)))
    assert created and (m["version_no"], m["n_cases"]) == (1, 20)
    again, created = s.import_jsonl("sums", write_jsonl(tmp_path / "b.jsonl", cases_of(20)[::-1]))
    assert not created and again == m
    for bad in (['{"case_key": "x", "prompt": "p", "prompt": "q"}'], ['{"case_key": "x", "prompt": NaN}'], ["[]"], [{"case_key": "x", "prompt": "p"}] * 2, [{"case_key": "x", "prompt": "p", "colour": 1}], [{"case_key": "", "prompt": "p"}]):
        with pytest.raises(ValueError):
            s.import_jsonl("sums", write_jsonl(tmp_path / "bad.jsonl", bad))
    assert [v["version_no"] for v in s.versions("sums")] == [1] and s.verify("sums") == []
    assert s.resolve("sums@1") == s.resolve("sums@latest") == s.resolve("sums@" + m["content_hash"][:10])
    with pytest.raises(LookupError):
        s.resolve("sums@7")


def test_rejects_name_file_and_line(spark, tmp_path):
    path = write_jsonl(tmp_path / "x.jsonl", [{"case_key": "a", "prompt": "p"}, "", "{", {"case_key": "b", "prompt": "q"}])
    cases, rejects = datasets.read_jsonl(spark, path)
    assert cases.count() == 2 and [r["line"] for r in rejects.collect()] == [3]


def test_lines_are_read_as_bytes(spark, tmp_path):
    lines = ['{"case_key": "a", "prompt": "a \\ufffd and \ufffd"}'.encode(), b"\t \t", b'{"case_key": "b", "prompt": "\xff"}', b'{"case_key": "c", "prompt": "' + b"x" * (4 << 20) + b'"}', b""]
    (tmp_path / "b.jsonl").write_bytes(b"\n".join(lines))
    cases, rejects = datasets.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    assert [r["prompt"] for r in cases.collect()] == ["a \ufffd and \ufffd"]
    assert sorted((r["line"], r["error"]) for r in rejects.collect()) == [(3, "not UTF-8"), (4, "line too long")]


def test_a_dataset_hash_is_that_of_its_rows_alone(spark):
    rows = [(f"k{i}", f"h{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "case_key string, content_hash string")
    one = hashing.dataset_hash(df)
    assert hashing.dataset_hash(df.orderBy(F.desc("case_key")).repartition(7)) == one != hashing.dataset_hash(df.where("case_key <> 'k7'"))
    assert hashing.dataset_hash(df.withColumn("content_hash", F.when(F.col("case_key") == "k9", "x").otherwise(F.col("content_hash")))) != one


def test_export_reads_back_as_the_same_version(spark, tmp_path):
    s = datasets.DatasetStore(spark, str(tmp_path / "ds"))
    m, _ = s.import_jsonl("d", write_jsonl(tmp_path / "a.jsonl", [{"case_key": "a", "prompt": "é", "retrieved": ["x"], "relevance": {"x": 2}, "metadata": {"k": [1, 1.5]}}, {"case_key": "b", "prompt": "", "output": ""}]))
    out = str(tmp_path / "out.jsonl")
    assert s.export_jsonl("d", out) == 2 and s.import_jsonl("d", out) == (m, False)
    with pytest.raises(FileExistsError):
        s.export_jsonl("d", out)


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    ds = datasets.DatasetStore(spark, str(root / "ds"))
    ds.import_jsonl("sums", write_jsonl(root / "a.jsonl", cases_of(60)))
    cases = ds.cases("sums")
    fs = store.FactStore(spark, str(root / "facts"))
    c = runs.Controller(spark, fs)
    specs = [EvaluatorSpec("exact_match", "em"), EvaluatorSpec("regex", "digits", {"pattern": "[0-9]+", "mode": "fullmatch"})]
    a = runs.RunConfig("base", "sums@1", runs.Target("callable", "good", function=lambda v: str(2 * int(v["prompt"].split("+")[1][:-1]))), specs)
    b = runs.RunConfig("cand", "sums@1", runs.Target("precomputed", "file"), specs)
    for config in (a, b):
        c.create(config, cases)
        assert c.execute(config, cases)["status"] == "succeeded"
    return c, cases, a, b


def test_a_run_leaves_sound_facts(spark, ran):
    c, cases, a, _ = ran
    facts = [c.store.read(t) for t in ("case_results", "evaluator_results", "metrics")]
    status = spark.createDataFrame([("base", "v", "succeeded"), ("cand", "v", "succeeded")], "run_id string, dataset_version_id string, status string")
    bad = integrity.verify_run(status, cases.withColumn("dataset_version_id", F.lit("v")), *facts)
    assert bad.count() == 0
    broken = integrity.verify_run(status, cases.withColumn("dataset_version_id", F.lit("v")), facts[0], facts[1], facts[2].where("case_key <> 'c001'"))
    assert {r["check"] for r in broken.collect()} == {"ok_without_metric"}


def test_a_worse_candidate_fails_its_gate(spark, ran):
    c, cases, a, b = ran
    cr, m, er = (c.store.read(t) for t in ("case_results", "metrics", "evaluator_results"))
    pairs = compare.pair(*(compare.case_outcomes(cr, cases, r) for r in ("base", "cand")))
    paired = compare.paired_stats(compare.paired_values(pairs, m, "base", "cand"))
    row = {r["evaluator_key"].split(":")[0]: r for r in paired.collect()}["exact_match"]
    assert (row["n"], row["lower"], row["higher"], round(row["mean_cand"], 6)) == (60, 20, 0, round(40 / 60, 6))
    totals = spark.createDataFrame([("base", 60), ("cand", 60)], "run_id string, total bigint")
    summary = accounting.summarize(cr, er, m, totals)
    coverage = [r.asDict() for r in summary["coverage"].where("run_id = 'cand'").collect()]
    head = [r.asDict() for r in summary["metrics"].where("run_id = 'cand'").collect()]
    g = gates.parse({"gates": {"exact_match:em.match": {"direction": "higher", "delta": 0.05}}})
    got = gates.evaluate(g, [r.asDict() for r in paired.collect()], head, coverage)
    assert (got["status"], got["exit_code"]) == ("fail", 3) and got["failures"][0][0] == "regression"
    same = gates.evaluate(g, [{**row.asDict(), "ci_low": -0.01, "ci_high": 0.01}], head, coverage)
    assert same["status"] == "pass"
    few = gates.evaluate(g.as_strict(), [{**row.asDict(), "n": 5}], head, coverage)
    assert (few["status"], few["exit_code"]) == ("inconclusive", 4)
    page = report.render("<run>", {"Paired": paired, "Stages": summary["stages"]}, report.case_selection(accounting.failures(cr, er), None, cases, 5).join(cases, "case_key").select("case_key", "prompt"))
    assert "&lt;run&gt;" in page and "<script" not in page


def test_waves_stop_at_the_budget_and_go_on(spark, tmp_path, ran):
    _, cases, _, _ = ran
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")))
    specs = [EvaluatorSpec("regex", "any", {"pattern": "."})]
    config = runs.RunConfig("paid", "sums@1", runs.Target("model", "m", client=ScriptedClient([("", {"text": "x", "stop_reason": "end_turn"})])), specs, wave=20, max_calls=30)
    c.create(config, cases)
    assert c.execute(config, cases) == {"status": "partial", "stop_reason": "budget", "calls": 30}
    config.max_calls = None
    assert c.execute(config, cases) == {"status": "succeeded", "stop_reason": None, "calls": 30}
    assert c.store.read("case_results").count() == 60 and c.store.read("case_results").select("case_key").distinct().count() == 60


def test_breaker_and_retry(spark, tmp_path, ran):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c012'")
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")))
    specs = [EvaluatorSpec("regex", "any", {"pattern": "."})]
    down = runs.RunConfig("r", "sums@1", runs.Target("model", "m", client=ScriptedClient([("", {"error_code": "429"})])), specs, wave=12)
    c.create(down, few)
    assert c.execute(down, few)["stop_reason"] == "provider_outage"
    up = runs.RunConfig("r", "sums@1", runs.Target("model", "m", client=ScriptedClient([("", {"text": "x"})])), specs, wave=12)
    assert c.retry_failed(up, few)["status"] == "succeeded"
    assert c.history("r").count() == 12 and c.current("case_results", "r", ["case_key"]).where("status = 'complete'").count() == 12


class Counting:
    """A judge that counts its calls in a file per call, fails where the script says so, and is sent to the workers."""

    name = "counting"

    def __init__(self, folder, script=()):
        self.folder, self.inner = str(folder), ScriptedClient(script)

    def call(self, request):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return self.inner.call(request)


def judged(folder, **judge):
    script = judge.pop("script", ())
    client = Counting(folder, script)
    return client, EvaluatorSpec("llm_judge", "q", {"rubric": scorers.Rubric("v", (scorers.Criterion("a"), scorers.Criterion("b"))), "client": client, **judge})


def n_calls(folder):
    import os

    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


def test_a_judge_is_called_once_per_case_and_within_the_budget(spark, tmp_path, ran):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c010'")
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")))
    _, spec = judged(tmp_path / "calls", validation_retries=0)
    config = runs.RunConfig("j", "sums@1", runs.Target("precomputed", "file"), [spec, EvaluatorSpec("exact_match", "em")], wave=4, max_calls=3)
    c.create(config, few)
    assert c.execute(config, few) == {"status": "partial", "stop_reason": "budget", "calls": 3} and n_calls(tmp_path / "calls") == 3
    config.max_calls = None
    assert c.execute(config, few) == {"status": "succeeded", "stop_reason": None, "calls": 7} and n_calls(tmp_path / "calls") == 10
    attempts = c.store.read("attempts")
    assert attempts.count() == 10 and attempts.where("scope = 'evaluator' and n = 1 and outcome = 'ok'").count() == 10 and ledger.attempt_gaps(attempts).isEmpty()
    verdicts = {r["case_key"]: r["verdict"] for r in c.current("evaluator_results", "j", ["case_key", "evaluator_key"]).where(F.col("evaluator_key") == spec.key).collect()}
    scores = {r["case_key"]: r["value"] for r in c.store.read("metrics").where(F.col("evaluator_key") == spec.key).where("name = 'score'").collect()}
    assert len(verdicts) == 10 and all((scores[k] >= 0.75) == (v == "PASS") for k, v in verdicts.items())


def test_tokens_and_money_are_limits_too(spark, tmp_path, ran):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c010'")
    prices = spark.createDataFrame([("counting", "counting", 10.0, 20.0)], "provider string, model string, input_per_mtok double, output_per_mtok double")
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")), prices=prices)
    _, spec = judged(tmp_path / "calls", validation_retries=0)
    config = lambda name, **limits: runs.RunConfig(name, "sums@1", runs.Target("precomputed", "file"), [spec], wave=4, tokens_per_call=1000, **limits)
    for name, limits in (("t", {"max_tokens": 1500}), ("u", {"max_usd": 0.026})):
        c.create(config(name, **limits), few)
        got = c.execute(config(name, **limits), few)
        spent = c.spent(name)
        assert got["stop_reason"] == "budget" and 2 <= got["calls"] < 10 and (spent["tokens"] <= 1500 or name == "u") and (spent["usd"] <= 0.026 or name == "t")
    with pytest.raises(ValueError):
        runs.Controller(spark, c.store).create(config("x", max_usd=1.0), few)


def test_a_systemic_failure_holds_the_run_and_failed_judgements_are_tried_again(spark, tmp_path, ran):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c012'")
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")))
    _, denied = judged(tmp_path / "a", script=[("", {"error_code": "401"})])
    config = lambda name, spec: runs.RunConfig(name, "sums@1", runs.Target("precomputed", "file"), [spec], wave=4)
    c.create(config("s", denied), few)
    assert c.execute(config("s", denied), few)["stop_reason"] == "systemic_failure" and n_calls(tmp_path / "a") == 4
    _, flaky = judged(tmp_path / "b", script=[("7+7", {"error_code": "503"})])
    _, sound = judged(tmp_path / "b")
    c.create(config("r", flaky), few)
    assert c.execute(config("r", flaky), few)["calls"] == 12
    assert c.retry_failed(config("r", sound), few) == {"status": "succeeded", "stop_reason": None, "calls": 1}
    assert c.retry_failed(config("r", sound), few)["calls"] == 0
    history = c.history("r").collect()
    assert [(r["case_key"], r["evaluator_key"], r["round"]) for r in history] == [("c007", flaky.key, 0)]
    attempts = c.store.read("attempts").where("run_id = 'r' and case_key = 'c007'")
    assert sorted((r["n"], r["outcome"]) for r in attempts.collect()) == [(1, "failed"), (2, "ok")]
    assert ledger.retry_stats(c.history("r")).first()["evaluator_failures"] == 1


def test_cached_answers_make_no_call(spark, tmp_path, ran):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c010'")
    c = runs.Controller(spark, store.FactStore(spark, str(tmp_path / "f")))
    for name, calls, mode in (("one", 10, "readwrite"), ("two", 0, "readwrite"), ("three", 0, "replay")):
        _, spec = judged(tmp_path / name, cache=mode)
        config = runs.RunConfig(name, "sums@1", runs.Target("precomputed", "file"), [spec])
        c.create(config, few)
        assert c.execute(config, few) == {"status": "succeeded", "stop_reason": None, "calls": calls} and n_calls(tmp_path / name) == calls
    stats = {r["run_id"]: r["cache_hits"] for r in ledger.attempt_stats(ledger.price(c.store.read("attempts"), spark.createDataFrame([], "provider string, model string, input_per_mtok double, output_per_mtok double"))).collect()}
    assert stats == {"one": 0, "two": 10, "three": 10} and c.store.read("llm_cache").count() == 10
    _, spec = judged(tmp_path / "four", cache="replay", temperature=0.0, max_tokens=7)
    config = runs.RunConfig("four", "sums@1", runs.Target("precomputed", "file"), [spec])
    c.create(config, few)
    assert c.execute(config, few)["calls"] == 0 and n_calls(tmp_path / "four") == 0  # another request: nothing to replay


@pytest.mark.parametrize("stop", ["scored", "evaluator_results", "attempts"])
def test_a_run_that_stopped_between_two_writes_goes_on(spark, tmp_path, ran, stop):
    _, cases, _, _ = ran
    few = cases.where("case_key <= 'c006'")

    class Stopping(store.FactStore):
        armed = True

        def append(self, table, rows):
            super().append(table, rows)
            if self.armed and table == stop and not rows.isEmpty():
                raise KeyboardInterrupt

    fs = Stopping(spark, str(tmp_path / "f"))
    c = runs.Controller(spark, fs)
    _, spec = judged(tmp_path / "calls")
    config = runs.RunConfig("k", "sums@1", runs.Target("precomputed", "file"), [spec, EvaluatorSpec("exact_match", "em")])
    c.create(config, few)
    with pytest.raises(KeyboardInterrupt):
        c.execute(config, few)
    fs.armed = False
    c.recover("k")
    assert c.execute(config, few)["status"] == "succeeded" and n_calls(tmp_path / "calls") == 6
    facts = [fs.read(t) for t in ("case_results", "evaluator_results", "metrics", "attempts")]
    status = spark.createDataFrame([("k", "v", "succeeded")], "run_id string, dataset_version_id string, status string")
    keys = spark.createDataFrame([("k", s.key) for s in config.specs], "run_id string, evaluator_key string")
    bad = integrity.verify_run(status, few.withColumn("dataset_version_id", F.lit("v")), *facts[:3], attempts=facts[3], history=c.history("k"), evaluators=keys)
    assert bad.isEmpty()


def test_a_target_may_rank_and_is_held_to_bytes(spark, ran):
    _, cases, _, _ = ran
    answers = {"c001": {"output": "x", "retrieved": ["a", "b"]}, "c002": {"output": "x", "retrieved": ["a", 1]}, "c003": {"output": "x", "meta": {"a": "é" * 2500}}, "c004": {"output": "x", "meta": {"a": "e" * 2500}}}
    got = runs.target_stage(cases.where("case_key <= 'c004'"), runs.Target("callable", "t", function=lambda v: answers[v["case_key"]]))
    assert {r["case_key"]: (r["status"], r["retrieved"]) for r in got.collect()} == {"c001": ("complete", ["a", "b"]), "c002": ("failed", None), "c003": ("failed", None), "c004": ("complete", None)}
    seen = runs.merged_cases(cases.where("case_key <= 'c004'"), got)
    assert {r["case_key"]: r["retrieved"] for r in seen.collect()} == {"c001": ["a", "b"], "c004": None}


def test_contract_of_targets(spark, ran):
    _, cases, _, _ = ran
    answers = {"c001": "x", "c002": "", "c003": 7, "c004": {"output": "y", "meta": {"a": 1}}, "c005": {"output": "z", "meta": {"a": "b" * 5000}}}

    def answer(view):
        assert set(view) == {"case_key", "prompt", "context"}
        return answers[view["case_key"]] if view["case_key"] in answers else 1 / 0

    got = {r["case_key"]: (r["status"], r["failure_kind"]) for r in runs.target_stage(cases.where("case_key <= 'c006'"), runs.Target("callable", "t", function=answer)).collect()}
    assert got == {"c001": ("complete", None), "c002": ("failed", "empty_output"), "c003": ("failed", "contract_violation"), "c004": ("complete", None), "c005": ("failed", "contract_violation"), "c006": ("failed", "exception")}


def test_store_replays_once_and_binds_labels_for_good(spark, tmp_path):
    s = store.FactStore(spark, str(tmp_path / "f"))
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, case_key string, v int")
    assert (s.replay("t", rows, ["run_id", "case_key"]), s.replay("t", rows, ["run_id", "case_key"])) == (2, 0)
    s.bind_label("v1", "h")
    s.bind_label("v1", "h")
    with pytest.raises(ValueError):
        s.bind_label("v1", "other")
    for bad in (("created", "succeeded"), ("succeeded", "running"), ("partial", "failed")):
        with pytest.raises(ValueError):
            store.check_transition(*bad)
    store.check_transition("succeeded", "running", retry_of="1")


def test_gates_are_read_strictly():
    for bad in ({"gates": {"a.b": {"direction": "up", "delta": 0}}}, {"gates": {"a.b": {}}}, {"min_coverage": 2}, {"other": 1}, {"gates": {"a.b": {"delta": 1, "rel_delta": 1}}}):
        with pytest.raises((ValueError, TypeError)):
            gates.parse(bad)
    g = gates.parse({"max_na_asymmetry": 0.3})
    assert g.as_strict().max_na_asymmetry == 0.3 and g.as_strict().strict
