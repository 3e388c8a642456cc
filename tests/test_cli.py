import json

from tallyframe import cli
from tallyframe.sources.clients import ScriptedClient


def test_from_import_to_gate(spark, tmp_path, capsys):
    cases = [{"case_key": f"c{i:02d}", "prompt": f"say {i}", "reference": str(i), "output": str(i if i % 3 else -1)} for i in range(45)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cases)))
    run = lambda *a: cli.main(["--root", str(tmp_path / "root"), *map(str, a)], spark)
    assert run("dataset-import", "nums", tmp_path / "c.jsonl") == 0 and run("dataset-verify", "nums") == 0 and run("dataset-lint", "nums") == 0
    evaluators = '[[evaluators]]\nkind = "exact_match"\nname = "em"\n'
    for name, target in (("good", 'kind = "callable"\nname = "t"\nfunction = "tests.test_cli:answer"'), ("bad", 'kind = "precomputed"\nname = "f"')):
        (tmp_path / f"{name}.toml").write_text(f'run_id = "{name}"\ndataset = "nums@1"\n{evaluators}\n[target]\n{target}\n')
        assert run("run-create", tmp_path / f"{name}.toml") == 0 and run("run-execute", tmp_path / f"{name}.toml") == 0 and run("run-verify", name) == 0
    (tmp_path / "gates.toml").write_text('[gates]\n"exact_match:em.match" = {direction = "higher", delta = 0.02}\n')
    assert run("compare", "good", "bad", "--gates", tmp_path / "gates.toml") == 3
    assert run("compare", "good", "good", "--gates", tmp_path / "gates.toml") == 0
    assert run("run-tag", "good", "main") == 0 and run("compare", "tag:main", "bad", "--gates", tmp_path / "gates.toml") == 3 and run("compare", "tag:none", "bad") == 1
    assert run("report", "bad", tmp_path / "r.html", "--baseline", "tag:main", "--gates", tmp_path / "gates.toml") == 0
    page = (tmp_path / "r.html").read_text()
    assert all(x in page for x in ("Run bad", "Comparison: paired", "Gates", "regression", "Operations", "Environment"))
    assert run("run-status", "bad") == 0 and run("run-preflight", tmp_path / "bad.toml") == 0
    assert run("queue", "bad", "--n", "3") == 0 and run("run-show", "bad") == 0 and run("run-tag", "bad", "main") == 0
    assert run("run-status", "none") == 1 and run("dataset-show", "nums@9") == 1
    assert "regression" in capsys.readouterr().out


def test_judges_from_the_command_line(spark, tmp_path, capsys):
    cases = [{"case_key": f"c{i}", "prompt": f"say {i}", "output": str(i)} for i in range(6)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cases)))
    run = lambda *a: cli.main(["--root", str(tmp_path / "root"), *map(str, a)], spark)
    assert run("dataset-import", "nums", tmp_path / "c.jsonl") == 0
    judge = '[[evaluators]]\nkind = "llm_judge"\nname = "q"\n[evaluators.params]\nclient = "tests.test_cli:judge"\ncache = "readwrite"\n[evaluators.params.rubric]\nversion = "v1"\n[[evaluators.params.rubric.criteria]]\nname = "right"\n'
    (tmp_path / "r.toml").write_text(f'run_id = "r"\ndataset = "nums@1"\nmax_calls = 100\n[target]\nkind = "precomputed"\nname = "f"\npinned = false\n{judge}')
    assert run("run-preflight", tmp_path / "r.toml") == 0 and run("run-create", tmp_path / "r.toml") == 0 and run("run-execute", tmp_path / "r.toml") == 0 and run("run-verify", "r") == 0
    (tmp_path / "gates.toml").write_text('[gates]\n"llm_judge:q.score" = {direction = "higher", delta = 0.02}\n')
    capsys.readouterr()
    assert run("compare", "r", "r", "--gates", tmp_path / "gates.toml") == 3 and "unpinned_target" in capsys.readouterr().out
    fixtures = [{"id": f"f{i}", "category": "sums", "prompt": "p", "output": "good" if i % 2 else "BAD", "expected": "PASS" if i % 2 else "FAIL"} for i in range(8)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, fixtures)))
    assert run("judge-check", tmp_path / "r.toml", tmp_path / "f.jsonl") == 0
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(f | {"expected": "PASS"}) for f in fixtures))
    assert run("judge-check", tmp_path / "r.toml", tmp_path / "g.jsonl") == 3 and run("judge-check", tmp_path / "r.toml", tmp_path / "gates.toml") == 1
    (tmp_path / "down.toml").write_text(judge.replace("tests.test_cli:judge", "tests.test_cli:denied"))
    assert run("judge-check", tmp_path / "down.toml", tmp_path / "f.jsonl") == 1
    assert run("cache-stats") == 0 and run("cache-clear") == 0
    (tmp_path / "e.toml").write_text(judge)
    (tmp_path / "e.jsonl").write_text('{"id": "1", "prompt": "p", "output": "good"}')
    assert run("evaluate", tmp_path / "e.toml", tmp_path / "e.jsonl") == 0 and run("evaluation-show", "1") == 0 and run("evaluation-list") == 0


def judge():
    return ScriptedClient([("BAD", {"text": '{"ratings": {"right": 1}}'}), ("", {"text": '{"ratings": {"right": 5}}', "stop_reason": "end_turn"})])


def denied():
    return ScriptedClient([("", {"error_code": "401"})])


def answer(view):
    return view["prompt"].split(" ")[1]
