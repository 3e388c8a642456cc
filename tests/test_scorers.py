import json
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import scorers
from tallyframe.operators.scorers import Criterion, EvaluatorSpec, Rubric
from tallyframe.sources.clients import ScriptedClient

CASE = "case_key string, prompt string, output string, reference string, context string, retrieved array<string>, relevance map<string,int>"


def one(spark, spec, **fields):
    row = {f.split(" ")[0]: None for f in CASE.split(", ")} | {"case_key": "k", "prompt": "p"} | fields
    r = scorers.score(spark.createDataFrame([tuple(row.values())], CASE), spec).first()["outcome"]
    return r["status"], r["metrics"], r["verdict"], json.loads(r["detail"]) if r["detail"] else None


def test_exact_match(spark):
    assert one(spark, EvaluatorSpec("exact_match", "e"), output="a", reference="a")[1:3] == ({"match": 1.0}, "PASS")
    assert one(spark, EvaluatorSpec("exact_match", "e"), output="abc", reference="abd")[1:] == ({"match": 0.0}, "FAIL", {"first_difference": 2})
    assert one(spark, EvaluatorSpec("exact_match", "e"), output="a")[0] == "failed"
    assert one(spark, EvaluatorSpec("exact_match", "e", {"normalize": ["strip", "casefold", "nfkc"]}), output=" ﬁＡ", reference="fia ")[2] == "PASS"


@pytest.mark.parametrize("params,output,verdict", [({"pattern": "b+"}, "abbc", "PASS"), ({"pattern": "b+", "mode": "fullmatch"}, "bb\n", "FAIL"), ({"pattern": r"\d"}, "٣", "PASS"), ({"pattern": "(?P<x>a)b(?P=x)"}, "aba", "PASS"), ({"pattern": "A", "flags": "i"}, "a", "PASS"),
    ({"pattern": "école", "flags": "i"}, "ÉCOLE", "PASS"), ({"pattern": "a.b"}, "a\u2028b", "PASS"), ({"pattern": "a$"}, "a\r", "FAIL"), ({"pattern": "a$"}, "a\n", "PASS"), ({"pattern": "k", "flags": "i"}, "\u212a", "PASS"), ({"pattern": "a{,2}b", "mode": "fullmatch"}, "aab", "PASS"), ({"pattern": "^b", "flags": "m"}, "a\u0085b", "FAIL")])
def test_regex_as_python_reads_it(spark, params, output, verdict):
    assert one(spark, EvaluatorSpec("regex", "r", params), output=output)[2] == verdict


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", ".", "^", "$", "a*", "(?:a|b)+", "[^a]", "[ab]{1,2}", "(?=b)", "(?<=a)", "\\.", "\\n", "(b)?", "B", "é", " "]), min_size=1, max_size=5), st.sampled_from(["", "i", "m", "s", "im", "ims"]), st.sampled_from(["search", "fullmatch"]))
def test_java_agrees_with_python_where_it_is_used(spark, parts, flags, mode):
    pattern = "".join(parts)
    texts = ["", "a", "ab", "b\na", "a\r", "ba\n", "É é", "a\u2028b", "😀ab", "AB\nab", "\u0085a", ".a.b", "aab\n\n"]
    try:
        compiled = re.compile(pattern, sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in flags))
    except re.error:
        return
    rows = [(str(i), "p", t, None, None, None, None) for i, t in enumerate(texts)]
    got = {int(r["case_key"]): r["outcome"] for r in scorers.score(spark.createDataFrame(rows, CASE), EvaluatorSpec("regex", "r", {"pattern": pattern, "flags": flags, "mode": mode})).collect()}
    for i, t in enumerate(texts):
        m = compiled.search(t) if mode == "search" else compiled.fullmatch(t)
        assert (got[i]["verdict"] == "PASS") == (m is not None), (pattern, flags, mode, t)
        if m:
            assert json.loads(got[i]["detail"]) == {"text": m.group()[:200], "span": [m.start(), m.end()]}, (pattern, flags, mode, t)


def test_json_schema(spark):
    schema = {"type": "object", "required": ["city", "stops"], "properties": {"city": {"enum": ["Oslo", "Porto"]}, "stops": {"type": "array", "items": {"type": "number", "exclusiveMinimum": 2}, "minItems": 1}, "open": {"type": "boolean"}}, "additionalProperties": False}
    spec = EvaluatorSpec("json_schema", "s", {"schema": schema, "strip_fence": True})
    assert one(spark, spec, output='```json\n{"city": "Porto", "stops": [2.5, 9], "open": true}\n```')[2] == "PASS"
    for bad in ('{"city": "Rome", "stops": [3]}', '{"city": "Oslo", "stops": [3, 2]}', '{"city": "Oslo", "stops": []}', '{"city": "Oslo", "stops": [Infinity]}', '{"city": "Oslo", "city": "Oslo", "stops": [3]}', '{"city": "Oslo", "stops": [3], "open": 1}', "null", "Oslo", '{"stops": [3]', '{"a":' * 2000):
        status, metrics, verdict, detail = one(spark, spec, output=bad)
        assert (status, metrics, verdict) == ("ok", {"valid": 0.0}, "FAIL") and detail["errors"]


def test_retrieval_by_a_plain_computation(spark):
    rng = random.Random(11)
    for _ in range(6):
        ranking = [f"d{rng.randrange(12)}" for _ in range(rng.randrange(1, 11))]
        grades = {f"d{i}": rng.randrange(5) for i in rng.sample(range(12), 7)} | {"d5": 1}
        k = rng.randrange(1, 8)
        _, m, verdict, _ = one(spark, EvaluatorSpec("retrieval", "r", {"k": [k]}), retrieved=ranking, relevance=grades)
        docs = list(dict.fromkeys(ranking))
        gains = [2 ** grades.get(d, 0) - 1 for d in docs]
        dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g[:k]))
        good, top = {d for d, g in grades.items() if g > 0}, docs[:k]
        hits = [d for d in top if d in good]
        first = next((i for i, d in enumerate(docs, 1) if d in good), None)
        want = {"mrr": 1 / first if first else 0.0, f"recall@{k}": len(hits) / len(good), f"precision@{k}": len(hits) / k, f"hit@{k}": float(bool(hits)), f"ndcg@{k}": dcg(gains) / dcg(sorted((2**g - 1 for g in grades.values()), reverse=True))}
        assert verdict is None and m == pytest.approx(want)
    assert one(spark, EvaluatorSpec("retrieval", "r"), retrieved=["d1"], relevance={"d2": 0})[0] == "not_applicable"
    assert one(spark, EvaluatorSpec("retrieval", "r"), retrieved=[], relevance={"d2": 4})[1]["ndcg@5"] == 0.0


def test_citation_worked_example(spark):
    spec = EvaluatorSpec("citation_check", "c")
    _, m, verdict, _ = one(spark, spec, output="Paris [1] is big [2]; see [7] and [1].", retrieved=["x", "y", "z"], relevance={"x": 1, "z": 2})
    assert m == pytest.approx({"citation_validity": 2 / 3, "citation_precision": 0.5, "citation_recall": 0.5}) and verdict == "FAIL"
    assert one(spark, spec, output="none", retrieved=["x"])[0] == "not_applicable"
    assert one(spark, spec, output="[1]", retrieved=["x"])[1] == {"citation_validity": 1.0}
    assert one(spark, EvaluatorSpec("citation_check", "c", {"style": "id", "marker": r"<(\w+)>"}), output="<x> <q>", retrieved=["x"])[1]["citation_validity"] == 0.5


RUBRIC = Rubric("v1", (Criterion("a", 3.0), Criterion("b", 1.0, None, ("bad", "ok", "good")), Criterion("c", must_pass=True)))


def test_rubric_scores_and_refuses():
    got = RUBRIC.score({"ratings": {"a": 5, "b": "ok", "c": 2}, "notes": {"a": "fine"}})
    assert got["overall"] == pytest.approx((3 + 0.5 + 0.25) / 5) and got["verdict"] == "FAIL" and got["failed_gates"] == ["c"]
    for bad in ({"ratings": {"a": 5}}, {"a": 5, "b": "ok", "c": 2}, {"ratings": {"a": 6, "b": "ok", "c": 2}}, {"ratings": {"a": True, "b": "ok", "c": 2}}, {"ratings": {"a": 5, "b": "x", "c": 2}}, {"ratings": {"a": 5, "b": "ok", "c": 2}, "more": 1}, {"ratings": []}):
        with pytest.raises(ValueError):
            RUBRIC.score(bad)


def test_judge(spark):
    good = json.dumps({"ratings": {"a": 5, "b": "good", "c": 4}})
    client = ScriptedClient([("REFUSE", {"stop_reason": "refusal"}), ("BROKEN", {"text": "{"}), ("DOWN", {"error_code": "rate_limited"}), ("CUT", {"text": good, "stop_reason": "max_tokens"}), ("", {"text": good, "stop_reason": "end_turn"})])
    spec = EvaluatorSpec("llm_judge", "q", {"rubric": RUBRIC, "client": client})
    for text, want in (("x", ("ok", None)), ("REFUSE", ("failed", "refused")), ("BROKEN", ("failed", "invalid_output")), ("DOWN", ("failed", "rate_limited")), ("CUT", ("failed", "truncated"))):
        df = spark.createDataFrame([("k", "p", text, None, None, None, None)], CASE)
        o = scorers.score(df, spec).first()["outcome"]
        assert (o["status"], o["failure_kind"]) == want
    assert spec.key == EvaluatorSpec("llm_judge", "q", {"rubric": RUBRIC, "client": client}).key


def test_prompt_blocks_cannot_be_closed_by_their_text():
    p = scorers.render_prompt({"prompt": "p", "output": "x", "context": None, "reference": None}, RUBRIC)
    mark = scorers.delimiter("x")
    assert f"<<{mark}\nx\n{mark}>>" in p and "CONTEXT: not given" in p
    assert scorers.delimiter("a" + mark) not in "a" + mark


def test_keys_depend_on_parameters_only_as_they_are_canonical():
    a, b = EvaluatorSpec("retrieval", "r", {"k": [5, 3]}), EvaluatorSpec("retrieval", "r", {"k": [3, 5, 5]})
    assert a.key == b.key != EvaluatorSpec("retrieval", "r", {"k": [3]}).key and a.key.startswith("retrieval:r:")
    for bad in ({"k": [0]}, {"k": []}, {"x": 1}):
        with pytest.raises(ValueError):
            EvaluatorSpec("retrieval", "r", bad).resolve()


def test_column_scorers_share_one_scan(spark):
    df = spark.createDataFrame([("k", "p", "a [1]", "a", None, ["x"], None)], CASE)
    out = scorers.score_all(df, [EvaluatorSpec("regex", "r", {"pattern": "a"}), EvaluatorSpec("citation_check", "c"), EvaluatorSpec("retrieval", "t")])
    got = {r["evaluator_key"].split(":")[0]: r["outcome"]["status"] for r in out.collect()}
    assert got == {"regex": "ok", "citation_check": "ok", "retrieval": "failed"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], CASE)
    assert scorers.score(df, EvaluatorSpec("exact_match", "e")).count() == 0


def test_registry_refuses_a_kind_twice():
    with pytest.raises(ValueError):
        scorers.register(scorers.kinds()["regex"])
    assert F is not None
