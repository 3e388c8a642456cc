import pytest

from tallyframe.operators.scorers import Criterion, Rubric
from tallyframe.plans import single
from tallyframe.sources.calls import CachedClient, RateLimitedClient, RetryingClient, RetryPolicy
from tallyframe.sources.clients import ScriptedClient
from tallyframe.sources.store import FactStore


class Flaky:
    name = "flaky"

    def __init__(self, *codes):
        self.codes = list(codes)

    def call(self, request):
        code = self.codes.pop(0) if self.codes else None
        return {"error_code": code} if code else {"text": "x", "stop_reason": "end_turn"}


def retrying(client, **policy):
    waits = []
    return RetryingClient(client, RetryPolicy(**policy), sleep=waits.append), waits


def test_retries_are_capped_by_kind():
    c, waits = retrying(Flaky("429", "503"))
    got = c.call({"prompt": "p"})
    assert got["text"] == "x" and [a["outcome"] for a in got["attempts"]] == ["failed", "failed", "ok"] and len(waits) == 2 and all(0 <= w <= 30 for w in waits)
    c, waits = retrying(Flaky("401"))
    assert c.call({"prompt": "p"})["error_code"] == "401" and waits == []
    c, _ = retrying(Flaky(*["timeout"] * 9), attempts=9)
    assert len(c.call({"prompt": "p"})["attempts"]) == 3
    c, _ = retrying(Flaky(*["429"] * 9), base=1000.0, cap=1000.0, deadline=0.0)
    assert c.call({"prompt": "p"})["error_code"] == "deadline"


def test_cache_modes():
    cache = CachedClient(Flaky(), {})
    first = cache.call({"prompt": "p"})
    assert cache.call({"prompt": "p"}) == {**first, "cache_hit": True} and len(cache.recorded) == 1
    assert CachedClient(Flaky(), {}, mode="replay").call({"prompt": "q"}) == {"error_code": "cache_miss"}
    assert "cache_hit" not in cache.call({"prompt": "p", "temperature": 0.9}) and len(cache.recorded) == 1
    assert cache.key({"prompt": "p", "timeout": 1}) == cache.key({"prompt": "p", "timeout": 2}) != cache.key({"prompt": "p2"})


def test_single_evaluations_are_judged_once(spark, tmp_path):
    store, rubric = FactStore(spark, str(tmp_path / "f")), Rubric("v1", (Criterion("a"),))
    df = spark.createDataFrame([("1", "p", "good"), ("2", "p", "BROKEN")], "id string, prompt string, output string")
    client = ScriptedClient([("BROKEN", {"text": "{"}), ("", {"text": '{"ratings": {"a": 5}}', "stop_reason": "end_turn"})])
    got = {r["id"]: (r["status"], r["overall_score"], r["verdict"], r["error"]) for r in single.evaluate(store, df, rubric, client).collect()}
    assert got == {"1": ("ok", 1.0, "PASS", None), "2": ("error", None, None, "invalid_output")}
    assert single.evaluate(store, df, rubric, client).count() == 0 and single.get(store, "1").count() == 1
    with pytest.raises(ValueError):
        single.evaluate(store, df, Rubric("v1", (Criterion("b"),)), client)


def test_a_rate_is_shared_between_tasks():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 6))
        now[0] += s

    c = RateLimitedClient(Flaky(), per_second=4.0, tasks=2, burst=2, sleep=sleep, clock=lambda: now[0])
    for _ in range(5):
        assert c.call({"prompt": "p"})["text"] == "x"
    assert waits == [0.5, 0.5, 0.5] and c.name == "flaky"
