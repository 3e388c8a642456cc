"""Clients of models: the protocol, and a scripted one for tests and replays. No network client is part of this package."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Protocol


class ModelClient(Protocol):
    """Transport only: one request, one response, no retries. Sent to the executors, so it must pickle."""

    name: str

    def call(self, request: dict) -> dict:
        """{text, stop_reason, input_tokens, output_tokens} or {error_code}."""
        ...


class ScriptedClient:
    """Answers by rule: the first marker that occurs in the prompt gives the response; else a score drawn from the prompt's hash."""

    def __init__(self, script: list[tuple[str, dict]] = (), name: str = "scripted"):
        self.script, self.name = list(script), name

    def call(self, request: dict) -> dict:
        for marker, response in self.script:
            if marker in request["prompt"]:
                return dict(response)
        h = int(hashlib.sha256(request["prompt"].encode()).hexdigest()[:8], 16)
        asked = request.get("schema", {}).get("properties", {}).get("ratings", {}).get("properties", {})
        payload = {"ratings": {name: spec["enum"][(h >> i) % len(spec["enum"])] for i, (name, spec) in enumerate(asked.items())}}
        text = json.dumps(payload)
        return {"text": text, "stop_reason": "end_turn", "input_tokens": len(request["prompt"]) // 4, "output_tokens": len(text) // 4}


#: Error codes of providers and the failures they are (fixed values of this package).
ERROR_KINDS = {
    "401": ("infrastructure", "auth"), "403": ("infrastructure", "auth"), "408": ("infrastructure", "timeout"), "413": ("input", "oversize"), "429": ("infrastructure", "rate_limited"), "400": ("evaluator", "bad_request"),
    "500": ("infrastructure", "provider_unavailable"), "502": ("infrastructure", "provider_unavailable"), "503": ("infrastructure", "provider_unavailable"), "529": ("infrastructure", "provider_unavailable"), "deadline": ("infrastructure", "deadline_exceeded"),
    "insufficient_quota": ("infrastructure", "quota_exhausted"),
}


#: Kinds that clients of this package report by name (fixed values).
KINDS = {"rate_limited", "provider_unavailable", "timeout", "connection", "auth", "quota_exhausted", "storage", "budget_exceeded", "deadline_exceeded", "cancelled"}


def failure_of(code: str) -> tuple[str, str]:
    """(class, kind) of an error code: a provider's, or the name of a kind."""
    code = str(code)
    if code in KINDS:
        return "infrastructure", code
    return ERROR_KINDS.get(code, ("infrastructure", "internal_error"))


#: One call as a row. n counts an owner's calls within one stage, seq is its time.
CALL = "struct<n:int,outcome:string,failure_class:string,failure_kind:string,provider:string,model:string,input_tokens:bigint,output_tokens:bigint,duration_ms:double,cache_hit:boolean,seq:bigint>"


def timed_call(client: ModelClient, request: dict, calls: list[dict], cached: dict | None = None, lookup: bool = False) -> dict:
    """The response to a request, from the cache if it is given; adds a row per attempt to `calls`."""
    began, t = time.time_ns(), time.monotonic()
    got = {**cached, "cache_hit": True} if cached is not None else client.call(request)
    ms = (time.monotonic() - t) * 1000
    own = got.get("attempts") if cached is None else None
    code = got.get("error_code")
    own = own or [{"outcome": "failed" if code else "ok", "error": code, "duration_ms": ms, "input_tokens": got.get("input_tokens"), "output_tokens": got.get("output_tokens")}]
    for i, a in enumerate(own):
        kind = a.get("failure_kind")
        failure = (None, None) if a["outcome"] == "ok" else failure_of(kind or a.get("error") or "")
        calls.append({
            "n": len(calls) + 1, "outcome": a["outcome"], "failure_class": failure[0], "failure_kind": failure[1], "provider": getattr(client, "provider", None) or client.name, "model": client.name,
            "input_tokens": a.get("input_tokens"), "output_tokens": a.get("output_tokens"), "duration_ms": a.get("duration_ms"), "cache_hit": bool(got.get("cache_hit")) if lookup or got.get("cache_hit") else None, "seq": began + i,
        })
    return got
