"""Calls of a model inside a task: retries with caps per failure, backoff, a deadline, and the response cache."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tallyframe.functions import hashing
from tallyframe.sources.clients import ModelClient, failure_of

#: Most retries in transport per kind of failure; others are not tried again (fixed values of this package).
RETRY_CAPS = {"rate_limited": 3, "provider_unavailable": 3, "connection": 3, "timeout": 2}


@dataclass
class RetryPolicy:
    attempts: int = 4
    base: float = 1.0
    cap: float = 30.0
    timeout: float = 60.0
    deadline: float | None = None  # 3 x timeout where it is None

    def delay(self, retry: int, rng: random.Random) -> float:
        """Full jitter: anything up to the doubled base, never beyond the cap."""
        return rng.uniform(0, min(self.cap, self.base * 2**retry))


@dataclass
class RetryingClient:
    """A client that tries again what may pass, keeps within its deadline, and tells every attempt."""

    client: ModelClient
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    seed: int = 0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    @property
    def name(self) -> str:
        return self.client.name

    def call(self, request: dict) -> dict:
        rng, began, attempts = random.Random(f"{self.seed}|{request.get('prompt', '')}"), self.clock(), []
        limit = self.policy.deadline if self.policy.deadline is not None else 3 * self.policy.timeout
        used: dict[str, int] = {}
        for n in range(1, self.policy.attempts + 1):
            t = self.clock()
            got = self.client.call({**request, "timeout": self.policy.timeout})
            code = got.get("error_code")
            kind = failure_of(code)[1] if code else None
            attempts.append({"n": n, "outcome": "failed" if code else "ok", "failure_kind": kind, "duration_ms": (self.clock() - t) * 1000, "input_tokens": got.get("input_tokens"), "output_tokens": got.get("output_tokens")})
            if not code:
                break
            used[kind] = used.get(kind, 0) + 1
            wait = self.policy.delay(n - 1, rng)
            if used[kind] > RETRY_CAPS.get(kind, 0) or n == self.policy.attempts:
                break
            if self.clock() - began + wait > limit:
                got = {"error_code": "deadline"}
                break
            self.sleep(wait)
        return {**got, "attempts": attempts}


@dataclass
class RateLimitedClient:
    """A client that waits until its share of a rate allows the next call.

    `per_second` is for all tasks that call at once; each of `tasks` takes its part of it, so nothing is shared
    between executors. Up to `burst` calls go out without a wait."""

    client: ModelClient
    per_second: float
    tasks: int = 1
    burst: int = 1
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _free: float | None = None

    @property
    def name(self) -> str:
        return self.client.name

    def call(self, request: dict) -> dict:
        gap, now = self.tasks / self.per_second, self.clock()
        self._free = now - gap * (self.burst - 1) if self._free is None else max(self._free, now - gap * (self.burst - 1))
        if self._free > now:
            self.sleep(self._free - now)
        self._free += gap
        return self.client.call(request)


@dataclass
class CachedClient:
    """Answers from recorded responses. Modes: off, readwrite (misses are called and recorded), replay (a miss is an error).

    Only deterministic requests (temperature up to `max_temperature`) and whole answers are recorded.
    `entries` starts as the rows of the cache table that a task got; new ones are `recorded`."""

    client: ModelClient
    entries: dict[str, dict]
    mode: str = "readwrite"
    scope: str = ""
    provider: str = ""
    endpoint: str = ""
    max_temperature: float = 0.0
    recorded: dict[str, dict] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.client.name

    def key(self, request: dict) -> str:
        return hashing.cache_key(request, self.provider, self.client.name, self.endpoint, self.scope)

    def call(self, request: dict) -> dict:
        if self.mode == "off" or request.get("temperature", 0.0) > self.max_temperature:
            return self.client.call(request)
        key = self.key(request)
        if key in self.entries:
            return {**self.entries[key], "cache_hit": True}
        if self.mode == "replay":
            return {"error_code": "cache_miss"}
        got = self.client.call(request)
        if not got.get("error_code") and got.get("stop_reason") in (None, "end_turn", "stop_sequence"):
            self.entries[key] = self.recorded[key] = {k: v for k, v in got.items() if k != "attempts"}
        return got
