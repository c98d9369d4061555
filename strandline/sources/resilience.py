"""Requests with retries, back-off, a circuit breaker per endpoint, and failover.

State lives in one process: in a task of the connector, or on the driver.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from strandline.errors import AbortError, CircuitOpenError
from strandline.operators.metrics import Metrics

#: What error texts say of a passing failure.
TRANSIENT_WORDS = ("timeout", "timed out", "econnreset", "connection reset", "socket")


def classify_error(error: BaseException) -> str:
    """rate_limit, transient or fatal."""
    status = getattr(error, "status", None) or getattr(error, "code", None)
    if status == 429:
        return "rate_limit"
    if isinstance(status, int) and status >= 500:
        return "transient"
    if isinstance(error, (TimeoutError, ConnectionError)) or any(w in str(error).lower() for w in TRANSIENT_WORDS):
        return "transient"
    return "fatal"


@dataclass
class Retry:
    """Exponential back-off: doubled for rate limits, jittered, capped."""

    retries: int = 3
    base_s: float = 0.5
    cap_s: float = 30.0
    jitter: float = 0.2
    seed: int | None = None

    def __post_init__(self):
        self.random = random.Random(self.seed)

    def delay(self, attempt: int, kind: str, slow: float = 1.0) -> float:
        wait = self.base_s * 2**attempt * (2 if kind == "rate_limit" else 1) * slow
        return min(self.cap_s, wait * (1 + self.jitter * (2 * self.random.random() - 1)))


@dataclass
class Circuit:
    """Opens after so many failures in a row, lets one request try after the cooldown."""

    threshold: int = 3
    cooldown_s: float = 30.0
    failures: int = 0
    opened_at: float | None = None
    clock: Callable[[], float] = time.monotonic

    def is_open(self) -> bool:
        return self.opened_at is not None and self.clock() - self.opened_at < self.cooldown_s

    @property
    def half_open(self) -> bool:
        return self.opened_at is not None and not self.is_open()

    def failed(self) -> bool:
        """Counts a failure; True if that opens the circuit."""
        self.failures += 1
        if self.failures >= self.threshold or self.half_open:
            self.opened_at = self.clock()
            return True
        return False

    def succeeded(self) -> None:
        self.failures, self.opened_at = 0, None


@dataclass
class Requester:
    """Sends ``call(endpoint, request)`` to the current endpoint under the rules above."""

    endpoints: list
    call: Callable
    retry: Retry = field(default_factory=Retry)
    threshold: int = 3
    cooldown_s: float = 30.0
    metrics: Metrics = field(default_factory=Metrics)
    clock: Callable[[], float] = time.monotonic
    cancelled: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self):
        if not self.endpoints:
            raise ValueError("at least one endpoint is needed")
        self.circuits = [Circuit(self.threshold, self.cooldown_s, clock=self.clock) for _ in self.endpoints]
        self.at, self.slow = 0, 1.0

    def switch(self) -> bool:
        """Moves on to the next endpoint, round robin."""
        if len(self.endpoints) < 2:
            return False
        self.at = (self.at + 1) % len(self.endpoints)
        self.metrics.increment("rpc_failovers")
        return True

    def _wait(self, seconds: float) -> None:
        if self.cancelled.wait(seconds):
            raise AbortError("the request was cancelled")

    def _ready(self) -> Circuit:
        for _ in self.endpoints:
            circuit = self.circuits[self.at]
            if not circuit.is_open():
                if circuit.half_open:
                    self.metrics.increment("rpc_circuit_half_open")
                return circuit
            if not self.switch():
                break
        raise CircuitOpenError("all endpoints failed lately")

    def request(self, request):
        self.metrics.increment("rpc_requests")
        for attempt in range(self.retry.retries + 1):
            if self.cancelled.is_set():
                raise AbortError("the request was cancelled")
            circuit = self._ready()
            self.metrics.increment("rpc_attempts")
            began = time.perf_counter()
            try:
                answer = self.call(self.endpoints[self.at], request)
            except Exception as error:
                kind = classify_error(error)
                self.metrics.increment("rpc_errors")
                if kind == "fatal":
                    raise
                if kind == "rate_limit":
                    self.metrics.increment("rpc_rate_limits")
                    self.slow = min(self.slow * 2, 16.0)
                elif circuit.failed():
                    self.metrics.increment("rpc_circuit_open")
                    self.switch()
                if attempt == self.retry.retries:
                    raise
                self.metrics.increment("rpc_retries")
                self._wait(self.retry.delay(attempt, kind, self.slow))
            else:
                circuit.succeeded()
                self.slow = max(1.0, self.slow / 2)
                self.metrics.observe("rpc_request_duration_ms", (time.perf_counter() - began) * 1000)
                return answer
        raise AssertionError("unreachable")
