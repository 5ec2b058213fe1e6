"""Settings with their limits; a setting outside them is an error when it is made, not when a message meets it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be above zero")


@dataclass(frozen=True)
class FlowOptions:
    max_in_flight: int = 100
    max_in_flight_bytes: int = 64 << 20
    queue_capacity: int = 1000

    def __post_init__(self):
        _positive(max_in_flight=self.max_in_flight, max_in_flight_bytes=self.max_in_flight_bytes, queue_capacity=self.queue_capacity)


@dataclass(frozen=True)
class PublishOptions:
    max_pending: int = 10_000
    max_pending_bytes: int = 256 << 20

    def __post_init__(self):
        _positive(max_pending=self.max_pending, max_pending_bytes=self.max_pending_bytes)


@dataclass(frozen=True)
class OutboxOptions:
    batch: int = 100
    poll_seconds: float = 1.0
    lock_seconds: float = 30.0
    retention_seconds: float = 7 * 86_400.0

    def __post_init__(self):
        _positive(batch=self.batch, poll_seconds=self.poll_seconds, lock_seconds=self.lock_seconds, retention_seconds=self.retention_seconds)
        if self.batch > 10_000:
            raise ValueError("batch must be 10000 at most")
        if self.retention_seconds <= self.lock_seconds:
            raise ValueError("retention_seconds must be above lock_seconds")


@dataclass(frozen=True)
class RetryPolicy:
    """kind is interval, incremental or exponential."""

    kind: str
    most: int
    first_ms: int
    step_ms: int = 0
    max_ms: int = 0

    def __post_init__(self):
        if self.kind not in ("interval", "incremental", "exponential"):
            raise ValueError("no such retry policy")
        if self.most < 0 or self.first_ms < 0:
            raise ValueError("attempts and delays must not be negative")
        if self.kind == "exponential" and self.max_ms < self.first_ms:
            raise ValueError("max_ms must be first_ms at least")

    def delay(self, attempt: Column, jitter: Column | None = None) -> Column:
        from . import limits

        if self.kind == "interval":
            return limits.interval_delay(attempt, self.first_ms)
        if self.kind == "incremental":
            return limits.incremental_delay(attempt, self.first_ms, self.step_ms)
        return limits.exponential_delay(attempt, self.first_ms, self.max_ms, jitter)


def endpoint_errors(endpoints: DataFrame) -> DataFrame:
    """(endpoint, error) of bindings (endpoint, consumers, prefetch, concurrency, transport) that cannot run; one row for each fault."""
    checks = [("no consumer", F.coalesce("consumers", F.lit(0)) < 1), ("prefetch must be above zero", F.coalesce("prefetch", F.lit(0)) <= 0), ("concurrency must be above zero", F.coalesce("concurrency", F.lit(1)) <= 0), ("no transport", F.coalesce("transport", F.lit("")) == "")]
    faults = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in checks]), lambda x: x.isNotNull())
    return endpoints.select("endpoint", F.explode(faults).alias("error"))
