"""Metrics: DataFrame aggregates, and a registry with text exposition."""

from __future__ import annotations

import math
import re
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, functions as F

from strandline.errors import MetricsError


def histogram(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, sum, min and max of a column, in all or by keys; combines map-side."""
    aggs = [F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def merge_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, name, count, sum, min, max) of two registries: counters and histograms
    add up, a gauge takes the right side's value where it has one."""
    rows = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    gauge = F.col("kind") == "gauge"
    last = F.max_by("sum", "_side")
    return rows.groupBy("kind", "name").agg(
        F.when(F.first(gauge), F.lit(1)).otherwise(F.sum("count")).cast("long").alias("count"),
        F.when(F.first(gauge), last).otherwise(F.sum("sum")).alias("sum"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )


def observed(rows: DataFrame, name: str, value: str | None = None) -> tuple[DataFrame, Observation]:
    """``rows`` with a counter (and histogram) taken as they flow by, at no extra pass."""
    seen = Observation(name)
    aggs = [F.count(F.lit(1)).alias("count")]
    if value:
        aggs += [F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")]
    return rows.observe(seen, *aggs), seen


def _number(name: str, x) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise TypeError(f"{name} must be a finite number")
    return x


class Metrics:
    """Counters, gauges and histograms (count, sum, min, max) by name."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.counters: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self.histograms: dict[str, dict] = {}

    def counter(self, name: str, value: float = 1) -> float:
        if _number("value", value) < 0:
            raise ValueError("a counter only grows")
        self.counters[name] = self.counters.get(name, 0) + value
        return self.counters[name]

    increment = counter

    def get_counter(self, name: str) -> float:
        return self.counters.get(name, 0)

    def gauge(self, name: str, value: float) -> float:
        self.gauges[name] = _number("value", value)
        return value

    set_gauge = gauge

    def add_gauge(self, name: str, value: float) -> float:
        return self.gauge(name, self.gauges.get(name, 0) + _number("value", value))

    def get_gauge(self, name: str) -> float | None:
        return self.gauges.get(name)

    def observe(self, name: str, value: float) -> dict:
        _number("value", value)
        h = self.histograms.setdefault(name, {"count": 0, "sum": 0, "min": value, "max": value})
        h.update(count=h["count"] + 1, sum=h["sum"] + value, min=min(h["min"], value), max=max(h["max"], value))
        return dict(h)

    def get_histogram(self, name: str) -> dict | None:
        return dict(self.histograms[name]) if name in self.histograms else None

    def timer(self, name: str):
        """A function that records the milliseconds since now, once; later calls give None."""
        began, done = time.perf_counter(), []

        def stop() -> float | None:
            if done:
                return None
            done.append(True)
            taken = (time.perf_counter() - began) * 1000
            self.observe(name, taken)
            return taken

        return stop

    @contextmanager
    def time(self, name: str):
        stop = self.timer(name)
        try:
            yield
        finally:
            stop()

    def absorb(self, seen: Observation, name: str, value: bool = False) -> None:
        """Adds what an observation of a finished job counted."""
        got = seen.get
        self.counter(name, got["count"])
        if value and got["count"]:
            self._combine(f"{name}_values", {k: got[k] for k in ("count", "sum", "min", "max")})

    def _combine(self, name: str, h: dict) -> None:
        if set(h) != {"count", "sum", "min", "max"} or h["count"] < 0:
            raise MetricsError(f"histogram {name} cannot be merged")
        if not h["count"]:
            return
        have = self.histograms.setdefault(name, {"count": 0, "sum": 0, "min": h["min"], "max": h["max"]})
        have.update(count=have["count"] + h["count"], sum=have["sum"] + h["sum"], min=min(have["min"], h["min"]), max=max(have["max"], h["max"]))

    def merge(self, other: Metrics) -> Metrics:
        """Adds another registry: counters and histograms combine, gauges are overwritten."""
        if not isinstance(other, Metrics):
            raise TypeError("other must be Metrics")
        for name, value in other.counters.items():
            self.counter(name, value)
        self.gauges.update(other.gauges)
        for name, h in other.histograms.items():
            self._combine(name, h)
        return self

    def snapshot(self) -> dict:
        return {"counters": dict(self.counters), "gauges": dict(self.gauges), "histograms": {k: dict(v) for k, v in self.histograms.items()}}

    def to_prometheus(self, prefix: str = "") -> str:
        """Text exposition; histograms appear as summaries with their bounds."""
        out = []
        label = lambda n: re.sub(r"^(?=\d)", "_", re.sub(r"[^a-zA-Z0-9_:]", "_", prefix + n))
        for kind, series in (("counter", self.counters), ("gauge", self.gauges)):
            for name in sorted(series):
                out += [f"# TYPE {label(name)} {kind}", f"{label(name)} {series[name]:g}" if isinstance(series[name], float) else f"{label(name)} {series[name]}"]
        for name in sorted(self.histograms):
            out.append(f"# TYPE {label(name)} summary")
            out += [f"{label(name)}_{k} {self.histograms[name][k]}" for k in ("count", "sum", "min", "max")]
        return "\n".join(out) + "\n" if out else ""


def create_metrics() -> Metrics:
    return Metrics()
