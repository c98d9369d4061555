"""Backfill: a ledger range from a source to a store and a pipeline, in checkpointed groups.

A group of windows is one distributed job; the checkpoint moves past a group only once
its rows are stored and delivered, so the finished part is always a prefix of the range
and a restart repeats at most one group (delivery is at least once).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strandline.errors import AbortError, BackfillError
from strandline.functions.checks import span, whole
from strandline.operators.dedupe import keep_first
from strandline.operators.metrics import Metrics
from strandline.operators.ordering import event_order
from strandline.operators.windows import DEFAULT_SPAN, window_list
from strandline.plans.pipeline import EventPipeline


def deliver(events: DataFrame, on_event: Callable | None, context: dict) -> int:
    """Calls ``on_event(event, context)`` in order, one partition in memory at a time;
    without a callback the rows are only counted."""
    if on_event is None:
        return events.count()
    n = 0
    for row in events.orderBy(*event_order("replay")).toLocalIterator():
        on_event(row.asDict(recursive=True), context)
        n += 1
    return n


class BackfillEngine:
    def __init__(self, source, store=None, checkpoint=None, pipeline: EventPipeline | None = None, metrics: Metrics | None = None):
        self.source, self.store, self.checkpoint, self.pipeline = source, store, checkpoint, pipeline
        self.metrics = metrics or Metrics()

    def run(
        self, start_ledger: int, end_ledger: int, *, window_size: int = DEFAULT_SPAN, concurrency: int = 1, dedupe: bool = True, checkpoint_key: str | None = None,
        on_event: Callable | None = None, on_batch: Callable[[DataFrame, dict], None] | None = None, on_progress: Callable[[dict], None] | None = None, cancelled: threading.Event | None = None, **filters,
    ) -> dict:
        """``concurrency`` windows form a group. Rows are stored before the pipeline sees them.

        ``on_batch`` gets each group's rows as a DataFrame; ``on_event`` single events in order.
        """
        span(whole("start_ledger", start_ledger, 1, optional=False), whole("end_ledger", end_ledger, 1, optional=False))
        whole("concurrency", concurrency, 1, optional=False)
        first = self.checkpoint.resume_from(start_ledger, checkpoint_key) if self.checkpoint else start_ledger
        summary = {"startLedger": start_ledger, "endLedger": end_ledger, "resumedFrom": first, "windows": 0, "events": 0, "processed": 0, "completed": first > end_ledger}
        if first > end_ledger:
            return summary
        windows, began = window_list(first, end_ledger, window_size), time.perf_counter()
        for at in range(0, len(windows), concurrency):
            if cancelled is not None and cancelled.is_set():
                raise BackfillError("the backfill was cancelled", cause=AbortError(partial=summary))
            group = windows[at : at + concurrency]
            low, high = group[0][0], group[-1][1]
            rows = self.source.events_windowed(low, high, limit=None, **filters) if dedupe else self.source.events.where(F.col("ledger").between(low, high))
            self._group(rows, {"startLedger": low, "endLedger": high}, summary, on_event, on_batch)
            summary["windows"] += len(group)
            if self.checkpoint:
                self.checkpoint.save(high + 1, checkpoint_key)
                self.metrics.increment("checkpoint_saves")
            if on_progress:
                on_progress(dict(summary) | {"window": (low, high), "remaining": len(windows) - summary["windows"]})
        summary["completed"] = True
        self.metrics.observe("backfill_duration_ms", (time.perf_counter() - began) * 1000)
        return summary

    def _group(self, rows: DataFrame, context: dict, summary: dict, on_event, on_batch) -> None:
        if self.store is not None:
            summary["events"] += self.store.put(rows.where("id is not null"))
        else:
            summary["events"] += rows.count()
        self.metrics.counter("events_fetched", 0)
        out = self.pipeline.apply(rows) if self.pipeline else rows
        if on_batch:
            on_batch(out, context)
        n = deliver(out, on_event, context)
        summary["processed"] += n
        self.metrics.counter("events_processed", n)


def order_backfill_events(*results: DataFrame) -> DataFrame:
    """Window results in replay order, the first of each id, id-less rows kept."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    return keep_first(rows, ["id"], event_order("replay")).orderBy(*event_order("replay"))
