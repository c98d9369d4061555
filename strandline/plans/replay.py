"""Replay: stored or source events window by window, in order, resumable."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.errors import ReplayError
from strandline.functions.checks import whole
from strandline.operators.dedupe import order_windows
from strandline.operators.windows import DEFAULT_SPAN, window_list
from strandline.plans.backfill import deliver
from strandline.plans.pipeline import EventPipeline


class EventReplay:
    """``source`` gives events of a range; rows go to ``store`` before they are delivered."""

    def __init__(self, source, store=None, checkpoint=None, pipeline: EventPipeline | None = None):
        self.source, self.store, self.checkpoint, self.pipeline = source, store, checkpoint, pipeline

    def run(self, start_ledger: int, end_ledger: int, *, window_size: int = DEFAULT_SPAN, checkpoint_key: str | None = None, on_event: Callable | None = None, on_batch: Callable[[DataFrame, dict], None] | None = None, cancelled: threading.Event | None = None, **filters) -> dict:
        """A cancelled replay returns what it did, between windows."""
        whole("start_ledger", start_ledger, 1, optional=False), whole("end_ledger", end_ledger, 1, optional=False)
        if end_ledger < start_ledger:
            raise ReplayError("end_ledger must not precede start_ledger")
        first = self.checkpoint.resume_from(start_ledger, checkpoint_key) if self.checkpoint else start_ledger
        summary = {"startLedger": start_ledger, "endLedger": end_ledger, "resumedFrom": first, "windows": 0, "processed": 0, "cancelled": False}
        for low, high in window_list(first, end_ledger, window_size) if first <= end_ledger else []:
            if cancelled is not None and cancelled.is_set():
                summary["cancelled"] = True
                return summary
            rows = order_windows(self.source.events_windowed(low, high, limit=None, **filters))
            if self.store is not None:
                self.store.put(rows.where("id is not null"))
            out = self.pipeline.apply(rows) if self.pipeline else rows
            context = {"startLedger": low, "endLedger": high}
            if on_batch:
                on_batch(out, context)
            summary["processed"] += deliver(out, on_event, context)
            summary["windows"] += 1
            if self.checkpoint:
                self.checkpoint.save(high + 1, checkpoint_key)
        return summary
