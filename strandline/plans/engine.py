"""Live backfill and the engine: history up to the head, then the stream, each id once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import functions as F

from strandline.errors import LiveBackfillError
from strandline.functions.checks import whole
from strandline.operators.handoff import Handoff
from strandline.operators.metrics import Metrics
from strandline.plans.backfill import BackfillEngine
from strandline.plans.checkpoint import CheckpointManager
from strandline.plans.lifecycle import LifecycleController
from strandline.plans.recovery import ReorgMonitor, ReorgRecovery
from strandline.plans.replay import EventReplay
from strandline.streaming.consume import Consumer


class LiveBackfillEngine:
    """Backfills through the head, then reads the stream from the head ledger on.

    All history is delivered. Only ids of the boundary ledger are remembered: the
    sole ledger that both sides read.
    """

    def __init__(self, source, store=None, checkpoint: CheckpointManager | None = None, pipeline=None, metrics: Metrics | None = None):
        self.source, self.store, self.checkpoint, self.pipeline = source, store, checkpoint, pipeline
        self.metrics = metrics or Metrics()
        self.handoff = Handoff(checkpoint)

    def establish_boundary(self, start_ledger: int) -> int:
        head = self.source.latest_ledger()
        if head is None or head < 1:
            raise LiveBackfillError("the source has no head")
        if head < start_ledger:
            raise LiveBackfillError(f"the head {head} lies before the start {start_ledger}")
        return self.handoff.initialize(head)

    def backfill_to_boundary(self, start_ledger: int, on_event=None, **how) -> dict:
        boundary = self.handoff.boundary
        engine = BackfillEngine(self.source, self.store, self.checkpoint, self.pipeline, self.metrics)
        summary = engine.run(start_ledger, boundary, on_event=on_event, **how)
        ids = self.source.events.where((F.col("ledger") == boundary) & F.col("id").isNotNull()).select("id")
        self.handoff.seen.update(r.id for r in ids.toLocalIterator())  # one ledger's ids
        return summary

    def commit_boundary(self) -> int:
        return self.handoff.commit(self.handoff.boundary)

    def consume_live(self, stream, location: str, on_event=None, **how) -> int:
        consumer = Consumer(self.checkpoint, "live", self.pipeline, self.handoff, self.store, self.metrics)
        consumer.start(stream, location, on_event, start=self.handoff.boundary, **how).awaitTermination()
        return consumer.processed

    def run(self, start_ledger: int, stream, location: str, on_event: Callable | None = None, max_events: int | None = None, **how) -> dict:
        whole("start_ledger", start_ledger, 1, optional=False)
        boundary = self.establish_boundary(start_ledger)
        history = self.backfill_to_boundary(start_ledger, on_event, **how)
        self.commit_boundary()
        live = self.consume_live(stream, location, on_event, max_events=max_events)
        return {"boundary": boundary, "backfill": history, "live": live}


class EventEngine:
    """One facade over source, store, checkpoint, pipeline, handoff, recovery and metrics."""

    def __init__(self, source, store=None, checkpoint: CheckpointManager | None = None, pipeline=None, metrics: Metrics | None = None, lookback: int = 100):
        for need in ("events_windowed", "latest_ledger", "health"):
            if not hasattr(source, need):
                raise TypeError(f"a source has {need}")
        self.source, self.store, self.pipeline = source, store, pipeline
        self.checkpoint = checkpoint or CheckpointManager()
        self.metrics, self.lifecycle = metrics or Metrics(), LifecycleController()
        self.live = LiveBackfillEngine(source, store, self.checkpoint, pipeline, self.metrics)
        self.handoff = self.live.handoff
        self.recovery = ReorgRecovery(self.checkpoint, store, self.handoff)
        self.monitor = ReorgMonitor(source, self.recovery, lookback)

    def _counted(self, what: str, work: Callable):
        self.metrics.increment(f"engine_{what}_runs")
        try:
            with self.metrics.time(f"engine_{what}_duration_ms"):
                out = work()
        except Exception:
            self.metrics.increment(f"engine_{what}_errors")
            raise
        self.metrics.increment(f"engine_{what}_completed")
        return out

    def backfill(self, start_ledger: int, end_ledger: int, **how) -> dict:
        engine = BackfillEngine(self.source, self.store, self.checkpoint, self.pipeline, self.metrics)
        return self._counted("backfill", lambda: engine.run(start_ledger, end_ledger, **how))

    def replay_events(self, start_ledger: int, end_ledger: int, **how) -> dict:
        replay = EventReplay(self.source, self.store, self.checkpoint, self.pipeline)
        return self._counted("replay", lambda: replay.run(start_ledger, end_ledger, checkpoint_key="replay", **how))

    def establish_handoff(self, ledger: int | None = None) -> int:
        boundary = self.handoff.initialize(ledger if ledger is not None else self.source.latest_ledger())
        self.metrics.increment("engine_handoffs_initialized")
        self.metrics.gauge("engine_handoff_boundary_ledger", boundary)
        return boundary

    def commit_handoff(self, ledger: int | None = None) -> int:
        self.metrics.increment("engine_handoffs_committed")
        return self.handoff.commit(ledger if ledger is not None else self.handoff.boundary)

    def consume(self, stream, location: str, on_event=None, start_ledger: int | None = None, **how) -> int:
        self.metrics.increment("engine_live_consumers")
        gate = self.handoff if self.handoff.boundary is not None else None
        consumer = Consumer(self.checkpoint, "live", self.pipeline, gate, self.store, self.metrics)
        query = consumer.start(stream, location, on_event, start=start_ledger or self.handoff.boundary or 1, cancelled=self.lifecycle.cancelled, **how)
        self.lifecycle.attach(query)
        query.awaitTermination()
        return consumer.processed

    def check_reorg(self, expected: dict) -> dict:
        self.metrics.increment("engine_reorg_checks")
        try:
            found = self.monitor.check_and_recover(expected)
        except Exception:
            self.metrics.increment("engine_reorg_errors")
            raise
        if "recovery" in found:
            self.metrics.increment("engine_reorg_recoveries")
            self.metrics.gauge("engine_recovery_rewind_ledger", found["recovery"]["rewind_to"])
        return found

    def watch_reorg(self, expected: Callable[[], dict | None], on_result: Callable[[dict], None] = lambda _: None, interval_s: float = 3.0, rounds: int | None = None) -> int:
        stop = self.lifecycle.cancelled or threading.Event()
        n = 0
        while not stop.is_set() and (rounds is None or n < rounds):
            known = expected()
            if known is not None:
                on_result(self.check_reorg(known))
            n += 1
            if rounds is None or n < rounds:
                stop.wait(interval_s)
        return n

    def recover(self, affected: int, latest_verified: int, depth: int = 1) -> dict:
        out = self.recovery.recover(affected, latest_verified, depth)
        self.metrics.increment("engine_recoveries")
        self.metrics.gauge("engine_recovery_rewind_ledger", out["rewind_to"])
        return out

    def start(self, start_ledger: int, stream, location: str, on_event=None, **how) -> dict:
        """Backfill to the head, hand off, consume; stops the lifecycle on errors."""
        self.lifecycle.start()
        try:
            boundary = self.live.establish_boundary(start_ledger)
            self.metrics.gauge("engine_handoff_boundary_ledger", boundary)
            history = self._counted("backfill", lambda: self.live.backfill_to_boundary(start_ledger, on_event, cancelled=self.lifecycle.cancelled))
            self.commit_handoff()
            live = self.consume(stream, location, on_event, **how)
        except Exception:
            self.lifecycle.stop("error")
            raise
        return {"boundary": boundary, "backfill": history, "live": live}

    def stop(self, reason: str | None = None) -> bool:
        return self.lifecycle.stop(reason)
