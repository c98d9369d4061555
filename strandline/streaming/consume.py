"""Structured Streaming over event tables and page sources.

A micro-batch is handed on in whole ledgers: the checkpoint says ``ledger + 1`` only once
all events of a ledger are delivered. The stream's own offsets live in its
checkpoint folder; a rewind starts a new folder, since offsets cannot go back.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions.checks import whole
from strandline.functions.model import EVENT_SCHEMA
from strandline.operators.handoff import Handoff
from strandline.operators.metrics import Metrics
from strandline.operators.ordering import event_order
from strandline.operators.predicates import event_filter
from strandline.plans.pipeline import EventPipeline


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event files in Parquet."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def page_stream(spark: SparkSession, path: str, start_ledger: int = 1) -> DataFrame:
    """A stream of recorded pages whose offsets are ledgers."""
    from strandline.sources.pages import PagesSource

    spark.dataSource.register(PagesSource)
    return spark.readStream.format("ledger_pages").option("path", path).option("startledger", start_ledger).load()


def stream_dedupe(events: DataFrame, boundary: int = 1, within: str | None = None, time: str = "ledgerClosedAt") -> DataFrame:
    """Each id once from the boundary on, with state kept by Spark.

    State is exact and unbounded by default. ``within`` bounds it by event time: ids that
    return later than that pass again.
    """
    rows = events.where(F.col("ledger") >= boundary)
    if within is None:
        return rows.dropDuplicates(["id"])
    stamped = rows.withColumn("_at", F.to_timestamp(time)).withWatermark("_at", within)
    return stamped.dropDuplicatesWithinWatermark(["id"]).drop("_at")


def start_ledger_of(explicit: int | None, checkpoint, key: str | None, head: Callable[[], int | None]) -> int:
    """An explicit start, else the stored checkpoint, else the head."""
    if explicit is not None:
        return whole("start_ledger", explicit, 1)
    stored = checkpoint.load(key) if checkpoint else None
    return stored if stored is not None else head() or 1


class Consumer:
    """Delivers a stream's events in order, in whole ledgers, to callbacks."""

    def __init__(self, checkpoint=None, checkpoint_key: str | None = None, pipeline: EventPipeline | None = None, handoff: Handoff | None = None, store=None, metrics: Metrics | None = None):
        self.checkpoint, self.key, self.pipeline, self.handoff, self.store = checkpoint, checkpoint_key, pipeline, handoff, store
        self.metrics = metrics or Metrics()
        self.processed = 0

    def batch(self, rows: DataFrame, batch_id: int, on_event: Callable | None = None, on_batch: Callable | None = None, start: int = 1, max_events: int | None = None, cancelled: threading.Event | None = None, condition=None) -> bool:
        """One micro-batch; True if all of it was delivered.

        Store, then delivery, then the checkpoint. A ledger delivered only in part is not
        checkpointed. Dedupe comes before the user's stages, which may change ids.
        """
        rows = rows.where(F.col("ledger") >= start)
        if condition is not None:
            rows = rows.where(condition)
        if self.store is not None:
            self.store.put(rows.where("id is not null"))
        if on_batch is not None:
            on_batch(self.pipeline.apply(rows) if self.pipeline else rows, {"batchId": batch_id})
            if on_event is None:
                top = rows.agg(F.max("ledger"), F.count("*")).first()
                self.processed += top[1]
                self._save(top[0])
                return True
        ledger, whole_ledgers = None, True
        for row in rows.orderBy(*event_order("replay")).toLocalIterator():
            event = row.asDict(recursive=True)
            if ledger is not None and event["ledger"] != ledger:
                self._save(ledger)
            ledger = event["ledger"]
            if (cancelled is not None and cancelled.is_set()) or (max_events is not None and self.processed >= max_events):
                whole_ledgers = False
                break
            if self.handoff is not None and self.handoff.accept(event) is None:
                self.metrics.increment("events_dropped")
                continue
            out = self.pipeline.process(event) if self.pipeline else event
            if out is None:
                self.metrics.increment("events_dropped")
                continue
            if on_event is not None:
                on_event(out, {"batchId": batch_id, "ledger": ledger})
            self.processed += 1
            self.metrics.increment("events_processed")
        if whole_ledgers and ledger is not None:
            self._save(ledger)
        return whole_ledgers

    def _save(self, ledger: int | None) -> None:
        if self.checkpoint is not None and ledger is not None:
            if (self.checkpoint.load(self.key) or 0) <= ledger + 1:
                self.checkpoint.save(ledger + 1, self.key)
                self.metrics.increment("checkpoint_saves")

    def start(self, stream: DataFrame, location: str, on_event=None, on_batch=None, start: int = 1, max_events: int | None = None, cancelled: threading.Event | None = None, poll_interval: str | None = None, condition=None):
        """The running query. Without ``poll_interval`` it takes what is there and ends."""
        writer = stream.writeStream.option("checkpointLocation", location).foreachBatch(lambda rows, n: self._guarded(rows, n, on_event=on_event, on_batch=on_batch, start=start, max_events=max_events, cancelled=cancelled, condition=condition))
        return (writer.trigger(processingTime=poll_interval) if poll_interval else writer.trigger(availableNow=True)).start()

    def _guarded(self, rows: DataFrame, n: int, **how) -> None:
        if (how["cancelled"] is not None and how["cancelled"].is_set()) or (how["max_events"] is not None and self.processed >= how["max_events"]):
            return
        rows.persist()
        try:
            self.batch(rows, n, **how)
        finally:
            rows.unpersist()


def consume(stream: DataFrame, location: str, *, start_ledger: int | None = None, checkpoint=None, checkpoint_key: str | None = None, head: Callable[[], int | None] = lambda: None, on_event=None, on_batch=None, max_events: int | None = None, pipeline=None, handoff=None, store=None, cancelled=None, timeout_s: float | None = None, **filters) -> int:
    """Consumes what the stream has; returns the number of events delivered."""
    start = start_ledger_of(start_ledger, checkpoint, checkpoint_key, head)
    consumer = Consumer(checkpoint, checkpoint_key, pipeline, handoff, store)
    query = consumer.start(stream, location, on_event, on_batch, start, max_events, cancelled, condition=event_filter(**filters) if filters else None)
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    return consumer.processed


def stream_events(events: DataFrame, checkpoint=None, checkpoint_key: str | None = None, start: int = 1) -> Iterator[dict]:
    """A generator over a table; a ledger is checkpointed once the caller asks for more
    than its last event."""
    consumer, ledger = Consumer(checkpoint, checkpoint_key), None
    for row in events.where(F.col("ledger") >= start).orderBy(*event_order("replay")).toLocalIterator():
        if ledger is not None and row["ledger"] != ledger:
            consumer._save(ledger)
        ledger = row["ledger"]
        yield row.asDict(recursive=True)
    consumer._save(ledger)
