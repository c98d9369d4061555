"""The boundary between history and the live feed, as a filter and a keyed dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.errors import HandoffError
from strandline.functions.checks import whole
from strandline.operators.dedupe import keep_first


def accept(events: DataFrame, boundary: int, delivered: DataFrame | None = None, order=None) -> DataFrame:
    """Events at or after ``boundary``, each id once, without ids in ``delivered``.

    Rows without an id pass every time.
    """
    rows = events.where(F.col("ledger") >= whole("boundary", boundary, 1, optional=False))
    if delivered is not None:
        rows = rows.join(delivered.select("id").where("id is not null").distinct(), "id", "left_anti").select(*events.columns)
    return keep_first(rows, ["id"], order or [F.col("ledger").asc(), F.col("transactionIndex").asc_nulls_first(), F.col("operationIndex").asc_nulls_first()])


def overlap(history: DataFrame, live: DataFrame, boundary: int) -> DataFrame:
    """History and the live rows from the boundary on, an id from history first."""
    rows = history.withColumn("_source", F.lit(1)).unionByName(live.where(F.col("ledger") >= boundary).withColumn("_source", F.lit(2)))
    return keep_first(rows, ["id"], [F.col("_source").asc(), F.col("ledger").asc()]).drop("_source")


class Handoff:
    """The driver's side: a boundary in the checkpoint store, and the ids delivered at it.

    Only ids of the boundary ledger can repeat between history and live, so only
    they are remembered here; a stream keeps its own state.
    """

    def __init__(self, checkpoint=None, key: str = "handoff"):
        self.checkpoint, self.key = checkpoint, key
        self.boundary: int | None = None
        self.seen: set[str] = set()

    def initialize(self, ledger: int) -> int:
        stored = self.checkpoint.load(self.key) if self.checkpoint else None
        self.boundary = max(whole("ledger", ledger, 1, optional=False), stored or 0)
        self.reset_seen()
        return self.boundary

    def accept(self, event: dict) -> dict | None:
        """The event, or None if it lies below the boundary or was accepted before."""
        if self.boundary is None:
            raise HandoffError("the handoff has no boundary yet")
        if whole("ledger", event.get("ledger"), optional=False) < self.boundary:
            return None
        ident = event.get("id")
        if ident is None:
            return event
        if ident in self.seen:
            return None
        self.seen.add(ident)
        return event

    def accept_many(self, events) -> list[dict]:
        return [x for x in map(self.accept, events) if x is not None]

    def commit(self, ledger: int) -> int:
        if self.boundary is None or whole("ledger", ledger, 1, optional=False) < self.boundary:
            raise HandoffError(f"cannot commit ledger {ledger} below the boundary {self.boundary}")
        if self.checkpoint:
            self.checkpoint.save(ledger, self.key)
        self.boundary = ledger
        return ledger

    def rewind(self, ledger: int) -> int:
        """Moves the boundary back and forgets what was accepted."""
        self.boundary = whole("ledger", ledger, 1, optional=False)
        if self.checkpoint:
            self.checkpoint.rewind(ledger, self.key)
        self.reset_seen()
        return ledger

    def reset_seen(self) -> None:
        self.seen = set()
