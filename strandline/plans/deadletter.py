"""Dead letters: failed events with error, context and attempts."""

from __future__ import annotations

from collections import OrderedDict
from datetime import datetime, timezone
from itertools import count
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.errors import DeadLetterError

MAX_ENTRIES = 10_000


@runtime_checkable
class DeadLetterQueue(Protocol):
    def add(self, event, error=None, context=None): ...
    def get(self, ident: str): ...
    def list(self, limit: int | None = None): ...
    def remove(self, ident: str) -> bool: ...
    def retry(self, ident: str): ...
    def clear(self) -> None: ...


def is_dead_letter_queue(x) -> bool:
    return isinstance(x, DeadLetterQueue)


class MemoryDeadLetterQueue:
    """A bounded queue of the driver: an id again replaces its entry in place."""

    def __init__(self, max_entries: int = MAX_ENTRIES):
        if isinstance(max_entries, bool) or not isinstance(max_entries, int) or max_entries < 1:
            raise ValueError("max_entries must be a positive integer")
        self.max_entries, self._entries, self._numbers = max_entries, OrderedDict(), count(1)

    def add(self, event, error=None, context=None) -> dict:
        if isinstance(error, DeadLetterError):
            event, context = event or error.event, context or error.context
        ident = (event or {}).get("id") or f"dead-{next(self._numbers)}"
        before = self._entries.get(ident)
        entry = {"id": ident, "event": event, "error": str(error) if error is not None else None, "context": context, "attempts": before["attempts"] if before else 0, "createdAt": datetime.now(timezone.utc).isoformat()}
        self._entries[ident] = entry
        while len(self._entries) > self.max_entries:
            self._entries.popitem(last=False)
        return dict(entry)

    def get(self, ident: str) -> dict | None:
        return dict(self._entries[ident]) if ident in self._entries else None

    def list(self, limit: int | None = None) -> list[dict]:
        """The newest ``limit`` entries, in order of insertion."""
        entries = [dict(x) for x in self._entries.values()]
        return entries if limit is None else entries[max(0, len(entries) - limit) :] if limit > 0 else []

    def remove(self, ident: str) -> bool:
        return self._entries.pop(ident, None) is not None

    def retry(self, ident: str) -> dict | None:
        """Counts another attempt; it does not run anything."""
        if ident not in self._entries:
            return None
        self._entries[ident]["attempts"] += 1
        return self.get(ident)

    def clear(self) -> None:
        self._entries.clear()

    @property
    def size(self) -> int:
        return len(self._entries)


def latest_letters(letters: DataFrame, max_entries: int | None = None, limit: int | None = None) -> DataFrame:
    """The queue's content from an append-only table (id, seq, ...): the last row of an id,
    at the place of its first. ``max_entries`` and ``limit`` keep the newest places."""
    by_id = W.partitionBy("id")
    rows = letters.withColumn("position", F.min("seq").over(by_id)).withColumn("_last", F.row_number().over(by_id.orderBy(F.col("seq").desc()))).where("_last = 1").drop("_last")
    most = min(x for x in (max_entries, limit, 1 << 60) if x is not None)
    return rows.orderBy(F.col("position").desc()).limit(most) if most < 1 << 60 else rows
