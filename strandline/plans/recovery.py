"""Recovery from reorganisations, and the monitor that looks for them."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.errors import ReorgError
from strandline.functions.checks import whole
from strandline.operators.reorg import compare_ledgers, detect, plan


class ReorgRecovery:
    """Rewinds the checkpoint, then deletes the invalid range: a crash in between only
    replays ledgers that are still stored."""

    def __init__(self, checkpoint=None, store=None, handoff=None):
        self.checkpoint, self.store, self.handoff = checkpoint, store, handoff

    detect = staticmethod(detect)
    plan = staticmethod(plan)

    def recover(self, affected: int, latest_verified: int, depth: int = 1, checkpoint_key: str | None = None) -> dict:
        steps = plan(affected, latest_verified, depth)
        try:
            if self.checkpoint:
                self.checkpoint.rewind(steps["rewind_to"], checkpoint_key)
            if self.handoff is not None and self.handoff.boundary is not None:
                self.handoff.rewind(steps["rewind_to"])
        except Exception as error:
            raise ReorgError(f"rewind failed: {error}", cause=error) from error
        try:
            deleted = self.store.delete_range(*steps["invalidate"]) if self.store is not None else 0
        except Exception as error:
            raise ReorgError(f"deleting the invalid range failed: {error}", cause=error) from error
        return steps | {"deleted": deleted}


class ReorgMonitor:
    """Compares ledgers seen before with the source's last ``lookback`` ledgers."""

    def __init__(self, source, recovery: ReorgRecovery | None = None, lookback: int = 100):
        self.source, self.recovery = source, recovery
        self.lookback = whole("lookback", lookback, 1, optional=False)

    def compare(self, expected: DataFrame) -> DataFrame:
        return compare_ledgers(expected, self.source.ledgers, self.lookback)

    def check(self, expected: dict) -> dict:
        """The outcome for one ledger; ``no-history`` without ledgers in the window."""
        head = self.source.latest_ledger()
        if head is None:
            return {"detected": False, "reason": "no-history", "expected": expected, "actual": None}
        low = max(1, head - self.lookback + 1)
        if not low <= expected["sequence"] <= head:
            return {"detected": False, "reason": "expected-ledger-outside-window", "expected": expected, "actual": None}
        row = self.source.ledgers.where(self.source.ledgers["sequence"] == expected["sequence"]).first()
        if row is None:
            return {"detected": False, "reason": "expected-ledger-outside-window", "expected": expected, "actual": None}
        return detect(expected, row.asDict())

    def check_and_recover(self, expected: dict, depth: int = 1) -> dict:
        found = self.check(expected)
        if found["detected"] and self.recovery is not None:
            found["recovery"] = self.recovery.recover(expected["sequence"], max(expected["sequence"], self.source.latest_ledger()), depth)
        return found

    def monitor(self, expected: Callable[[], dict | None], on_result: Callable[[dict], None], interval_s: float = 3.0, cancelled: threading.Event | None = None, rounds: int | None = None) -> int:
        """Checks again and again until cancelled; returns the number of checks."""
        cancelled, n = cancelled or threading.Event(), 0
        while not cancelled.is_set() and (rounds is None or n < rounds):
            known = expected()
            if known is not None:
                on_result(self.check_and_recover(known))
            n += 1
            if rounds is None or n < rounds:
                cancelled.wait(interval_s)
        return n
