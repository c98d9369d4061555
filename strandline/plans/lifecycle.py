"""idle -> running -> (stopping) -> stopped, around streaming queries and jobs."""

from __future__ import annotations

import threading

from strandline.errors import LifecycleError

LIFECYCLE_STATES = ("idle", "running", "stopping", "stopped")


class LifecycleController:
    def __init__(self):
        self.state, self.reason = "idle", None
        self.cancelled = threading.Event()
        self.queries: list = []
        self._lock = threading.Lock()

    def start(self) -> threading.Event:
        """Begins a run; the event it returns is set when the run is to end."""
        with self._lock:
            if self.state in ("running", "stopping"):
                raise LifecycleError(f"cannot start while {self.state}")
            self.state, self.reason = "running", None
            self.cancelled = threading.Event()
            return self.cancelled

    def attach(self, query) -> None:
        """A streaming query that ``stop`` ends with the run."""
        self.queries.append(query)

    def stop(self, reason: str | None = None) -> bool:
        """Ends a run; False if none is under way."""
        with self._lock:
            if self.state != "running":
                return False
            self.state, self.reason = "stopping", reason
        self.cancelled.set()
        for query in self.queries:
            query.stop()
        self.queries.clear()
        self.state = "stopped"
        return True

    def reset(self) -> None:
        with self._lock:
            if self.state in ("running", "stopping"):
                raise LifecycleError(f"cannot reset while {self.state}")
            self.state, self.reason = "idle", None
