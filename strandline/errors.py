"""Errors of the engine. Bad arguments raise TypeError or ValueError instead."""


class EngineError(Exception):
    """Base of all engine errors; ``code`` names a machine-readable cause."""

    code: str | None = None

    def __init__(self, message: str = "", *, code: str | None = None, cause: BaseException | None = None):
        super().__init__(message)
        self.code = code or self.code
        if cause is not None:
            self.__cause__ = cause


class ScValDepthError(EngineError):
    """A value is nested deeper than allowed."""

    def __init__(self, depth: int):
        super().__init__(f"value is nested deeper than {depth} levels")
        self.depth = depth


class CheckpointError(EngineError):
    """A checkpoint would move backwards, cannot rewind, or is corrupt."""


class PipelineError(EngineError):
    """A stage failed; ``stage_index`` says which."""

    def __init__(self, message: str, *, stage_index: int | None = None, cause: BaseException | None = None):
        super().__init__(message, cause=cause)
        self.stage_index = stage_index


class BackfillError(EngineError):
    """A backfill was cancelled or its checkpoint is unusable."""


class ReplayError(EngineError):
    """A replay range ends before it starts."""


class HandoffError(EngineError):
    """A handoff would be committed below its boundary."""


class EventStoreError(EngineError):
    """The event store cannot be used."""


class ConsistencyError(EngineError):
    """Ledgers regress, conflict, leave a gap or break a hash link."""


class MetricsError(EngineError):
    """Metrics cannot be combined."""


class ReorgError(EngineError):
    """Recovery from a reorganisation failed."""


class ReorgMonitorError(EngineError):
    """The reorganisation monitor failed."""


class LiveBackfillError(EngineError):
    """The head is unusable or lies before the start."""


class EventEngineError(EngineError):
    """The engine is misused."""


class LifecycleError(EngineError):
    """An illegal lifecycle transition."""


class CircuitOpenError(EngineError):
    """A request was refused while the circuit is open."""

    code = "RPC_CIRCUIT_OPEN"


class AbortError(EngineError):
    """Work was cancelled; ``partial`` holds what was done."""

    code = "ABORTED"

    def __init__(self, message: str = "cancelled", *, partial: dict | None = None):
        super().__init__(message)
        self.partial = partial or {}


class DeadLetterError(EngineError):
    """Carries a failed event to a dead-letter queue."""

    def __init__(self, message: str, *, event=None, context=None, cause: BaseException | None = None):
        super().__init__(message, cause=cause)
        self.event, self.context = event, context
