"""Scans over event and ledger tables: ranges, newest events, head, health and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions.checks import span, whole
from strandline.functions.model import EVENT_SCHEMA, LEDGER_SCHEMA, decode_events, decode_ledgers
from strandline.operators.consistency import require_consistent, verify_history
from strandline.operators.dedupe import keep_first
from strandline.operators.ordering import event_order, newest
from strandline.operators.predicates import event_filter, with_buckets
from strandline.operators.windows import MAX_SAFE_SPAN

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 1_000, 10_000
TAIL_LOOKBACK = 50_000


def source_options(window_size: int = MAX_SAFE_SPAN, page_size: int = DEFAULT_PAGE_SIZE, **retry) -> dict:
    """Checked connector options; the window is clamped to what a source serves at once."""
    whole("window_size", window_size, 1, optional=False), whole("page_size", page_size, 1, optional=False)
    if page_size > MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be at most {MAX_PAGE_SIZE}")
    return {"windowsize": min(window_size, MAX_SAFE_SPAN), "pagesize": page_size, **retry}


def read_parquet_events(spark: SparkSession, path: str) -> DataFrame:
    """A stored event table; ``ledger_bucket`` prunes its folders."""
    return spark.read.parquet(path)


class EventSource:
    """One protocol for batch work and recovery: events, ledgers, head, health.

    ``events`` and ``ledgers`` are tables (raw or decoded); nothing is read before
    an action. ``arrival`` names the column of arrival order, if there is one.
    """

    def __init__(self, events: DataFrame, ledgers: DataFrame | None = None, arrival: str | None = None):
        if not isinstance(events, DataFrame):
            raise TypeError("events must be a DataFrame")
        self.raw, self.arrival = events, arrival
        decoded = [f.name for f in EVENT_SCHEMA]
        self.events = events if all(c in events.columns for c in decoded) else decode_events(events)
        self.ledgers = None if ledgers is None else decode_ledgers(ledgers)

    def events_windowed(self, start_ledger: int, end_ledger: int | None = None, limit: int | None = DEFAULT_PAGE_SIZE // 10, **filters) -> DataFrame:
        """Events of an inclusive range: ids required, an id once, then the limit.

        An open end is the head: a stored table ends there by itself.
        """
        start, end = span(whole("start_ledger", start_ledger, 1, optional=False), end_ledger)
        rows = with_buckets(self.events, event_filter(start_ledger=start, end_ledger=end, **filters), start, end)
        order = [F.col(self.arrival)] if self.arrival and self.arrival in rows.columns else event_order("replay")
        once = keep_first(rows, ["id"], order, keep_null_keys=False)
        return once if limit is None else once.orderBy(*event_order("replay")).limit(max(0, whole("limit", limit)))

    def tail(self, contract_id=None, limit: int = 10, max_lookback: int = TAIL_LOOKBACK, type="contract", **filters) -> DataFrame:  # noqa: A002
        """The newest ``limit`` events within the lookback, ascending. ``type=None`` takes all types."""
        if limit <= 0:
            return self.events.limit(0)
        head = self.latest_ledger()
        low = max(1, (head or 1) - whole("max_lookback", max_lookback, 0, optional=False))
        return newest(with_buckets(self.events, event_filter(contract_id=contract_id, type=type, start_ledger=low, **filters), low, None), limit)

    def newest_in(self, start_ledger: int, end_ledger: int, limit: int) -> DataFrame:
        """The newest rows of one range, ascending, repeats included."""
        start, end = span(start_ledger, end_ledger)
        return newest(with_buckets(self.events, event_filter(start_ledger=start, end_ledger=end), start, end), limit)

    def head(self) -> DataFrame:
        """One row: sequence, hash, closeTime and protocolVersion of the head."""
        if self.ledgers is None:
            return self.events.agg(F.max("ledger").alias("sequence"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("closeTime"), F.lit(None).cast("long").alias("protocolVersion"))
        last = self.ledgers.agg(F.max_by(F.struct("sequence", "hash", "closeTime", "protocolVersion"), "sequence").alias("h"))
        return last.select("h.*")

    def latest_ledger(self) -> int | None:
        return self.head().first()["sequence"]

    def health(self, window: int | None = None) -> DataFrame:
        """One row: status, latestLedger, oldestLedger, ledgerRetentionWindow."""
        axis, c = (self.ledgers, "sequence") if self.ledgers is not None else (self.events, "ledger")
        row = axis.agg(F.max(c).alias("latestLedger"), F.min(c).alias("oldestLedger"))
        status = F.when(F.col("latestLedger").isNull(), "unavailable").otherwise("healthy")
        kept = F.lit(window).cast("long") if window is not None else F.col("latestLedger") - F.col("oldestLedger") + 1
        return row.select(status.alias("status"), "latestLedger", "oldestLedger", kept.alias("ledgerRetentionWindow"))

    def check_health(self) -> bool:
        return self.health().first()["status"] == "healthy"

    def check_retention(self, start_ledger: int) -> dict:
        whole("start_ledger", start_ledger, 1, optional=False)
        row = self.health().first()
        return {"retained": row["oldestLedger"] is None or start_ledger >= row["oldestLedger"], "startLedger": start_ledger, "oldestLedger": row["oldestLedger"], "latestLedger": row["latestLedger"]}

    def is_ledger_available(self, ledger: int) -> bool:
        """Whether a ledger is not below the oldest; there is no upper bound."""
        return self.check_retention(ledger)["retained"]

    def ledger_history(self, start_ledger: int | None = None, end_ledger: int | None = None, limit: int | None = DEFAULT_PAGE_SIZE, allow_gaps: bool = False, check: bool = True) -> DataFrame:
        """Ledger metadata of a range, in order; raises where the chain is inconsistent."""
        if self.ledgers is None:
            raise ValueError("this source has no ledgers")
        start, end = span(start_ledger, end_ledger)
        rows = self.ledgers.where(F.col("sequence").between(F.lit(start or 1), F.lit(end if end is not None else (1 << 62)))).orderBy("sequence")
        rows = rows if limit is None else rows.limit(whole("limit", limit, 1))
        if check:
            require_consistent(rows.withColumn("arrival", F.col("sequence")), "arrival", allow_gaps)
        return rows

    def verify_ledgers(self, start_ledger: int | None = None, end_ledger: int | None = None, allow_gaps: bool = False) -> dict:
        """Range, count and last ledger of a checked history."""
        rows = self.ledger_history(start_ledger, end_ledger, None, allow_gaps)
        return verify_history(rows, start_ledger, end_ledger).first().asDict() | {"ledgers": rows}


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def empty_ledgers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)
