"""Filtered, ordered pages of events with their totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.checks import span, whole
from strandline.operators.ordering import event_order
from strandline.operators.predicates import _all, with_buckets

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class EventQuery:
    """Checked options of a paged query; every field but the page is an equality or range."""

    contract_id: str | None = None
    type: str | None = None
    tx_hash: str | None = None
    ledger: int | None = None
    start_ledger: int | None = None
    end_ledger: int | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def condition(self) -> Column:
        wanted = {"contractId": self.contract_id, "type": self.type, "txHash": self.tx_hash, "ledger": self.ledger}
        parts = [F.col(c) == v for c, v in wanted.items() if v is not None]
        if self.start_ledger is not None:
            parts.append(F.col("ledger") >= self.start_ledger)
        if self.end_ledger is not None:
            parts.append(F.col("ledger") <= self.end_ledger)
        return _all(parts)


def validate_event_query(**options) -> EventQuery:
    """Options as an EventQuery; unknown names raise TypeError."""
    query = EventQuery(**options)
    span(query.start_ledger, query.end_ledger)
    whole("ledger", query.ledger, 1)
    whole("limit", query.limit, 1, optional=False)
    whole("offset", query.offset, 0, optional=False)
    texts = {k: None if getattr(query, k) is None else str(getattr(query, k)) for k in ("contract_id", "type", "tx_hash")}
    return EventQuery(**{**query.__dict__, **texts})


def _matching(events: DataFrame, query: EventQuery) -> DataFrame:
    return with_buckets(events, query.condition(), query.start_ledger or query.ledger, query.end_ledger or query.ledger)


def query_events(events: DataFrame, **options) -> DataFrame:
    """One page: a bounded top-k of offset + limit rows."""
    query = validate_event_query(**options)
    return _matching(events, query).orderBy(*event_order("query")).offset(query.offset).limit(query.limit)


def query_meta(events: DataFrame, **options) -> DataFrame:
    """One row with the page's total, offset, limit, count and hasMore."""
    query = validate_event_query(**options)
    total = _matching(events, query).agg(F.count("*").alias("total"))
    rows = F.greatest(F.lit(0), F.least(F.lit(query.limit), F.col("total") - query.offset)).cast("long")
    return total.select("total", F.lit(query.offset).cast("long").alias("offset"), F.lit(query.limit).cast("long").alias("limit"), rows.alias("count"), (F.lit(query.offset) + rows < F.col("total")).alias("hasMore"))


def create_event_query(store):
    """A function of options over a store's whole table."""
    return lambda **options: query_events(store.table(), **options)
