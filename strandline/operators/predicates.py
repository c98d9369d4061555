"""Event predicates as one boolean column, so that scans can prune by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.checks import names, span, whole
from strandline.functions.model import BUCKET_SPAN


def event_filter(*, contract_id=None, type=None, tx_hash=None, topic=None, ledger=None, start_ledger=None, end_ledger=None, predicate: Column | None = None) -> Column:  # noqa: A002
    """The conjunction of what is given; None is "not given". Never null.

    ``contract_id``, ``type``, ``tx_hash`` and ``topic`` take one value or a list; a topic
    matches at any position, by its canonical text. Ledger bounds are inclusive.
    """
    whole("ledger", ledger, 1)
    start, end = span(start_ledger, end_ledger)
    if predicate is not None and not isinstance(predicate, Column):
        raise TypeError("predicate must be a Column")
    parts = [F.col(c).isin(v) for c, v in (("contractId", names("contract_id", contract_id)), ("type", names("type", type)), ("txHash", names("tx_hash", tx_hash))) if v is not None]
    topics = names("topic", topic)
    if topics is not None:
        have = F.transform("topics", lambda t: F.coalesce(t, F.lit("null")))
        parts.append(F.arrays_overlap(have, F.array(*[F.lit(t) for t in topics]).cast("array<string>")))
    if ledger is not None:
        parts.append(F.col("ledger") == ledger)
    if start is not None:
        parts.append(F.col("ledger") >= start)
    if end is not None:
        parts.append(F.col("ledger") <= end)
    if predicate is not None:
        parts.append(predicate)
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    """AND of parts, each false where null; bare comparisons stay bare, so they push down."""
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def with_buckets(events: DataFrame, condition: Column, start: int | None, end: int | None) -> DataFrame:
    """Filters by ``condition`` and, on a bucketed table, by the buckets of the range."""
    out = events.where(condition)
    if "ledger_bucket" in events.columns:
        if start is not None:
            out = out.where(F.col("ledger_bucket") >= start // BUCKET_SPAN)
        if end is not None:
            out = out.where(F.col("ledger_bucket") <= end // BUCKET_SPAN)
    return out


def filter_events(events: DataFrame, **options) -> DataFrame:
    """Rows that match all of ``event_filter``'s options."""
    if not isinstance(events, DataFrame):
        raise TypeError("events must be a DataFrame")
    return with_buckets(events, event_filter(**options), options.get("start_ledger") or options.get("ledger"), options.get("end_ledger") or options.get("ledger"))


def matches_event(**options) -> Column:
    """``event_filter`` as a value: false, not null, where it does not hold."""
    return F.coalesce(event_filter(**options), F.lit(False))
