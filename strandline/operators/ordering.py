"""Event orders. Orders differ only in where missing keys go."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Order name -> (missing ledger, missing transaction or operation index).
ORDERS = {"replay": ("zero", "zero"), "query": ("last", "zero"), "store": ("last", "last"), "table": ("first", "first")}


def _key(name: str, missing: str, descending: bool) -> Column:
    c = F.coalesce(F.col(name), F.lit(0)) if missing == "zero" else F.col(name)
    # the reverse order puts missing keys at the other end
    last = (missing != "first") != descending
    if descending:
        return c.desc_nulls_last() if last else c.desc_nulls_first()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


def event_order(order: str = "query", collation: str | None = None, descending: bool = False) -> list[Column]:
    """Sort keys: ledger, transaction index, operation index, id.

    Ids compare by bytes; ``collation`` (for instance UNICODE) makes that linguistic.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    ledger, index = ORDERS[order]
    ident = F.collate("id", collation) if collation else F.col("id")
    tail = ident.desc() if descending else ident.asc()
    return [_key("ledger", ledger, descending), _key("transactionIndex", index, descending), _key("operationIndex", index, descending), tail]


def newest(events, n: int):
    """The ``n`` newest events in ascending order; both sorts are bounded top-k plans."""
    if n <= 0:
        return events.limit(0)
    return events.orderBy(*event_order("query", descending=True)).limit(n).orderBy(*event_order("query"))
