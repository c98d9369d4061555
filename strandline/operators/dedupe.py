"""Keep-first and keep-last by key, with a stated order, in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.operators.ordering import event_order


def keep_first(rows: DataFrame, keys: list[str], order: list[Column], keep_null_keys: bool = True) -> DataFrame:
    """The first row of each key by ``order``. Rows with a null key all stay, or all go.

    Rows with a null key skip the shuffle, so id-less rows never meet in one task.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = rows.where(known).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.unionByName(rows.where(~known)) if keep_null_keys else first


def keep_last(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key."""
    return keep_first(rows, keys, [F.col(v).desc_nulls_last() for v in version], keep_null_keys=False)


def read_window(events: DataFrame, arrival: str = "arrival", limit: int | None = None) -> DataFrame:
    """As a windowed read delivers: ids required, first arrival wins, then the limit."""
    once = keep_first(events, ["id"], [F.col(arrival).asc()], keep_null_keys=False)
    return once if limit is None else once.orderBy(arrival).limit(max(limit, 0))


def order_windows(*results: DataFrame, dedupe: bool = True, tie: list[Column] | None = None) -> DataFrame:
    """Window results put together: sorted for replay, first of each id, id-less rows kept."""
    rows = reduce(DataFrame.unionByName, results)
    order = event_order("replay")
    return (keep_first(rows, ["id"], [*order, *(tie or [])]) if dedupe else rows).orderBy(*order)
