"""Ledger windows: inclusive ranges as rows, and the window of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.functions.checks import whole

#: Widest ledger span of one request to a remote source, and the replay default.
MAX_SAFE_SPAN = 9_500
DEFAULT_SPAN = 9_000


def window_list(start: int, end: int, size: int = DEFAULT_SPAN) -> list[tuple[int, int]]:
    """Inclusive windows of ``size`` ledgers, the last cut at ``end``."""
    whole("start", start, 1, optional=False), whole("end", end, 1, optional=False), whole("size", size, 1, optional=False)
    if end < start:
        raise ValueError("end must not precede start")
    return [(s, min(s + size - 1, end)) for s in range(start, end + 1, size)]


def build_windows(spark: SparkSession, start: int, end: int, size: int = DEFAULT_SPAN) -> DataFrame:
    """``window_list`` as rows (startLedger, endLedger), made where they are used."""
    window_list(start, start, size)
    if end < start:
        raise ValueError("end must not precede start")
    return spark.range(start, end + 1, size).select(F.col("id").alias("startLedger"), F.least(F.col("id") + size - 1, F.lit(end)).cast("long").alias("endLedger"))


def window_of(ledger: Column | str, start: int, size: int) -> Column:
    """Number of the half-open window [start + n * size, start + (n + 1) * size) that holds a ledger."""
    return F.floor(((F.col(ledger) if isinstance(ledger, str) else ledger) - start) / size).cast("long")
