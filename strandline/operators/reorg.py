"""Chain reorganisations: detect, plan and invalidate, as joins and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.checks import whole


def compare_ledgers(expected: DataFrame, actual: DataFrame, lookback: int | None = None) -> DataFrame:
    """One row per expected ledger: sequence, expectedHash, actualHash, outcome.

    Outcomes: expected-ledger-outside-window, hash-unavailable, same-hash,
    hash-mismatch. ``lookback`` keeps the last so many actual ledgers only.
    """
    seen = actual.select(F.col("sequence"), F.col("hash").alias("actualHash"), F.lit(True).alias("_seen"))
    if lookback is not None:
        whole("lookback", lookback, 1)
        head = actual.agg(F.max("sequence").alias("_head"))
        seen = seen.crossJoin(F.broadcast(head)).where(F.col("sequence") > F.col("_head") - lookback).drop("_head")  # one row
    rows = expected.select("sequence", F.col("hash").alias("expectedHash")).join(seen, "sequence", "left")
    outcome = (
        F.when(F.col("_seen").isNull(), "expected-ledger-outside-window")
        .when(F.col("expectedHash").isNull() | F.col("actualHash").isNull(), "hash-unavailable")
        .when(F.col("expectedHash") == F.col("actualHash"), "same-hash")
        .otherwise("hash-mismatch")
    )
    return rows.select("sequence", "expectedHash", "actualHash", outcome.alias("outcome"))


def detect(expected: dict, actual: dict) -> dict:
    """The outcome for two ledgers on the driver; ``different-ledger`` comes first."""
    same = expected.get("sequence") == actual.get("sequence")
    a, b = expected.get("hash"), actual.get("hash")
    reason = "different-ledger" if not same else "hash-unavailable" if a is None or b is None else "same-hash" if a == b else "hash-mismatch"
    return {"detected": reason == "hash-mismatch", "reason": reason, "expected": expected, "actual": actual}


def plan_columns(affected: Column, verified: Column, depth: Column | int = 1) -> list[Column]:
    """rewindTo, invalidateFrom, invalidateTo and replayFrom of a reorganisation."""
    rewind = F.greatest(F.lit(1), affected - depth).cast("long")
    return [rewind.alias("rewindTo"), affected.cast("long").alias("invalidateFrom"), verified.cast("long").alias("invalidateTo"), rewind.alias("replayFrom")]


def plan(affected: int, latest_verified: int, depth: int = 1) -> dict:
    """``plan_columns`` for one reorganisation, on the driver."""
    whole("affected", affected, 1, optional=False), whole("latest_verified", latest_verified, 1, optional=False), whole("depth", depth, 0, optional=False)
    if latest_verified < affected:
        raise ValueError("latest_verified must not precede affected")
    back = max(1, affected - depth)
    return {"rewind_to": back, "invalidate": (affected, latest_verified), "replay_from": back}


def invalidate(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events without those of the invalid range; unknown ledgers stay."""
    return events.where(F.col("ledger").isNull() | ~F.col("ledger").between(start, end))
