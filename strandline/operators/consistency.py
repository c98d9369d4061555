"""Ledger chain checks: order, gaps, hash conflicts and links to the previous ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.errors import ConsistencyError

ERRORS = ("regressed", "hash_conflict", "broken_link")


def _verdict(allow_gaps: bool) -> Column:
    """Status of a row that knows the tracker's sequence and hash before it."""
    seq, before = F.col("sequence"), F.col("prev_seq")
    known = F.col("hash").isNotNull() & F.col("prev_hash").isNotNull()
    broken = F.col("previousHash").isNotNull() & F.col("prev_hash").isNotNull() & (F.col("previousHash") != F.col("prev_hash"))
    return (
        F.when(before.isNull(), "initialized")
        .when(seq < before, "regressed")
        .when((seq == before) & known & (F.col("hash") != F.col("prev_hash")), "hash_conflict")
        .when(seq == before, "duplicate")
        .when(seq != before + 1, "gap")
        .when(broken, "broken_link")
        .otherwise("advanced")
    )


def ledger_status(ledgers: DataFrame, arrival: str = "arrival", allow_gaps: bool = False) -> DataFrame:
    """``ledgers`` with prev_seq, prev_hash, status and is_error, in order of arrival.

    The state before a row is the highest sequence that arrived earlier and that
    ledger's first non-null hash. The running maximum is taken per span of arrivals and
    spans are joined at their edges, so no task sees all rows. A real gap is not also a
    broken link.
    """
    span = 100_000
    rows = ledgers.withColumn("_span", F.floor(F.col(arrival) / span))
    # the maximum over all earlier spans: one row a span
    tops = rows.groupBy("_span").agg(F.max("sequence").alias("_top"))
    tops = tops.select("_span", F.max("_top").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)).alias("_above"))
    inside = F.max("sequence").over(W.partitionBy("_span").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(tops, "_span").withColumn("prev_seq", F.greatest(inside, "_above"))
    firsts = ledgers.where("hash is not null").groupBy("sequence").agg(F.min_by("hash", arrival).alias("prev_hash"), F.min(arrival).alias("_since")).select(F.col("sequence").alias("prev_seq"), "prev_hash", "_since")
    rows = rows.join(firsts, "prev_seq", "left").withColumn("prev_hash", F.when(F.col("_since") < F.col(arrival), F.col("prev_hash")))
    rows = rows.withColumn("status", _verdict(allow_gaps))
    errors = [*ERRORS] if allow_gaps else [*ERRORS, "gap"]
    return rows.withColumn("is_error", F.col("status").isin(errors)).select(*ledgers.columns, "prev_seq", "prev_hash", "status", "is_error")


def gaps(ledgers: DataFrame) -> DataFrame:
    """Missing ranges (startLedger, endLedger) between ledgers, by an anti-join on the successor."""
    have = ledgers.select("sequence").distinct()
    after = have.select((F.col("sequence") - 1).alias("sequence"))
    ends = have.join(after, "sequence", "left_anti").select(F.col("sequence").alias("at"), F.lit(0).alias("kind"))
    before = have.select((F.col("sequence") + 1).alias("sequence"))
    starts = have.join(before, "sequence", "left_anti").select(F.col("sequence").alias("at"), F.lit(1).alias("kind"))
    # runs' borders only: one row for each gap's side
    borders = ends.unionByName(starts).withColumn("next", F.lead("at").over(W.orderBy("at", F.col("kind").desc())))
    return borders.where("kind = 0 and next is not null").select((F.col("at") + 1).alias("startLedger"), (F.col("next") - 1).alias("endLedger"))


def broken_links(ledgers: DataFrame) -> DataFrame:
    """Ledgers whose previousHash differs from the hash of sequence - 1: an equi-join."""
    before = ledgers.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("expected"))
    return ledgers.join(before, "sequence").where("previousHash <> expected").select("sequence", "previousHash", "expected")


def verify_history(ledgers: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: startLedger, endLedger, count and the last ledger's sequence and hash."""
    rows = ledgers
    if start is not None:
        rows = rows.where(F.col("sequence") >= start)
    if end is not None:
        rows = rows.where(F.col("sequence") <= end)
    return rows.agg(F.lit(start).cast("long").alias("startLedger"), F.lit(end).cast("long").alias("endLedger"), F.count("*").alias("count"), F.max("sequence").alias("lastSequence"), F.max_by("hash", "sequence").alias("lastHash"))


@dataclass
class LedgerTracker:
    """The fold of the checks over single ledgers, for live use."""

    allow_gaps: bool = False
    sequence: int | None = None
    hash: str | None = None

    def observe(self, ledger: dict) -> str:
        """The status of the next ledger; raises ConsistencyError where it does not fit."""
        seq, digest = ledger.get("sequence"), ledger.get("hash")
        previous = ledger.get("previousHash", ledger.get("prevHash"))
        if isinstance(seq, bool) or not isinstance(seq, int) or seq < 1:
            raise TypeError("a ledger needs a positive integer sequence")
        if self.sequence is None:
            status = "initialized"
        elif seq < self.sequence:
            raise ConsistencyError(f"ledger {seq} is behind {self.sequence}")
        elif seq == self.sequence:
            if digest is not None and self.hash is not None and digest != self.hash:
                raise ConsistencyError(f"ledger {seq} has two hashes")
            self.hash = self.hash if self.hash is not None else digest
            return "duplicate"
        elif seq > self.sequence + 1:
            if not self.allow_gaps:
                raise ConsistencyError(f"ledgers {self.sequence + 1} to {seq - 1} are missing")
            status = "gap"
        elif previous is not None and self.hash is not None and previous != self.hash:
            raise ConsistencyError(f"ledger {seq} does not link to ledger {self.sequence}")
        else:
            status = "advanced"
        self.sequence, self.hash = seq, digest
        return status

    def observe_many(self, ledgers) -> list[str]:
        return [self.observe(x) for x in ledgers]

    def assert_current(self, sequence: int) -> None:
        if self.sequence != sequence:
            raise ConsistencyError(f"at ledger {self.sequence}, not {sequence}")

    @property
    def last(self) -> dict | None:
        return None if self.sequence is None else {"sequence": self.sequence, "hash": self.hash}

    def reset(self) -> None:
        self.sequence = self.hash = None


def require_consistent(ledgers: DataFrame, arrival: str = "arrival", allow_gaps: bool = False) -> DataFrame:
    """``ledger_status``, raising at the first error in order of arrival."""
    report = ledger_status(ledgers, arrival, allow_gaps)
    first = report.where("is_error").orderBy(arrival).select(arrival, "sequence", "status").first()
    if first:
        raise ConsistencyError(f"ledger {first['sequence']}: {first['status']}")
    return report
