"""Joins by keys of which one may have any share of the rows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: At most so many keys can each have more than 1 / HOT of the rows.
HOT = 4096


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, by: Column | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, ``n`` of the rows have it) by ``on``.

    Keys of more than ``total`` / HOT rows are dealt to several tasks, each of about so many rows.
    There are fewer than HOT such keys at any size, and fewer than 2 * HOT repeats of them in the
    table, so it is safe to broadcast them. Both inputs should be written tables: they are read
    again in the same order if a task is lost, so every row gets the same lane; or lanes go ``by``
    a hash that differs between the rows of a key. Keys without a row in ``table`` (or null) find
    nothing; an empty side gives an empty result.
    """
    part = max(1, total // HOT)
    lanes = F.ceil(F.col(n) / F.lit(part)).cast("long")
    hot = table.where(F.col(n) > part).select(*on, lanes.alias("_lanes"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_lane", F.coalesce(F.pmod(F.monotonically_increasing_id() if by is None else by, F.col("_lanes")), F.lit(0).cast("long"))).drop("_lanes")
    repeated = table.withColumn("_lane", F.explode(F.when(F.col(n) > part, F.sequence(F.lit(0).cast("long"), lanes - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(repeated, [*on, "_lane"]).drop("_lane")
