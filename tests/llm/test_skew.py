"""Joins that spread hot keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import skew


@pytest.mark.parametrize("hot", [4, 4096])
def test_spread_join_equals_a_plain_join(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    keys = [None] * 30 + [7] * 400 + list(range(500)) + [8] * 90 + [9] * 300
    rows = spark.createDataFrame([(k, i, "row") for i, k in enumerate(keys)], "k long, i long, other string")
    table = spark.createDataFrame([(k, n, f"v{k}") for k, n in Counter(keys).items() if k is not None and k % 2], "k long, n long, v string")
    got = skew.spread_join(rows, table, ["k"], "n", len(keys))
    want = rows.join(table, "k")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spread_join_deals_a_hot_key(spark, monkeypatch):
    rows = spark.range(0, 100_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    monkeypatch.setattr(skew, "HOT", 64)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        parts = skew.spread_join(rows, table, ["k"], "n", 100_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name in plain:
            spark.conf.unset(name)
    assert sum(x["count"] for x in parts) == 100_000
    assert max(x["count"] for x in parts) < 33_000  # one key has 33,335 rows


def test_spread_join_of_empty_tables(spark):
    rows = spark.createDataFrame([], "k long, i long")
    table = spark.createDataFrame([], "k long, n long, v string")
    assert skew.spread_join(rows, table, ["k"], "n", 0).collect() == []
