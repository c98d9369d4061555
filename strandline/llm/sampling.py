"""Bounded samples of labelled rows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sample_of(docs: DataFrame, labelled: DataFrame, sample: int, label: str, labels: int = 256) -> DataFrame:
    """Texts of ``docs`` for a bounded sample of the ``labelled`` rows (doc_id, label): of each of
    the ``labels`` most frequent labels at most ``sample`` distinct doc_ids, those of the least
    hashes, so that neither repeated rows nor a frequent label crowd out others. Only these keys
    are broadcast. Of several labels of a doc_id the least counts."""
    keys = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    known = keys.groupBy(label).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), label).limit(labels).select(label)
    keys = least_of(keys.join(F.broadcast(known), label).withColumn("_h", F.xxhash64("doc_id")), label, ["_h", "doc_id"], sample).drop("_h")
    rows = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").where("text is not null").dropDuplicates(["doc_id"])
    return rows.withColumn("order_", F.xxhash64("doc_id"))


def least_of(rows: DataFrame, label: str, order: list[str], most: int, salts: int = 64) -> DataFrame:
    """The first ``most`` rows of each ``label`` by ``order``; a label's rows are ranked in
    ``salts`` parts first, so that a frequent one is no task's burden."""
    part = F.pmod(F.xxhash64(*order, F.lit(salts)), F.lit(salts))
    for by in ([F.col(label), part], [F.col(label)]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return rows
