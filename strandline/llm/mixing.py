"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents
should have. The whole part is given to all; the fractional part is rounded by
duels: two documents transfer mass (words), at random and without bias, until one
of them is whole, and the other goes on. Blocks of documents are reduced in
parallel to one residual each, and residuals meet in blocks again until one is
left per source. That one is rounded to the nearest whole, so a source's words miss
its target by at most half of one document.

Null and empty texts have size 0 and no mass; they get their whole copies only.
Null sources are one source, ordered last. Rows that repeat id, source and size
are told apart by number. Random numbers are hashes of the seed and ids, so reruns
agree. Other columns are passed by. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandline.llm.rules import WORDS, let
from strandline.llm.scratch import Scratch


def size_of(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """source, n, source_size, target of (source, n, source_size).

    Sources in code point order (null last) take the repeating weights. Resharing
    what exceeds ``most`` times a source's size has a closed form: sources are
    capped in order of their cap per weight, up to the last whose cap is below its
    share of what the earlier capped ones leave.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    upto = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = W.partitionBy()
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything),
        "capped": F.coalesce(F.sum("cap").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(upto.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("capped")) / F.col("open")
    rows = rows.withColumn("level", F.when(F.col("cap") > level * F.col("w"), level))
    # the first source that is not capped sets the level for all that follow
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("source", "n", "source_size", F.coalesce(F.col("level") * F.col("w"), F.col("cap")).alias("target"))


def _unit(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def duel(a: Column, b: Column, won: Column, seed: int) -> Column:
    """(left, won) after a meets b: the survivor, and the decided appended to ``won``.

    With masses size * p, mass moves one way or the other until a p is 0 or 1. The
    odds keep every expectation, and the sum of masses stays.
    """
    item = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["k"].alias("k"), p.alias("p"))
    near = lambda p: F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
    whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
    to_a = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    to_b = F.least((1 - b["p"]) * b["size"], a["p"] * a["size"])
    u = _unit(F.lit(seed), a["doc_id"], a["k"], b["doc_id"], b["k"])
    gain = F.when(u * (to_a + to_b) < to_b, to_a).otherwise(-to_b)

    def settle(s: Column) -> Column:
        x, y = s["x"], s["y"]
        left = F.when(~whole(x), x).when(~whole(y), y)
        done = F.filter(F.array(x, y), whole)
        return F.struct(left.alias("left"), F.concat(won, done).alias("won"))

    moved = let(gain, lambda g: F.struct(item(a, near(a["p"] + g / a["size"])).alias("x"), item(b, near(b["p"] - g / b["size"])).alias("y")))
    return let(moved, settle)


def reduce_block(items: Column, kind: str, seed: int) -> Column:
    """(left, won) of one block's items, met in order."""
    nobody = F.lit(None).cast(kind)
    start = F.struct(nobody.alias("left"), F.array().cast(f"array<{kind}>").alias("won"))
    meet = lambda s, x: F.when(s["left"].isNull(), F.struct(x.alias("left"), s["won"].alias("won"))).otherwise(duel(s["left"], x, s["won"], seed))
    return F.aggregate(items, start, meet)


def copies(docs: DataFrame, weights=(5, 2, 1), most: float = 3, seed: int = 7, block: int = 48) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, k (number among equal rows),
    source_size, target and copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = f"struct<doc_id:{id_kind},size:bigint,k:int,p:double>"
    sized = scratch.put(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("m")))
    sums = sized.groupBy("source").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("size")).alias("source_size"))
    goals = scratch.put(targets(sums, list(weights), most).withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    rows = sized.withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).join(goals.drop("source"), "source_key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a ratio that misses a whole number by rounding alone is that number
    rows = rows.select("*", F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio).alias("ratio")).withColumn("whole", F.floor("ratio").cast("int"))
    rows = rows.withColumn("p", F.col("ratio") - F.col("whole")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m"))))
    group = ["source", "source_size", "target", "whole", "n"]
    settled = (F.col("p") == 0.0) | (F.col("size") == 0)
    out = rows.where(settled).select("doc_id", "source", "size", "k", "source_size", "target", F.col("whole").alias("copies"))
    largest = goals.agg(F.max("n")).first()[0] or 0
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("long")
    level = rows.where(~settled).select(*group, blocks(F.col("n")).alias("of"), F.struct("doc_id", "size", "k", "p").cast(kind).alias("item"))
    level = level.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "item.doc_id", "item.k", "item.size"), F.col("of")))
    left = -(-largest // block)
    decided = []
    while True:
        met = level.groupBy(*group, "of", "at").agg(F.array_sort(F.collect_list("item")).alias("items"))
        met = scratch.put(met.select(*group, "of", "at", reduce_block(F.col("items"), kind, seed).alias("r")).select(*group, "of", "at", "r.left", "r.won"))
        decided.append(met.select(*group, F.explode("won").alias("item")))
        level = met.where("left is not null").select(*group, blocks(F.col("of")).alias("of"), F.col("left").alias("item"), "at")
        level = level.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "at"), F.col("of")))
        if left <= 1:
            break
        left = -(-left // block)
    last = level.withColumn("item", F.struct("item.doc_id", "item.size", "item.k", F.when(F.col("item.p") >= 0.5, 1.0).otherwise(0.0).alias("p")).cast(kind))
    for part in [*decided, last.select(*group, "item")]:
        out = out.unionByName(part.select("item.doc_id", "source", "item.size", "item.k", "source_size", "target", (F.col("whole") + F.col("item.p").cast("int")).alias("copies")))
    return out


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    counted = copies(docs, **how).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("k").alias("_k"), "copies")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    rows = docs.withColumn("_size", size_of(F.col("text")))
    if counted.agg(F.max("_k")).first()[0] not in (None, 1):  # equal rows are numbered too
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "source", "_size").orderBy("text")))
        on = on & (F.col("_n") == F.col("_k"))
    taken = rows.join(counted.where("copies > 0").withColumnRenamed("copies", "_copies"), on)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
