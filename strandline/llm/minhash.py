"""MinHash near-dedup by DartMinHash over weighted word shingles.

Each text is a weighted set: its five-word shingles with their counts. Seeded
Poisson darts fall on the plane weight x rank of every shingle; a dart counts
if it lies below the shingle's weight and below the text's rank limit. Each of
``k`` coordinates keeps its earliest dart, so two texts agree on a coordinate
with the probability of their weighted Jaccard similarity. Four coordinates form
a band; texts that share a band are compared exactly.

Null and empty texts are one class (as are equal texts without any word); a
text of fewer than five words is one shingle. Repeated rows are in one class.
Ids are 64-bit hashes of the weighted set, so n texts meet about n^2 / 2^65
false equalities. Columns other than the id and the text are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm import textnum as tn
from strandline.llm.neardup import classed, sets_of, similar_classes
from strandline.llm.scratch import Scratch
from strandline.llm.skew import spread_join

U = np.uint64
#: Weight regions: unit widths doubling to this width, then of this width.
_WIDEST = 64


def _cdf(mean: int) -> np.ndarray:
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    logs = np.cumsum(np.r_[0.0, np.log(n[1:])])
    return np.cumsum(np.exp(n * math.log(mean) - mean - logs))


_CDF = {w: _cdf(w) for w in (1, 2, 4, 8, 16, 32, 64)}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _regions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, start, width) of the weight regions below each count."""
    single = np.arange(len(counts))
    more = np.flatnonzero(counts > 1)
    doubling = np.minimum(np.ceil(np.log2(counts[more])).astype(np.int64), 6)
    per = doubling + np.maximum(0, -(-(counts[more] - _WIDEST) // _WIDEST))
    index = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + 1
    width = np.where(index <= 6, 1 << np.minimum(index - 1, 5), _WIDEST)
    start = np.where(index <= 6, width, _WIDEST * (index - 6))
    return np.r_[single, np.repeat(more, per)], np.r_[np.zeros_like(single), start], np.r_[np.ones_like(single), width]


def _throw(rows, hashes, counts, limit, k, n, seed):
    """Earliest rank and dart of each (row, coordinate)."""
    element, start, width = _regions(counts)
    bound = limit[rows[element]]
    steps = np.ceil(bound).astype(np.int64)
    cell = np.repeat(np.arange(len(element)), steps)
    step = np.arange(len(cell)) - np.repeat(np.cumsum(steps) - steps, steps)
    region = hashes[element] * U(0x9FB21C651E98DF25) + start.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(seed)
    at = tn.mix(region[cell] + step.astype(U) * U(0xD1B54A32D192ED03))
    u, wide = _unit(at), width[cell]
    darts = np.searchsorted(_CDF[1], u, "right")
    for w in np.unique(width[width > 1]):
        of = wide == w
        darts[of] = np.searchsorted(_CDF[int(w)], u[of], "right")
    one = np.repeat(np.arange(len(cell)), darts)
    nth = np.arange(len(one)) - np.repeat(np.cumsum(darts) - darts, darts)
    # a dart's upper bits are its rank within the cell, its lowest bits its coordinate
    dart = tn.mix(at[one] + (nth + 1).astype(U) * U(0xA0761D6478BD642F))
    of = cell[one]
    rank = step[one] + _unit(dart)
    ok = rank < bound[of]
    weighted = np.flatnonzero(wide[one] > 1)
    in_weight = start[of[weighted]] + width[of[weighted]] * _unit(tn.mix(dart[weighted] ^ U(0x52)))
    ok[weighted] &= in_weight < counts[element[of[weighted]]]
    dart, rank, row = dart[ok], rank[ok], rows[element[of[ok]]]
    slot = row * k + (dart & U(2047)).astype(np.int64) % k
    first = np.full(n * k, np.inf)
    np.minimum.at(first, slot, rank)
    win = rank == first[slot]
    kept = np.zeros(n * k, U)
    kept[slot[win]] = dart[win]
    return first.reshape(n, k), kept.reshape(n, k)


def dart_signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, k: int = 64, seed: int = 7) -> np.ndarray:
    """(n, k) signatures (k a power of two, at most 2048) of n weighted sets given as sorted (row, element, count)."""
    total = np.bincount(rows, weights=counts, minlength=n)
    goal = k * math.log(k) + 3 * k
    limit = goal / np.maximum(total, 1)
    out = np.zeros((n, k), U)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pick = np.isin(rows, todo) if len(todo) < n else slice(None)
        place = np.zeros(n, np.int64)
        place[todo] = np.arange(len(todo))
        first, kept = _throw(place[rows[pick]], hashes[pick], counts[pick], limit[todo], k, len(todo), seed)
        out[todo] = kept
        todo = todo[np.isinf(first).any(axis=1)]
        limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(n, k // rows) keys; the band's number is part of its key."""
    n, k = signatures.shape
    keys = np.zeros((n, k // rows), U)
    for j in range(rows):
        keys = tn.mix(keys * U(0x2545F4914F6CDD1D) + signatures[:, j::rows][:, : k // rows])
    return tn.mix(keys + np.arange(k // rows, dtype=U) * U(0x632BE59BD9B4E019))


def sketch(width: int, k: int, rows: int):
    """mapInArrow function: (doc_id, t, text) to (doc_id, t, id, size, keys: packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tn.chunks(batch.column("text"), 1 << 19):
                part = batch.slice(lo, hi - lo)
                row, h, c = tn.word_shingles(part.column("text"), width)
                ids, _ = tn.set_key(row, h, c, len(part))
                keys = band_keys(dart_signatures(row, h, c, len(part), k), rows)
                # equal sets of this batch need their bands only once
                _, first = np.unique(ids, return_index=True)
                some = np.zeros(len(part), np.int64)
                some[first] = keys.shape[1]
                size = np.bincount(row, weights=c, minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array(ids), pa.array(size), tn.packed(keys[np.sort(first)].ravel(), some)], names=["doc_id", "t", "id", "size", "keys"]
                )

    return run


def counted_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The shingles of each text as a set: the second, third, ... of equal ones count as others."""
    out = []
    for lo, hi in tn.chunks(column, 1 << 19):
        row, h, c = tn.word_shingles(column.slice(lo, hi - lo), width)
        copies = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        h = np.repeat(h, c)
        h[copies > 0] = tn.mix(h[copies > 0] + copies[copies > 0].astype(U))
        out += sets_of(np.repeat(row, c), h, hi - lo)
    return out


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, k: int = 64, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two written tables: root, doc_id and t (hash of the text) of each row of ``docs``; root, head
    (least doc_id, nulls first, and its t) and n (rows) of each class.

    With 16 bands of 4, a pair at 0.8 is found with probability 0.9998.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = scratch.put(texts.mapInArrow(sketch(width, k, rows), f"doc_id {kind}, t long, id long, size long, keys binary"))
    named = sketched.select("id", "doc_id", "t")

    def features(ids: DataFrame) -> DataFrame:
        firsts = sketched.join(ids, "id", "left_semi").groupBy("id").agg(F.max("size").alias("size"), F.min(F.struct("doc_id", "t")).alias("f"))
        wanted = firsts.select("id", "size", F.col("f.doc_id").alias("d"), F.col("f.t").alias("dt"))
        # always the same join, so that small tables tell what large ones cost
        found = texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")))
        return found.select("id", "size", F.coalesce("text", F.lit("")).alias("h")).dropDuplicates(["id"])

    roots = similar_classes(scratch, sketched.where("length(keys) > 0").select("id", "keys"), sketched.count() * (k // rows), features, threshold, lambda column: counted_sets(column, width))
    return classed(scratch, named, roots, True)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, t (hash of its text), class_id (the least
    doc_id of its class, nulls first), class_t (that document's t) and class_size."""
    labelled, heads = classes(docs, **how)
    joined = spread_join(labelled, heads, ["root"], "n", labelled.count())
    return joined.select("doc_id", "t", F.col("head.doc_id").alias("class_id"), F.col("head.t").alias("class_t"), F.col("n").alias("class_size"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least doc_id."""
    heads = classes(docs, **how)[1].select(F.col("head.doc_id").alias("_head"), F.col("head.t").alias("_head_t"))
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    kept = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_t") == F.col("_head_t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_t"]).drop("_t")
