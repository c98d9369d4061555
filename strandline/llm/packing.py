"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenised, cut at the capacity, and counted by piece length. The
plan is made on that histogram alone (at most ``capacity`` rows, whatever the
corpus): the reduction fixes sets that provably dominate all others holding their
largest piece, in bulk for all pieces of a length, and best-fit decreasing places
the rest. Pieces are then numbered within their length, in parallel over salts,
and the plan gives each its sequence and place.

A null or empty text is the closing id alone. Rows that repeat a doc_id are packed
one by one. Other columns are passed by.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandline.llm import textnum as tn, wordbpe
from strandline.llm.scratch import Scratch


def pieces(tokenizer: str, capacity: int, close: int):
    """mapInArrow function: (doc_id, t, text) to the document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordbpe.encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in tn.chunks(texts, 2 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, tokens in enumerate(encode(texts.slice(lo, hi - lo)), lo):
                    tokens = np.append(tokens, np.uint32(close)).astype("<u4")
                    for number, at in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[at : at + capacity]
                        row.append(i)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), batch.column("t").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "t", "piece", "start", "length", "ids_crc32"],
                )

    return run


class Stock:
    """Lengths still to pack, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.lengths = sorted(k for k, v in counts.items() if v)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def fit(self, room: int, less: int | None = None) -> int | None:
        """The longest length of at most ``room``; ``less`` has one piece in use."""
        i = bisect.bisect_right(self.lengths, room) - 1
        if i >= 0 and self.lengths[i] == less and self.n[less] < 2:
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def least(self, n: int, without: int) -> list[int]:
        """The ``n`` shortest pieces besides one of length ``without``."""
        out = []
        for x in self.lengths:
            out += [x] * min(n - len(out), self.n[x] - (x == without))
            if len(out) == n:
                break
        return out


def reduce(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets, from the longest piece down: [(lengths, how many)].

    For the longest piece j the set {j} dominates if nothing fits beside it;
    {j, k}, with k the longest that fits, if k fills the room or no two pieces fit;
    {j, k} or {j, r, s} if no three fit and one outweighs every pair. Pieces whose
    set does not qualify stay for best-fit, and as partners of shorter ones.
    """
    fixed = []
    for j in sorted(stock.lengths, reverse=True):
        while stock.n.get(j):
            room = capacity - j
            k = stock.fit(room, j)
            if k is None:
                fixed.append(((j,), stock.n[j]))
                stock.take(j, stock.n[j])
                continue
            small = stock.least(3, j)
            best: tuple[int, ...] | None = None
            if k == room or len(small) < 2 or small[0] + small[1] > room:
                best = (j, k)
            elif len(small) < 3 or sum(small) > room:
                best = _pair(stock, j, k, room)
            if best is None:
                break
            n = min(stock.n[x] // best.count(x) for x in set(best))
            fixed.append((best, n))
            for x in set(best):
                stock.take(x, n * best.count(x))
    return fixed


def _pair(stock: Stock, j: int, k: int, room: int) -> tuple[int, ...] | None:
    """The dominating set of j when at most two pieces fit beside it."""
    free = lambda x, used: stock.n[x] - used.count(x) > 0
    heaviest, second = 0, 0
    for r in stock.lengths:
        if 2 * r > room + 1 and r > room - stock.lengths[0]:
            break
        s = stock.fit(room - r)
        while s is not None and not (free(r, (j,)) and free(s, (j, r))):
            i = bisect.bisect_left(stock.lengths, s) - 1
            s = stock.lengths[i] if i >= 0 else None
        if s is not None:
            heaviest, second = max(heaviest, r + s), max(second, min(r, s))
    if k >= heaviest:
        return (j, k)
    s = stock.fit(room - k)
    if s is not None and s >= second and free(s, (j, k)):
        return (j, k, s)
    return None


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: groups of equal bins are filled in bulk."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
        bins.setdefault(room, []).append((pattern, n))

    for w in reversed(stock.lengths):
        n = stock.n[w]
        while n:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):  # open new bins, each filled as far as w goes
                per = capacity // w
                full, rest = divmod(n, per)
                if full:
                    add(capacity - per * w, (w,) * per, full)
                if rest:
                    add(capacity - rest * w, (w,) * rest, 1)
                break
            room = rooms[i]
            pattern, have = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[i]
            per = room // w
            full = min(have, n // per)
            if full:
                add(room - per * w, pattern + (w,) * per, full)
                n -= full * per
            if have > full and n:  # fewer pieces than one bin takes
                add(room - n * w, pattern + (w,) * n, 1)
                full, n = full + 1, 0
            if have > full:
                add(room, pattern, have - full)
    return [x for group in bins.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first number, sequence of that number, offset): pieces of a length,
    numbered from 0, go to consecutive sequences from each entry on."""
    stock = Stock(counts)
    chosen = reduce(stock, capacity)
    chosen += best_fit(stock, capacity)
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, n in chosen:
        at = 0
        for w in lengths:
            out.append((w, used[w], sequence, at))
            used[w] += n
            at += w
        sequence += n
    return sorted(out)


def assign(entries: list[tuple[int, int, int, int]]):
    """mapInArrow function: adds sequence_id and offset by (length, number)."""
    table = np.array(entries, np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 0, per_salt: int = 500_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, t long, piece int, start long, length long, ids_crc32 long"
    cut = scratch.put(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(pieces(tokenizer, capacity, close), schema))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    entries = plan(counts, capacity)
    salts = max(64, sum(counts.values()) // per_salt)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "t", "piece")) - 1
    numbered = salted.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"]).withColumn("number", (F.col("before") + nth).cast("long"))
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(assign(entries), out)
