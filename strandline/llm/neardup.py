"""Shared parts of the near-duplicate operators: shared bands, exact comparison, union-find.

Entities are 64-bit content hashes, so copies are one entity. Steps:

1. ``collisions``: the ids whose band keys other ids have too. Keys travel as packed
   blobs and each task first folds its own, so a key that a third of all rows share
   reaches its reducer as one entry a task.
2. ``groups``: buckets with the same pivot are one group, so an id meets its original
   once, not once a band.
3. Groups are dealt in blocks of at most ``BLOCK`` ids; a block (with the pivot) is
   compared exactly, all with all, inside one task; only links come out.
4. Groups of several blocks that are still in several classes: every id outside the
   largest class is compared with the ids of the other classes, block by block.

So no two similar ids that share a band stay apart, and neither pairs nor a whole group
are ever rows of a table or held by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm import textnum as tn
from strandline.llm.scratch import Scratch
from strandline.llm.skew import spread_join

U = np.uint64
#: Ids of a group that are compared in one task, and characters (or elements) they may have.
BLOCK, VOLUME = 256, 8 << 20
#: Keys folded at a time by a task, keys that a part has on average, keys of a blob passed by,
#: and bytes of a key that are told apart within a part.
FLUSH, PART, BLOB, LOW = 1 << 20, 1 << 20, 1 << 15, 5
#: Rounds of union-find in the order of the ids themselves.
PLAIN = 4


def components(scratch: Scratch, links: DataFrame, most: int = 60) -> DataFrame:
    """Union-find by contraction: (id, root) for every linked id but the roots, the least of each class.

    In a round each id goes to the least id that it is linked to, or stays; links then join where
    their ends went, and those whose ends are one are done. So only classes that are not whole yet
    take part in the next round: stars are done at once, and a chain loses half its links a round.
    An id may have any share of the links, so joins by ids are spread.
    """
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    steps = []
    while total := edges.count():
        if len(steps) == most:
            raise RuntimeError("union-find did not settle")
        # ids are hashes, so their own order will do; another order each round should they form runs
        salt = F.lit(0 if len(steps) < PLAIN else int(tn.mix(np.array([len(steps)], U)).view(np.int64)[0]))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(salt)).alias("m"), F.count("*").alias("n"))
        step = scratch.put(least.select("u", F.least("m", F.col("u").bitwiseXOR(salt)).bitwiseXOR(salt).alias("to"), "n"))
        steps.append(step)
        left = spread_join(edges, step.withColumnRenamed("to", "x"), ["u"], "n", total, F.xxhash64("v")).select("u", "v", "x")
        both = spread_join(left, step.select(F.col("u").alias("v"), F.col("to").alias("y"), "n"), ["v"], "n", total, F.xxhash64("u"))
        rest = scratch.put(both.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
        scratch.drop(edges)
        edges = rest
    made = [edges, *steps]
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    for turn, step in enumerate(reversed(steps)):
        own = step.select(F.col("u").alias("id"), F.col("to").alias("root"))
        found = own if not turn else scratch.put(carried(scratch, own, found))
        made += [found] * bool(turn)
    if len(steps) > PLAIN:  # roots by other orders are not the least
        least = scratch.put(found.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n")))
        made.append(least)
        found = spread_join(found, least, ["root"], "n", found.count(), F.xxhash64("id")).select("id", F.col("least").alias("root"))
    out = scratch.put(found.where("id <> root"))
    scratch.drop(*made)
    return out


def carried(scratch: Scratch, below: DataFrame, above: DataFrame) -> DataFrame:
    """``below`` (id, root) with the root of its root, for those that ``above`` (id, root) has; both of written tables."""
    on = above.select(F.col("id").alias("root"), F.col("root").alias("to"))
    roots = scratch.put(below.groupBy("root").agg(F.count("*").alias("n")).join(on, "root", "left").select("root", F.coalesce("to", "root").alias("to"), "n"))
    return spread_join(below, roots, ["root"], "n", below.count(), F.xxhash64("id")).select("id", F.col("to").alias("root"))


# shared bands

#: Kinds of blobs: an id for each key, and keys with several ids that one task has found.
_ONE, _FOUND = 0, 1


def name(part: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """The key as members carry it: its part and its lowest bytes."""
    return np.asarray(part, U) << U(8 * LOW) | key & U((1 << 8 * LOW) - 1)


def fold(parts: int, keyed: Callable | None = None):
    """mapInArrow function: (id, keys: packed), as ``keyed`` makes them of the rows, to blobs
    (part, kind, keys, ids).

    A key's upper bits choose its part, its lowest ``LOW`` bytes tell it from others there; parts
    grow in number with the keys, so chance meetings stay one in a million (and are compared).
    Of a key that several ids of this task have, all ids are found already: they pass as
    they are, dealt evenly, and one entry stands for them at the key's part."""

    def blobs(keys: list, ids: list, turn: int):
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        key, own = key[order], own[order]
        at, count = tn.runs(key)
        several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
        part = (key >> U(32)) * U(parts) >> U(32)  # ascending, as keys are
        first, n = tn.runs(part[at])
        low = key[at].view(np.uint8).reshape(-1, 8)[:, :LOW]
        out = [(int(part[at[f]]), _ONE, low[f : f + c], own[at[f : f + c]]) for f, c in zip(first, n, strict=True)]
        of = np.repeat(several, count)
        k, i = name(part[of], key[of]), own[of]
        out += [((turn + j) % parts, _FOUND, k[lo : lo + BLOB], i[lo : lo + BLOB]) for j, lo in enumerate(range(0, len(k), BLOB))]
        for lo in range(0, len(out), 64):
            some = out[lo : lo + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()), *[pa.array([x[c].tobytes() for x in some], pa.binary()) for c in (2, 3)]],
                names=["part", "kind", "keys", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held, turn = [], [], 0, 0
        for batch in keyed(batches) if keyed else batches:
            raw, offsets = tn.buffers(batch.column("keys"), pa.large_binary())
            own = np.repeat(batch.column("id").to_numpy(), np.diff(offsets) // 8)
            keys.append(np.frombuffer(raw, U))
            ids.append(own)
            held += len(own)
            if held >= FLUSH:
                yield from blobs(keys, ids, turn)
                keys, ids, held, turn = [], [], 0, turn + 1
        if held:
            yield from blobs(keys, ids, turn)

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: blobs sorted by part to (key, id) of keys with several ids."""

    def rows(key: np.ndarray, own: np.ndarray):
        for lo in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 17)].view(np.int64)), pa.array(own[lo : lo + (1 << 17)])], names=["key", "id"])

    def close(held: list):
        if held:
            key, own = (np.concatenate([x[c] for x in held]) for c in (0, 1))
            order = np.argsort(key)
            key, own = key[order], own[order]
            at, count = tn.runs(key)
            of = np.repeat(np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at), count)
            yield from rows(key[of], own[of])

    part, held = None, []
    for batch in batches:
        for p, kind, keys, ids in zip(*[batch.column(c).to_pylist() for c in ("part", "kind", "keys", "ids")], strict=True):
            own = np.frombuffer(ids, np.int64)
            if kind == _FOUND:
                yield from rows(np.frombuffer(keys, U), own)
                continue
            if p != part:
                yield from close(held)
                part, held = p, []
            key = np.zeros((len(own), 8), np.uint8)
            key[:, :LOW] = np.frombuffer(keys, np.uint8).reshape(-1, LOW)
            held.append((name(p, key.ravel().view(U)), own))
    yield from close(held)


def collisions(rows: DataFrame, entries: int, keyed: Callable | None) -> DataFrame:
    """(key, id) of keys that several ids have; some rows may repeat. The keys of ``rows`` are
    there (id, keys) or made by ``keyed``, in the same Python worker that folds them."""
    parts = max(16, min(1 << 23, entries // PART))
    blobs = rows.mapInArrow(fold(parts, keyed), "part int, kind int, keys binary, ids binary")
    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, id long")


def groups(members: DataFrame) -> DataFrame:
    """(pivot, id) of ids that meet in a key of ``members`` (key, id), the pivot not with itself.

    The pivot of a key is the id with the most keys here (ties go by hash, so a rerun chooses the
    same): of edited copies, the one nearest to their original. An id has as many rows as it has
    bands (times the tasks that found it), so the window over ids stays small."""
    weighed = members.repartition("id").distinct().withColumn("w", F.count("*").over(Window.partitionBy("id")))
    order = F.shiftleft("w", 50) + F.shiftrightunsigned(F.xxhash64("id"), 14)
    pivots = weighed.groupBy("key").agg(F.max_by("id", order).alias("pivot"))
    return weighed.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct()


# exact comparison


def classes_of(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """For each of these sets (without repeats) the least index that it is linked to, over any
    number of links of similarity ``threshold`` or more. With ``side``, only sets of side True
    are compared, with all of another ``label``; sets of one label are one class."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    if m <= 6 and side is None:
        out = np.arange(m)
        for j, i in [(j, i) for j in range(1, m) for i in range(j)]:
            if out[i] != out[j] and min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                both = np.sort(np.concatenate((sets[i], sets[j])))
                both = np.count_nonzero(both[1:] == both[:-1])
                if both >= threshold * (size[i] + size[j] - both) - 1e-9:
                    out[out == max(out[i], out[j])] = min(out[i], out[j])
        return out
    rows = np.flatnonzero(side) if side is not None else np.arange(m)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    _, place, count = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1)
    rank[shared] = np.arange(len(shared))
    place = rank[place]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both, step = np.zeros((len(rows), m), np.float32), 4096
    for lo in range(0, len(shared), step):  # counts of common elements, as a matrix product
        a, b = np.searchsorted(place, [lo, lo + step])
        held = np.zeros((m, min(step, len(shared) - lo)), np.float32)
        held[owner[a:b], place[a:b] - lo] = 1
        both += held[rows] @ held.T
    linked = both >= threshold * (size[rows][:, None] + size[None, :] - both) - 1e-9
    if label is not None:
        linked &= label[rows][:, None] != label[None, :]
    near = np.zeros((m, m), bool)
    near[rows] = linked
    near |= near.T
    if label is not None:
        near |= label[:, None] == label[None, :]
    np.fill_diagonal(near, True)
    out = np.arange(m)
    while True:
        least = np.where(near, out[None, :], m).min(1)
        least = least[least]
        if (least == out).all():
            return out
        out = least


def compare(decode: Callable[[pa.Array], list[np.ndarray]], threshold: float, sided: bool):
    """mapInArrow function: (task, id, h) sorted by task, with ``sided`` also (side, label), to
    links (a, b) of one task's ids, with ``sided`` of its labels. Sets are made of ``h`` by ``decode``."""

    def close(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks()
        task = whole.column("task").to_numpy()
        at, count = tn.runs(task)
        column = whole.column("h").combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
        ids = whole.column("id").to_numpy()
        ends = np.cumsum(np.r_[0, size_of(column)])
        side, label = (whole.column("side").to_numpy(), whole.column("label").to_numpy()) if sided else (None, ids)
        left, right, lo = [], [], 0
        while lo < len(at):
            # as many tasks at a time as fit the cache
            hi = lo + 1
            while hi < len(at) and at[hi] + count[hi] - at[lo] <= 2048 and ends[at[hi] + count[hi]] - ends[at[lo]] <= 1 << 20:
                hi += 1
            first, last = at[lo], at[hi - 1] + count[hi - 1]
            sets = decode(column.slice(first, last - first))
            for a, n in zip(at[lo:hi], count[lo:hi], strict=True):
                if n > 1:
                    own = slice(a, a + n)
                    found = classes_of(sets[a - first : a - first + n], threshold, *((side[own], label[own]) if sided else ()))
                    to = np.flatnonzero(found != np.arange(n))
                    left.append(label[own][to])
                    right.append(label[own][found[to]])
            lo = hi
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *left])), pa.array(np.concatenate([none, *right]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            task = batch.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if cut or (held and held[-1].column("task")[-1].as_py() != task[0]):
                yield from close([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from close(held)

    return run


def similar_classes(scratch: Scratch, rows: DataFrame, entries: int, features: Callable[[DataFrame], DataFrame], threshold: float, decode, keyed: Callable | None = None) -> DataFrame:
    """(id, root) for the ids of ``rows`` (id, keys) that are linked to another one; with ``keyed``
    this makes (id, keys) batches of other rows.

    ``entries`` is about the number of keys; ``features`` gives (id, size, h) of wanted ids, where
    size is what an id's comparison costs, and ``decode`` makes hash sets of ``h`` in a task.
    """
    members = scratch.put(collisions(rows, entries, keyed))
    met = scratch.put(groups(members))
    scratch.drop(members)
    feats = scratch.put(features(met.select("id").union(met.select("pivot")).distinct()))
    # blocks of each group: as many as its ids or their sizes ask for
    sized = met.join(feats.select("id", "size"), "id").groupBy("pivot").agg((F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / VOLUME))).cast("long").alias("blocks"))
    sized = scratch.put(sized)
    dealt = met.join(sized, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    dealt = dealt.union(sized.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
    tasks = dealt.select(F.xxhash64("pivot", "block").alias("task"), "id").join(feats, "id").select("task", "id", "h")
    roots = components(scratch, tasks.repartition("task").sortWithinPartitions("task", "id").mapInArrow(compare(decode, threshold, False), "a long, b long"))
    more = scratch.put(_across(met, sized, roots, feats, decode, threshold))
    if not more.isEmpty():  # only the classes that these links join are worked on again
        old, top = roots, components(scratch, more)
        roots = scratch.put(carried(scratch, old, top).union(top))
        scratch.drop(old, top)
    scratch.drop(feats, met, sized, more)
    return roots


def _across(met: DataFrame, sized: DataFrame, roots: DataFrame, feats: DataFrame, decode, threshold: float) -> DataFrame:
    """Links of classes, by their labels, between the blocks of groups that are in several: each id
    outside the group's largest class is compared with the ids of all other classes."""
    large = sized.where("blocks > 1")
    named = roots.select("id", F.col("root").alias("label"))
    rest = met.join(large, "pivot").join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))
    by = rest.groupBy("pivot", "label").agg(F.count("*").alias("n")).groupBy("pivot").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), (F.sum("n") - F.max("n")).alias("others"))
    by = by.where("labels > 1").withColumn("lanes", F.ceil(F.col("others") / BLOCK))
    mixed = rest.join(by, "pivot").select("pivot", "id", "label", "blocks", "lanes", (F.col("label") != F.col("main")).alias("side"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    lane = F.pmod(F.xxhash64("id", F.lit(1)), F.col("lanes"))
    span = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cells = mixed.select("pivot", "id", "label", F.lit(False).alias("side"), own.alias("block"), F.explode(span("lanes")).alias("lane"))
    cells = cells.union(mixed.where("side").select("pivot", "id", "label", "side", F.explode(span("blocks")).alias("block"), lane.alias("lane")))
    tasks = cells.groupBy(F.xxhash64("pivot", "block", "lane").alias("task"), "id").agg(F.first("label").alias("label"), F.max("side").alias("side"))
    tasks = tasks.join(feats, "id").select("task", "id", "h", "side", "label")
    return tasks.repartition("task").sortWithinPartitions("task", "id").mapInArrow(compare(decode, threshold, True), "a long, b long").where("a <> b").distinct()


def classed(scratch: Scratch, rows: DataFrame, roots: DataFrame, alone: bool) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, doc_id, ...; a written table) with root instead of id, and of each root ``n``
    rows and the ``head``, the least of them. Without ``alone``, only of classes of several rows.

    An id, as of exact copies, and a class may have any share of the rows: both joins spread them.
    """
    linked = roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).join(linked, "id", "left")
    ids = scratch.put((ids if alone else ids.where("n > 1 or root is not null")).select("id", F.coalesce("root", "id").alias("root"), "n"))
    members = scratch.put(spread_join(rows, ids, ["id"], "n", rows.count()).drop("id", "n"))
    scratch.drop(ids)
    order = [c for c in members.columns if c != "root"]
    return members, scratch.put(members.groupBy("root").agg(F.min(F.struct(*order)).alias("head"), F.count("*").alias("n")))


def size_of(column: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def sets_of(row: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct 48-bit values of each row's hashes, sorted; ``n`` is less than 2**16."""
    key = np.sort(row.astype(U) << U(48) | h >> U(16))
    key = key[tn.runs(key)[0]]
    return np.split(key & U((1 << 48) - 1), np.searchsorted(key >> U(48), np.arange(1, n, dtype=U)))
