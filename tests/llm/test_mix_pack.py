"""Mixing and packing: targets, unbiased rounding, plans against exhaustive search."""

import random
import zlib
from collections import Counter

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from strandline.llm import mixing, packing, queries


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def docs(spark, rows):
    return spark.createDataFrame([(i, s, " ".join(["w"] * n) if n is not None else None, "x", 1) for i, s, n in rows], "doc_id long, source string, text string, copies string, k int")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 900, None: 50, "z": 0}, {"b": 7, "a": 1000, "Ä": 3, "c": 5, "d": 90}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, [5, 2, 1], 3).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_reaches_targets_and_reruns(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(1, 60)) for i in range(3000)] + [(9000, "a", None), (9001, "b", 0), (7, "a", 5), (7, "a", 5)]
    got = mixing.copies(docs(spark, rows)).collect()
    again = mixing.copies(docs(spark, rows).repartition(7)).collect()
    key = lambda r: (r.doc_id, str(r.source), r.size, r.k, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = filled(dict(size))
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 60 for s in want)


def test_rounding_is_unbiased(spark):
    rows = docs(spark, [(i, "a", 1 + i % 5) for i in range(40)] + [(100 + i, "b", 3) for i in range(40)])
    total = Counter()
    for seed in range(12):
        for r in mixing.copies(rows, weights=(1, 2), seed=seed, block=4).collect():
            total[r.source] += r.copies
    # sizes are 120 and 120, shares 1 to 2: 80 and 160 words of 120
    assert abs(total["a"] / 480 - 80 / 120) < 0.08 and abs(total["b"] / 480 - 160 / 120) < 0.03


def test_mixed_rows(spark):
    rows = docs(spark, [(i, "ab"[i % 2], 10) for i in range(60)] + [(3, "b", 10)])
    out = mixing.mix(rows, weights=(5, 1))
    counts = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in mixing.copies(rows, weights=(5, 1)).collect():
        want[r.doc_id] += r.copies
    assert counts == +want and out.columns == rows.columns
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.copies(rows.where("false")).count() == 0
    assert mixing.copies(docs(spark, [(1, None, None), (2, "a", 0)])).agg(F.sum("copies")).first()[0] == 0


def optimum(items, capacity):
    best = [len(items)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        x, seen = rest[0], set()
        for i, r in enumerate(rooms):
            if r >= x and r not in seen:
                seen.add(r)
                go(rest[1:], [*rooms[:i], r - x, *rooms[i + 1 :]])
        go(rest[1:], [*rooms, capacity - x])

    go(sorted(items, reverse=True), [])
    return best[0]


def test_reduction_never_costs_a_bin():
    rng = random.Random(2)
    for _ in range(1500):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        stock = packing.Stock(Counter(items))
        fixed = packing.reduce(stock, 20)
        rest = [x for x in stock.lengths for _ in range(stock.n[x])]
        assert Counter(items) == Counter(rest) + Counter(x for s, n in fixed for x in s * n)
        assert all(sum(s) <= 20 for s, _ in fixed)
        assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20), items


def test_plan_is_gapless():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.expovariate(1 / 600)) + 1) for _ in range(4000))
    entries, fill, n = packing.plan(counts, 2048), {}, 0
    for i, (w, first, seq, off) in enumerate(entries):
        last = entries[i + 1][1] if i + 1 < len(entries) and entries[i + 1][0] == w else counts[w]
        for k in range(last - first):
            fill.setdefault(seq + k, []).append((off, w))
            n += 1
    assert n == sum(counts.values())
    for parts in fill.values():
        at = 0
        for off, w in sorted(parts):
            assert off == at
            at += w
        assert at <= 2048
    assert len(fill) <= 1.01 * (sum(w * c for w, c in counts.items()) / 2048) + 1
    assert packing.plan({}, 2048) == []


def test_pack(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()] + [(900, None), (901, ""), (902, "word " * 9000), (903, "a b c"), (903, "a b c"), (None, "x")]
    rows = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, length int")
    got = packing.pack(rows, path).collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, p, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert packing.pack(rows.limit(0), path).count() == 0
