"""Near-duplicate documents and lines against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from collections import Counter
from conftest import SF001

from strandline.llm import linededup, minhash, neardup, skew
from strandline.llm import textnum as tn
from strandline.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, pivot long"


def table(spark, texts, extra="x"):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), extra, 0) for i, t in texts], SCHEMA)


def shingles(text, width=5):
    words = re.sub(r"[!-/:-@\[-`{-~\s]+", " ", (text or "").lower()).split()
    if not words:
        return Counter([text or ""])
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def classes(sets, threshold):
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i in ids:
        for x in sets[i]:
            held.setdefault(x, []).append(i)
    # only sets with a common element can be similar
    near = {i: set().union(*(held[x] for x in sets[i])) for i in ids}
    for a in ids:
        for b in near[a]:
            if b < a and find(a) != find(b) and jaccard(sets[a], sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(text, n, rng):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"v{rng.randrange(5000)}" for _ in range(120))
    rows += [(1000 + i, edited(base, rng.choice([1, 2, 3, 4, 6]), rng)) for i in range(60)]
    rows += [(2000, base), (2001, base.upper().replace(" ", "  ")), (2002, " ".join(base.split()[:95])), (2003, " ".join(base.split()[:90])), (2004, None), (2005, ""), (2006, "!!"), (2007, "!!"), (2008, "a b"), (2009, "A, b!"), (2010, "x " * 30_000)]
    return rows


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, corpus)).collect()}
    want = classes({i: shingles(t) for i, t in corpus}, 0.8)
    assert got == want
    assert got[2005] == 2004 and got[2007] == 2006 and got[2009] == 2008


@pytest.mark.parametrize("block", [256, 16])
def test_cut_copies_beside_edited_ones(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(21)
    base = [f"v{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(80):  # pairs under the threshold to the base, over it to each other
        shared = rng.sample(range(100), 14)
        for _ in "xy":
            gone = {*shared, *rng.sample(sorted(set(range(100)) - set(shared)), 8)}
            texts.append(" ".join(x for i, x in enumerate(base) if i not in gone))
    texts += [" ".join(base[: 100 - n]) for n in range(5, 60, 3)]
    texts += [edited(texts[0], rng.choice([4, 8, 12, 16]), rng) for _ in range(40)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows), width=1).collect()}
    assert got == classes({i: shingles(t, 1) for i, t in rows}, 0.8)


def test_keep_one(spark, corpus):
    docs = table(spark, [*corpus, (2000, corpus[-11][1])])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = set(classes({i: shingles(t) for i, t in corpus}, 0.8).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_table(spark):
    empty = table(spark, [(1, "x")]).where("false")
    assert minhash.near_duplicates(empty).count() == 0 and linededup.removals(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = table(spark, [(None, "one two three four five six"), (None, "one two three four five six"), (7, "one two three four five six"), (8, "else")])
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, None, 3), (None, None, 3), (7, None, 3), (8, 8, 1)], key=str)
    assert minhash.keep_one(rows).count() == 2


@pytest.mark.parametrize("words, repeat", [(30, 1), (500, 1), (50, 4)])
def test_dart_signatures_estimate_weighted_jaccard(words, repeat):
    rng = random.Random(words)
    a = [f"w{i}" for i in range(words) for _ in range(rng.randrange(1, repeat + 1))]
    b = list(a)
    for p in rng.sample(range(len(b)), max(1, len(b) // 50)):
        b[p] = f"x{p}"
    row, h, c = tn.word_shingles(pa.array([" ".join(a), " ".join(b)]))
    same = [np.mean(np.equal(*minhash.dart_signatures(row, h, c, 2, 64, seed))) for seed in range(40)]
    assert abs(np.mean(same) - jaccard(shingles(" ".join(a)), shingles(" ".join(b)))) < 0.03


def test_word_hashes_do_not_depend_on_place():
    text = "alpha beta " * 5000 + "ünï " + "z" * 70_000
    raw, off = tn.buffers(pa.array([text, text]))
    s, e = tn.word_spans(raw, off)
    h = tn.span_hashes(raw, s, e)
    assert len(set(h.tolist())) == 4 and (h[: len(h) // 2] == h[len(h) // 2 :]).all()


def test_components_of_long_chains(spark):
    links = spark.range(0, 200).selectExpr("id * 7 % 201 as a", "(id + 1) * 7 % 201 as b").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (1002, 1002)], "a long, b long"))
    got = {r.id: r.root for r in neardup.components(Scratch(spark, "test"), links).collect()}
    assert set(got.values()) == {0, 1000} and got[1001] == 1000 and 1002 not in got and len(got) >= 201


def random_links(kind, rng):
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    if kind == "runs":
        ids = sorted(ids)
    if kind == "hub":
        return [(ids[0], x) for x in ids[1:300]] + [(ids[5], ids[310]), (ids[310], ids[311]), (ids[320], ids[321])]
    if kind == "tree":
        return [(ids[i], ids[rng.randrange(max(1, i // 2), i + 1)]) for i in range(1, 380)]
    return [*zip(ids[:60], ids[1:60], strict=False), *zip(ids[61:90], ids[62:90], strict=False)]


@pytest.mark.parametrize("kind, plain", [("runs", 1), ("hub", 4), ("tree", 4)])
def test_components_equal_union_find(spark, monkeypatch, kind, plain):
    monkeypatch.setattr(neardup, "PLAIN", plain)
    monkeypatch.setattr(skew, "HOT", 16)
    links = random_links(kind, random.Random(8))
    root = {x: x for x in sum(links, ())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = neardup.components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root if find(x) != x)


def test_components_write_whole_classes_once(spark, monkeypatch):
    written, put = [], Scratch.put

    def counted(self, df):
        out = put(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    # 400 pairs and stars, which one round does, and a chain that takes more
    links = [(1000 * i, 1000 * i + j) for i in range(1, 501) for j in range(1, 1 + i % 5)] + [(i, i + 1) for i in range(1, 4)]
    got = neardup.components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(links) == 1003
    # links, ids with their next, ids with their roots, the result; rounds may not write them all again
    assert sum(written) < 6 * len(links)


# lines


def line_set(line, width=5):
    return Counter({line[i : i + width]: 1 for i in range(max(1, len(line) - width + 1))})


def removed_by_hand(rows):
    places, sets = {}, {}
    for i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            norm = line.strip(" \t\n\x0b\x0c\r").lower()
            if norm:
                places.setdefault(norm, []).append((i, j))
                sets[norm] = line_set(norm)
    first = {k: min(v) for k, v in places.items()}
    by_first = {first[k]: s for k, s in sets.items()}
    root = classes(by_first, 0.8)
    return {p for k, v in places.items() for p in v if p != root[first[k]]}


def removed(spark, rows, **how):
    return {(r.doc_id, x.pos) for r in linededup.removals(table(spark, rows), **how).collect() for x in r.removed}


@pytest.fixture(scope="module")
def line_rows(spark):
    rng = random.Random(9)
    lines = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(rng.randrange(4, 40))) for _ in range(60)]
    rows = []
    for i in range(40):
        own = [edited(x, 1, rng) if rng.random() < 0.3 else x for x in rng.sample(lines, 5)]
        rows.append((i, "\n".join([*own, "short", f"x{i % 7}", "", "a line with one letter changed in it, of 60 characters: " + "abcdefghij"[i % 10]])))
    return [*rows, (100, None), (101, ""), (102, "y" * 50_000), (103, "Y" * 50_000 + "\n"), (104, "tail line of no other text at all")]


def test_line_dedup_equals_brute_force(spark, line_rows):
    docs, want = table(spark, line_rows), removed_by_hand(line_rows)
    assert removed(spark, line_rows) == want and {(103, 0), (1, 5), (39, 6), (11, 8)} <= want and (0, 7) not in want
    clean = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    for i, t in line_rows:
        assert clean[i] == (None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in want))
    assert linededup.dedup_lines(docs).columns == docs.columns


@pytest.mark.parametrize("block", [256, 8])
def test_many_edited_copies_of_a_line(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    base = " ".join(f"z{rng.randrange(9000)}" for _ in range(40))
    rows = [(i, edited(base, rng.choice([1, 2, 3, 4, 5, 6]), rng)) for i in range(120)]
    assert removed(spark, rows) == removed_by_hand(rows)


def test_lines_at_the_threshold_are_found(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        # 31 to 60 shingles, of which a ninth differ on either side
        common = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(32, 59)))
        tails = ["".join(rng.choice("0123456789") for _ in range((len(common) - 4) // 8)) for _ in "ab"]
        rows += [(2 * i, f"x{common}{tails[0]}"), (2 * i + 1, f"x{common}{tails[1]}")]
    want = removed_by_hand(rows)
    assert removed(spark, rows) == want and len(want) > 1000


def test_keys_of_several_tasks_and_of_one_meet():
    ids = np.arange(1, 41)
    keys = {int(i): np.array([7, 1000 + i // 2, 5_000_000 + i], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in ids}

    def batch(of):
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), tn.packed(np.concatenate([keys[int(i)] for i in of]), np.full(len(of), 3))], names=["id", "keys"])

    for split in ([ids[:20], ids[20:]], [ids[::2], ids[1::2], ids[:3]], [[i] for i in ids]):
        rows = sorted((r for part in split for b in neardup.fold(16)(iter([batch(part)])) for r in b.to_pylist()), key=lambda r: r["part"])
        entries = pa.RecordBatch.from_pylist(rows)
        got = {(r["key"], r["id"]) for b in neardup.meet(iter([entries])) for r in b.to_pylist()}
        part = lambda k: int(k >> np.uint64(32)) * 16 >> 32
        want = {(int(neardup.name(part(keys[i][c]), keys[i][c])), i) for i in keys for c in (0, 1) if c == 0 or i not in (1, 40)}
        assert got == want


def test_tasks_across_batches():
    texts = ["a b c", "a b d", "x y z", "x y q", "m n o", "m n p", "m n r", "k"]
    decode = lambda column: [np.unique([hash(w) & 0xFFFF for w in x.split()]).astype(np.uint64) for x in column.to_pylist()]
    whole = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 3, 3, 3, 4]), pa.array(range(8)), pa.array(texts)], names=["task", "id", "h"])
    for cuts in ([8], [1, 2, 3, 4, 5, 6, 7, 8], [3, 3, 8], [2, 6, 8]):
        batches = [whole.slice(a, b - a) for a, b in zip([0, *cuts], cuts)]
        got = [(r["a"], r["b"]) for b in neardup.compare(decode, 0.5, False)(iter(batches)) for r in b.to_pylist()]
        assert got == [(1, 0), (3, 2), (5, 4), (6, 4)]


def test_char_shingles_and_bins():
    points = np.frombuffer("abcdefghij".encode("utf-32-le"), np.uint32)
    line, h = linededup.char_shingles(np.concatenate([points, points]), np.array([10, 10]), 7)
    assert line.tolist() == [0] * 4 + [1] * 4 and (h[:4] == h[4:]).all() and len(set(h.tolist())) == 4
    sig = linededup.without_empty(linededup.one_permutation(line, h, 2, 24))
    assert (sig[0] == sig[1]).all() and len(set(sig[0].tolist())) >= 4
