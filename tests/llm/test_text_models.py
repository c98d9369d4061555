"""Classifiers, token counts and media: held-out accuracy, brute force, round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from strandline.llm import langid, media, quality, queries, sampling, tokencount, wordbpe

ODD = [(1, None), (2, ""), (3, "日本語 テキスト ünï"), (4, "x " * 40_000), (5, "same text"), (5, "same text"), (None, "no id"), (6, "123 !!"), (7, "y" * 100_000)]
SCHEMA = "doc_id long, text string, score string, lang_pred int, media int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in ODD], SCHEMA)


def test_quality_held_out(spark):
    got = queries.op5_quality(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93
    assert queries.op5_quality(spark, SF01).count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_quality_edges(spark, odd):
    labelled = spark.createDataFrame([(4, 0), (5, 1), (6, None), (7, 3), (5, 1)], "doc_id long, label int")
    weights = quality.fit(odd, labelled)
    rows = quality.score(odd, weights).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id == 5}) == 1
    blank = quality.score(odd, quality.fit(odd.limit(0), labelled)).collect()
    assert {r.score for r in blank} == {0.5} and quality.score(odd.limit(0), weights).count() == 0


def test_ftrl_learns_a_word():
    texts = pa.array([f"a{i} good b{i}" if i % 2 else f"a{i} bad b{i}" for i in range(200)])
    row, place, weight = quality.grams(texts, 14)
    w = quality.ftrl(row, place, weight, np.arange(200) % 2, 1 << 14)
    row, place, weight = quality.grams(pa.array(["new good", "new bad", ""]), 14)
    dot = np.bincount(row, weights=w[place] * weight, minlength=3)
    assert dot[0] > 1 and dot[1] < -1 and dot[2] == 0


def test_language_held_out(spark):
    got = queries.op8_language(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_edges(spark, odd):
    docs = spark.createDataFrame([(i, f"the cat and the dog {i}" if i % 2 else f"der hund und die katze {i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs, docs)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert {x[1] for x in rows if x[0] in (1, 2, 6)} == {"und"} and {x[2] for x in rows if x[0] in (1, 2, 6)} == {0.0}
    assert langid.predict(odd, model).count() == len(ODD)
    none = langid.fit(docs.limit(0), docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    one = langid.fit(docs, docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"en"}


def test_samples_are_distinct_and_by_label(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    labelled = spark.createDataFrame([(7, "a")] * 900 + [(i, "a") for i in range(300)] + [(i, "b") for i in range(300, 305)] + [(7, "b"), (None, "a"), (8, None), (399, "c")], "doc_id long, label string")
    got = [(r.doc_id, r.label) for r in sampling.sample_of(docs, labelled, 20, "label").collect()]
    assert len(got) == len(set(got)) == 26 and sum(x == "a" for _, x in got) == 20 and sum(x == "b" for _, x in got) == 5 and (399, "c") in got
    again = [(r.doc_id, r.label) for r in sampling.sample_of(docs, labelled.repartition(7), 20, "label").collect()]
    assert set(again) == set(got)
    assert {x for _, x in {(r.doc_id, r.label) for r in sampling.sample_of(docs, labelled, 20, "label", labels=2).collect()}} == {"a", "b"}


@pytest.mark.parametrize("k", [2, 4, 5, 9, 30])
def test_codewords(k):
    code = langid.codewords(k)
    assert code.shape[0] == k and len({tuple(r) for r in code.tolist()}) == k
    if 2 < k <= 5:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 2


def greedy(word, initial, later):
    n, at = 0, 0
    while at < len(word) or n == 0:
        vocab = initial if n == 0 else later
        end = next((e for e in range(len(word), at - 1, -1) if word[at:e] in vocab and (e > at or n == 0)), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy():
    import itertools

    initial, later = {b"a", b"abcdx", b"b", b"c", b"cdy", b"dz"}, {b"b", b"c", b"cd", b"dy", b"z", b"d"}
    for lone in (False, True):
        first = initial | ({b""} if lone else set())
        machine = tokencount.Automaton(sorted(first), sorted(later))
        for n in range(1, 7):
            for word in itertools.product(b"abcdxyz", repeat=n):
                word = bytes(word)
                assert machine.count(word) == greedy(word, first, later), (word, lone)


def test_token_counts(spark, odd):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    initial, later = map(set, tokencount.pieces_of(path))
    rows = tokencount.count_tokens(odd, path).collect()
    assert len(rows) == len(ODD)
    for r, (_, text) in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(ODD, key=lambda x: str(x[0])), strict=True):
        words = (text or "").encode().split()
        assert r.n_words == len(words)
        if len(text or "") < 90_000:
            assert r.n_tokens == sum({w: greedy(w, initial, later) for w in set(words)}[w] for w in words)


def test_word_bpe_equals_tokenizer():
    import random

    rng = random.Random(3)
    letters = "abzAZ'sdmt1239.,-—#  \n\té́éßİΣς日本½²،٣😀\u200b\x1c\x85\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", "<|endoftext|> hi", "it's we'll don't x'", "a" * 300, "é" * 200]
    assert wordbpe.verify(queries.tokenizer_path("word_bpe_49k.json"), texts) == []


def test_media_round_trip(spark, odd):
    stored = media.store(odd)
    assert stored.columns == ["doc_id", "score", "lang_pred", "n_bytes", "media"]
    rows = media.digest(media.read_media(media.store(odd.select("doc_id", "text")))).collect()
    assert len(rows) == len(ODD)
    by_sha = {}
    for _, t in ODD:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        by_sha[hashlib.sha256(p).hexdigest()] = (len(b), len(p), zlib.crc32(p[-64:]))
    for r in rows:
        assert by_sha[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32) and r.media_bytes == r.payload_bytes + 44
    assert len({r.feature for r in rows if r.doc_id == 5}) == 1 and len({r.feature for r in rows if r.doc_id in (4, 7)}) == 2


def test_media_peaks():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / 512)).astype(np.uint8)
    mags = media.spectrum(tone)
    assert (mags[:, 1:].argmax(1) + 1 == 40).all()
    codes, times = media.fingerprint(tone)
    again, times2 = media.fingerprint(tone, block=5)
    assert (codes == again).all() and (times == times2).all() and (np.diff(times) >= 0).all()
    with pytest.raises(Exception):
        media.from_wav(b"not a file")


@pytest.mark.parametrize("n", [64, 512, 576, 704, 768, 832, 8256])
def test_media_frames_reach_the_end(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 256, n).astype(np.uint8)
    b = a.copy()
    b[-64:] = rng.integers(0, 256, 64)
    assert len(media.spectrum(a)) == max(0, -(-(n - 512) // 256)) + 1
    assert not np.array_equal(media.spectrum(a)[-1], media.spectrum(b)[-1])
    whole, parts = media.fingerprint(a), media.fingerprint(a, block=3)
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))
    padded = media.fingerprint(np.r_[a, np.full(-(n - 512) % 256 if n > 512 else 512 - n, 128, np.uint8)])
    assert all(np.array_equal(x, y) for x, y in zip(whole, padded, strict=True))
