"""The pipeline's stages, each against its own input."""

import re
from collections import Counter

import pytest
from conftest import SF001
from test_neardup import classes, removed_by_hand, shingles

import corpus_pipeline
from strandline.llm import rules


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF001).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns(spark, steps):
    want = spark.read.parquet(f"{SF001}/documents.parquet").columns
    assert [n for n, _, _ in steps] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert all(out.columns == want for _, _, out in steps[:-1])


def test_quality_stage(steps):
    _, before, after = steps[0]
    kept = {r.doc_id: r for r in rules.judge(before).collect() if r.kept}
    texts = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r for r in after.collect()}
    assert got.keys() == kept.keys()
    for i, r in got.items():
        gone = set(kept[i].gone or ())
        assert r.text == "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in gone) and r.n_chars == len(r.text)


def test_line_stage(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    gone = removed_by_hand(rows)
    want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows}
    got = {r.doc_id: r.text for r in after.collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_near_stage(steps):
    _, before, after = steps[2]
    heads = set(classes({r.doc_id: shingles(r.text) for r in before.collect()}, 0.8).values())
    assert sorted(r.doc_id for r in after.collect()) == sorted(heads)


def test_mix_stage(steps):
    _, before, after = steps[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    words = sum(size(r.text) for r in before.collect())
    assert abs(sum(size(r.text) for r in after.collect()) - words) < 0.35 * words


def test_pack_stage(steps):
    _, before, after = steps[4]
    rows = after.collect()
    assert sum(r.piece == 0 for r in rows) == before.count() and max(r.length for r in rows) <= 2048


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF001).count() == steps[-1][2].count()
