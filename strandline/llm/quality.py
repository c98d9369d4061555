"""Quality classifier: hashed word n-grams, logistic regression by FTRL-Proximal.

Features of a text are its one- and two-token grams, hashed to ``2**bits`` places
and weighted by the square root of their counts, normalised to length 1. Tokens are
runs of letters and digits or of one other character class, case kept, so shouting, symbol
noise and tables show in them; a token that repeats the one before is its own
gram. A score is a sparse dot product through a logistic function.

A null or empty text has no features and scores by the bias alone. The model is
learned from at most ``sample`` documents of either label, those of the least hashes; without
any row of either label it is 0 everywhere, a score of one half. Repeated rows score alike;
labels of other values than 0 and 1, and null labels, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import textnum as tn
from strandline.llm.linear import train
from strandline.llm.sampling import sample_of
from strandline.llm.scratch import ship

U = np.uint64
#: Byte classes: white space, letters and digits, other ASCII.
_KIND = np.full(256, 1, np.uint8)
_KIND[[c for c in range(128) if not chr(c).isalnum()]] = 2
_KIND[list(tn.SPACES)] = 0


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[raw]
    edge = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    edge[inner - 1] = True
    some = kind != 0
    return np.flatnonzero(np.r_[True, edge] & some), np.flatnonzero(np.r_[edge, True] & some) + 1


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight) of all texts, sorted by row and place."""
    raw, offsets = tn.buffers(texts)
    starts, ends = token_spans(raw, offsets)
    h = tn.span_hashes(raw, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    pair = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    two = tn.mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[pair] if len(h) else h
    same = (h[1:] == h[:-1])[pair] if len(h) else np.zeros(0, bool)
    two[same] = U(0x5A5A)
    rows = np.r_[row, row[1:][pair]] if len(row) else row
    key = rows.astype(np.int64) << bits | (np.r_[h, two] & U((1 << bits) - 1)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    rows, place = key >> bits, key & ((1 << bits) - 1)
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(rows, weights=count, minlength=len(texts)))
    return rows, place, weight / norm[rows]


def ftrl(rows, place, weight, y, size, epochs=5, alpha=2.0, beta=1.0, l1=0.01, l2=0.0) -> np.ndarray:
    """FTRL-Proximal, one example at a time; the last weight is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    at = np.searchsorted(rows, np.arange(len(y) + 1))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in range(len(y)):
            i = np.append(place[at[r] : at[r + 1]], size)
            x = np.append(weight[at[r] : at[r + 1]], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y[r]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def fit(docs: DataFrame, labelled: DataFrame, sample: int = 6_000, bits: int = 16, shards: int = 6, **how) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and ``labelled`` (doc_id, label 0 or 1)."""
    ship(docs.sparkSession)

    def one(part: pd.DataFrame) -> np.ndarray:
        rows, place, weight = grams(pa.array(part["text"], pa.string()), bits)
        return ftrl(rows, place, weight, part["label"].to_numpy(np.float64), 1 << bits, **how)

    labelled = labelled.where("label in (0, 1)")
    rows = sample_of(docs, labelled, sample, "label")
    return train(rows, one, (1 << bits) + 1, max(1, min(shards, min(2 * sample, labelled.count()) // 2_000)))


def score(rows: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1. The weights have a fixed size, whatever the corpus."""
    ship(rows.sparkSession)
    bits = (len(weights) - 1).bit_length() - 1
    held = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names = [c for c in rows.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for lo, hi in tn.chunks(batch.column(text), 2 << 20):
                part = batch.slice(lo, hi - lo)
                row, place, weight = grams(part.column(text), bits)
                dot = np.bincount(row, weights=w[place] * weight, minlength=len(part)) + w[-1]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=[*names, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, text).mapInArrow(run, f"{kinds}, `{name}` double")
