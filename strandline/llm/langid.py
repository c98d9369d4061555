"""Language ID by error-correcting output codes over character n-grams.

Each language has a codeword; each bit has a logistic classifier on hashed
character n-grams (1 to 3 code points). A text goes to the codeword of the least
loss, where each bit's logistic loss is weighted by that bit's training accuracy.
``score`` is the chosen codeword's share among exp(-loss); a text is ``ambiguous``
if the runner-up's loss is within ``margin``.

A null text or one without a letter is ``und`` with score 0. Training uses at most
``sample`` documents of each language (of the 256 most frequent ones), those of the
least hashes; without any, all is ``und``. Repeated rows get the same answer; null languages are not learned. Other columns are passed by.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandline.llm import textnum as tn
from strandline.llm.linear import train
from strandline.llm.sampling import sample_of
from strandline.llm.scratch import ship

U = np.uint64


def codewords(k: int, most: int = 31, seed: int = 11) -> np.ndarray:
    """(k, bits) of -1 and 1: the exhaustive code of up to five classes, else the
    best of many random codes by least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float64).T
    bits = max(most, 4 * int(np.ceil(np.log2(k))))
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (k, bits))
        near = (bits - (code @ code.T - 2 * bits * np.eye(k)).max()) / 2
        if near > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, near
    return best


def gram_matrix(texts: pa.Array, bits: int) -> np.ndarray:
    """(texts, 2**bits) root shares of hashed grams of one to three code points of words."""
    size = 1 << bits
    joined = "\n".join(x or "" for x in texts.to_pylist()).lower()
    lens = np.fromiter((len(x.lower()) if x else 0 for x in texts.to_pylist()), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    row = np.repeat(np.arange(len(lens)), lens + 1)[: len(points)]
    # all that is no letter is a border
    letter = (points >= 128) | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, U(32))
    out = np.zeros(len(lens) * size, np.float32)
    h = np.zeros(len(points), U)
    for width in range(1, 4):
        if len(points) < width:
            break
        n = len(points) - width + 1
        h = h[:n] * U(0x100000001B3) + points[width - 1 :] + U(1)
        ok = (row[:n] == row[width - 1 :]) & (letter[:n] | letter[width - 1 :])
        place = (tn.mix(h[ok] + U(width << 56)) >> U(64 - bits)).astype(np.int64)
        out += np.bincount(row[:n][ok] * size + place, minlength=len(out)).astype(np.float32)
    out = out.reshape(len(lens), size)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def fit(docs: DataFrame, labelled: DataFrame, sample: int = 1_500, bits: int = 12, shards: int = 6, epochs: int = 60, rate: float = 4.0, ridge: float = 1e-5) -> dict:
    """Model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, lang)."""
    ship(docs.sparkSession)
    rows = sample_of(docs, labelled, sample, "lang")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # a bounded sample
    if not langs:
        return {"langs": []}
    code, size = codewords(len(langs)), 1 << bits
    width = code.shape[1]

    def one(part: pd.DataFrame) -> np.ndarray:
        x = gram_matrix(pa.array(part["text"], pa.string()), bits)
        goal = code[[langs.index(v) for v in part["lang"]]].astype(np.float32)
        w, b = np.zeros((size, width), np.float32), np.zeros(width, np.float32)
        seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
        for _ in range(epochs):  # AdaGrad on the whole shard
            push = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) / len(x)
            gw, gb = x.T @ push + ridge * w, push.sum(0)
            seen_w += gw * gw
            seen_b += gb * gb
            w -= rate * 0.1 * gw / np.sqrt(seen_w)
            b -= rate * 0.1 * gb / np.sqrt(seen_b)
        right = (np.sign(x @ w + b) == goal).mean(0)
        return np.r_[w.ravel(), b, right]

    flat = train(rows, one, (size + 2) * width, max(1, min(shards, min(sample * len(langs), labelled.count()) // 1_000)))
    w, b, right = flat[: size * width].reshape(size, width), flat[size * width : -width], flat[-width:]
    return {"langs": langs, "code": code, "w": w.astype(np.float32), "b": b, "bits": bits, "trust": np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999))) / np.log(999)}


def decode(model: dict, margins: np.ndarray, margin: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) by the least weighted loss."""
    loss = (np.log1p(np.exp(np.clip(-margins[:, None, :] * model["code"][None], -30, 30))) * model["trust"]).sum(2)
    best = loss.argmin(1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    ordered = np.sort(loss, 1)
    close = ordered[:, 1] - ordered[:, 0] < margin if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, 1 / share.sum(1), close


def predict(rows: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous. The model has a fixed size for its languages."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c not in (text, "lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo, hi in tn.chunks(batch.column(text), 1 << 20):
                for at in range(lo, hi, 512):
                    part = batch.slice(at, min(512, hi - at))
                    texts = pc.fill_null(part.column(text), "")
                    known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                    lang, score, close = np.full(len(part), "und", object), np.zeros(len(part)), np.zeros(len(part), bool)
                    if known.any() and model["langs"]:
                        best, sure, near = decode(model, gram_matrix(texts.filter(pa.array(known)), model["bits"]) @ model["w"] + model["b"])
                        lang[known], score[known], close[known] = np.array(model["langs"], object)[best], sure, near
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, text).mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")
