"""Media columns: WAV files in a binary column, with spectral-peak fingerprints.

``store`` writes each payload as an 8-bit mono WAV file by the ``wave`` module;
``read_media`` opens the stored bytes again, takes short-time Fourier transforms of
the samples, and pairs spectral peaks into (frequency, frequency, time step)
codes kept as an array with the time of each. Both are plain columns, so media
travel through joins and files like any other value.

A null payload counts as empty. Payloads are padded with zero bytes to a positive
multiple of 64, so every file has samples; the true length is kept. Files are
handled one by one: memory is bounded by one batch. Bytes that are not a WAV
file raise an error. Other columns are passed by.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.scratch import ship

UNIT = 64
FRAME, HOP, RATE = 512, 256, 8000
#: Peaks: the strongest bin of each of these bands (bin numbers of a 512-sample transform).
BANDS = (1, 9, 17, 33, 65, 129, 257)
#: A peak pairs with those of the next frames at these distances.
REACH = (1, 2, 3)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("8-bit mono samples expected")
        return f.readframes(f.getnframes())


def frame_count(n: int) -> int:
    """Frames that cover ``n`` samples, the last one padded if need be."""
    return max(0, -(-(n - FRAME) // HOP)) + 1


def spectrum(samples: np.ndarray) -> np.ndarray:
    """(frames, bins) magnitudes of Hann-windowed frames; silence fills the last frame."""
    x = (samples.astype(np.float32) - 128) / 128
    x = np.pad(x, (0, (frame_count(len(x)) - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1))


def fingerprint(samples: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times): pairs of band peaks, with the first one's frame."""
    peaks = []
    total = frame_count(len(samples))
    for lo in range(0, total, block):  # long signals go through in blocks of frames
        mags = spectrum(samples[lo * HOP : (min(lo + block, total) - 1) * HOP + FRAME])
        peaks.append(np.stack([a + mags[:, a:b].argmax(1) for a, b in zip(BANDS, BANDS[1:], strict=False)], 1))
    peak = np.concatenate(peaks)
    codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for step in REACH:
        if len(peak) > step:
            codes.append(((peak[:-step].astype(np.int64) << 12 | peak[step:, ::-1]) << 4 | step).ravel())
            times.append(np.repeat(np.arange(len(peak) - step, dtype=np.int32), peak.shape[1]))
    if len(peak) == 1:
        codes.append(peak[0].astype(np.int64) << 16)
        times.append(np.zeros(peak.shape[1], np.int32))
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((codes, times))
    return codes[order], times[order]


def store(rows: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media`` (the WAV file) and ``n_bytes`` (the unpadded payload), of UTF-8 text."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c not in (text, media, "n_bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sizes, files = [], []
                for value in part.column(text).to_pylist():
                    payload = (value or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(payload))
                    files.append(to_wav(payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[*names, "n_bytes", media])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, text).mapInArrow(run, f"{kinds}, n_bytes long, `{media}` binary")


def read_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """Reads ``media`` back: size and digests of payload and file, fingerprint codes and times."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != media]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                out = []
                for value in part.column(media).to_pylist():
                    payload = from_wav(value)
                    codes, times = fingerprint(np.frombuffer(payload, np.uint8))
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), codes, times))
                made = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(v, k) for v, k in zip(made, kinds, strict=True)]], names=[*names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codes", "times"])

    return rows.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """Adds ``feature``: a digest of the fingerprint arrays, and their size."""
    return rows.withColumn("n_codes", F.size("codes").cast("long")).withColumn("feature", F.sha2(F.concat_ws("|", F.array_join(F.col("codes").cast("array<string>"), ","), F.array_join(F.col("times").cast("array<string>"), ",")), 256))
