"""Vectorised text numerics over Arrow string columns (NumPy, no per-row loops)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: ASCII white space as the contracts define it.
SPACES = b" \t\n\x0b\x0c\r"
_OFF = np.zeros(256, bool)
_OFF[list(SPACES)] = True
#: Words for shingling: everything that is neither ASCII white space nor ASCII punctuation.
_WORD = ~_OFF
_WORD[[c for c in range(33, 127) if not chr(c).isalnum()]] = False
_B = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix: a bijection that spreads all bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_STEP = 1 << 12
_INV = pow(int(_B), -1, 1 << 64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & ((1 << 64) - 1), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_LOW, _LOW_INV = _table(int(_B), _STEP), _table(_INV, _STEP)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, as products of a coarse and a fine table."""
    return np.multiply.outer(_table(pow(int(_B), _STEP, 1 << 64), n // _STEP + 1), _LOW).ravel()[:n]


def _inverse(at: np.ndarray, n: int) -> np.ndarray:
    return _table(pow(_INV, _STEP, 1 << 64), n // _STEP + 1)[at // _STEP] * _LOW_INV[at % _STEP]


def buffers(column: pa.Array, kind=pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, or one of another ``kind``; null counts as empty."""
    column = pc.fill_null(column.cast(kind), pa.scalar("", pa.string()).cast(kind))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = 4 << 20, rows: int = 1 << 15):
    """Slices of at most ``rows`` rows and about ``most`` bytes; a longer text stands alone."""
    n = len(column)
    if not n:
        return
    size = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < n:
        before = size[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(size, before + most, "right"))))
        yield at, end
        at = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none crosses a row's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = table[raw]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] |= is_word[inner]
    last[inner - 1] |= is_word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's values: differences of one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(raw)
    sums = np.zeros(n + 1, U)
    np.cumsum(_powers(n) * (raw.astype(U) + U(1)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse(starts, n) + (ends - starts).astype(U))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return at, np.diff(np.r_[at, len(values)])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of all rows, one after another."""
    total = int(lens.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)


def lists(values: np.ndarray, lens: np.ndarray, kind=pa.int64()) -> pa.Array:
    """A list column of consecutive slices of ``values``."""
    offsets = np.r_[0, np.cumsum(lens)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64) if kind == pa.int64() else values, kind))


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of 64-bit ``values``."""
    offsets = (np.r_[0, np.cumsum(counts)] * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def word_shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row; hashes keep 48 bits of identity.

    Words are lower-cased runs without ASCII white space and punctuation. A text
    of fewer than ``width`` words is one shingle of all its words; a text without
    words is one shingle made of its raw bytes (null: of none).
    """
    raw, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    row_of = np.searchsorted(offsets, starts, "right") - 1
    n = len(column)
    per = np.bincount(row_of, minlength=n).astype(np.int64) if len(row_of) else np.zeros(n, np.int64)
    first = np.cumsum(per) - per
    count = np.where(per >= width, per - width + 1, 0)
    at = ragged(first, count)
    hashes = np.zeros(len(at), U)
    for j in range(width):
        hashes = hashes * _B + (words[at + j] if len(at) else hashes)
    rows = np.repeat(np.arange(n), count)
    short = np.flatnonzero((per > 0) & (per < width))
    empty = np.flatnonzero(per == 0)
    small = [int(mix(np.array([sum((int(w) * (2 * k + 3)) for k, w in enumerate(words[first[i] : first[i] + per[i]])) % (1 << 64) + int(per[i])], U))[0]) for i in short]
    bare = span_hashes(raw, offsets[:-1][empty], offsets[1:][empty]) if len(empty) and (offsets[1:][empty] > offsets[:-1][empty]).all() else np.array([_bare(raw[offsets[i] : offsets[i + 1]]) for i in empty], U)
    rows = np.r_[rows, short, empty].astype(np.int64)
    hashes = np.r_[mix(hashes), np.array(small, U), bare]
    # one sort of (row, upper 48 bits): rows of a chunk are fewer than 2**16
    key = np.sort(rows.astype(U) << U(48) | hashes >> U(16))
    at, count = runs(key)
    key = key[at]
    return (key >> U(48)).astype(np.int64), mix(key & U((1 << 48) - 1)), count


def _bare(piece: np.ndarray) -> int:
    if not len(piece):
        return 1
    return int(span_hashes(piece, np.array([0]), np.array([len(piece)]))[0])


def set_key(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each row's weighted set."""
    c = counts.astype(U)
    out = []
    for seed in (0x1234567, 0x7654321):
        total = np.zeros(n, U)
        at, _ = runs(rows)
        if len(at):
            total[rows[at]] = np.add.reduceat(mix(hashes ^ U(seed)) * (c * U(2) + U(1)), at)
        out.append(mix(total + U(seed)).astype(np.int64))
    return out[0], out[1]
