"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots: pieces that begin a word and
pieces that continue one. Every node knows, beforehand, what happens when its path
cannot go on: how many pieces the greedy match pops (``popped``) and the node
where matching resumes (``fail``). Counting a word then reads each byte once and
adds up popped counts; no piece is ever built.

Words are white-space separated and greedily matched, longest piece first. A word
that no pieces cover counts as one unknown token. Null and empty texts have 0.
Distinct words of a batch are counted once. Other columns are passed by.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import textnum as tn
from strandline.llm.scratch import ship

_ready: dict[tuple, Automaton] = {}


class Automaton:
    """``initial`` and ``later`` are the pieces (bytes) that begin and continue words;
    an empty initial piece is a mark that may stand alone before any word."""

    def __init__(self, initial: list[bytes], later: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        parent = [(0, 0, 0), (1, 0, 1)]  # (parent, byte, root)
        for root, pieces in ((0, initial), (1, later)):
            for p in pieces:
                at = root
                for byte in p:
                    if byte not in self.next[at]:
                        self.next[at][byte] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        parent.append((at, byte, root))
                    at = self.next[at][byte]
                piece[at] = piece[at] or at > 1
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        if b"" in initial:
            self.fail[0], self.popped[0] = 1, 1
        order, level = [], [0, 1]
        while level:
            order += level
            level = [c for at in level for c in self.next[at].values()]
        for at in order:
            if at < 2:
                continue
            up, byte, _ = parent[at]
            if piece[at]:  # the whole path is one piece
                self.fail[at], self.popped[at] = 1, 1
                continue
            z, count = self.fail[up], self.popped[up]
            while z >= 0 and byte not in self.next[z]:
                if z == 1:  # at the root of continuations: nothing left to pop
                    z = -1
                    break
                count, z = count + self.popped[z], self.fail[z]
            if z >= 0:
                self.fail[at], self.popped[at] = self.next[z][byte], count

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; an uncovered word is one token."""
        if not word:
            return 0
        at, total = 0, 0
        follow, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while byte not in follow[at]:
                if fail[at] < 0:
                    return 1
                total += popped[at]
                at = fail[at]
            at = follow[at][byte]
        while at != 1:
            if fail[at] < 0:
                return 1
            total += popped[at]
            at = fail[at]
        return total


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """(initial, later) pieces of a byte-level vocabulary, where a leading space marks a word's start."""
    # fixed values: the printable stand-ins of bytes in byte-level vocabularies
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    raw = [bytes(stand[c] for c in p) for p in vocab if all(c in stand for c in p)]
    return [p[1:] for p in raw if p[:1] == b" "], [p for p in raw if p[:1] != b" "]


def automaton(path: str) -> Automaton:
    if path not in _ready:
        _ready[path] = Automaton(*pieces_of(path))
    return _ready[path]


def count_tokens(rows: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens", most: int = 400_000) -> DataFrame:
    """Adds n_words and ``name`` to the other columns of ``rows``; ``most`` words are remembered at once."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c not in (text, name, "n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = {}, automaton(tokenizer)
        for batch in batches:
            for lo, hi in tn.chunks(batch.column(text), 4 << 20):
                part = batch.slice(lo, hi - lo)
                raw, offsets = tn.buffers(part.column(text))
                starts, ends = tn.word_spans(raw, offsets, ~tn._OFF)
                hashes, first, of = np.unique(tn.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                data, each = raw.tobytes(), np.zeros(len(hashes), np.int64)
                if len(known) > most:
                    known.clear()
                for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
                    word = data[a:b]
                    n = known.get(word)
                    if n is None:
                        n = machine.count(word)
                        if len(word) <= 64:
                            known[word] = n
                    each[i] = n
                row = np.searchsorted(offsets, starts, "right") - 1
                words = np.bincount(row, minlength=len(part)).astype(np.int64)
                tokens = np.bincount(row, weights=each[of], minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(words), pa.array(tokens)], names=[*names, "n_words", name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, text).mapInArrow(run, f"{kinds}, n_words long, `{name}` long")
