"""Token ids of a word-bounded BPE tokenizer, unit by unit.

The tokenizer lower-cases, drops white space and cuts a text into runs of letters,
single digits and runs of other characters, each encoded alone. So texts are cut
into units at white space and at ASCII borders between such runs; each distinct
unit is encoded once and its ids are found again through a hash table, all in
NumPy. Texts where this could differ (special tokens, rare controls, a letter
whose lower case has two characters) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm import textnum as tn

U = np.uint64
#: Fixed values. Texts with one of these are encoded whole.
ODD = r"<\||[\x00\x1c-\x1f\x{130}\x{180e}\x{200b}\x{feff}]"
#: Fixed values. White space beyond ASCII.
WIDE_SPACES = "\x85\xa0                　"
_MARK = "\x00"
_ready: dict[str, Words] = {}

#: Byte classes: 0 white space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 beyond ASCII, 5 apostrophe.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = [0 if c in tn.SPACES else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 5 if c == 39 else 3 for c in range(128)]
#: A unit ends between these classes: both sure, and apart for the tokenizer.
_CUT = np.zeros((6, 6), bool)
for _a in (1, 2, 3):
    for _b in (1, 2, 3):
        _CUT[_a, _b] = _a != _b or _a == 2
_BORDER = _CUT.copy()
_BORDER[0, 1:] = _BORDER[1:, 0] = True
_BORDER = _BORDER.ravel()


class Words:
    """Remembered ids of units: an open-addressed table of their hashes."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        suffix = model["end_of_word_suffix"]
        self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(model["vocab"].values()) + 2, bool)
        self.ends[[v for k, v in model["vocab"].items() if k.endswith(suffix)]] = True
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids[0]
        self.most = most
        self.slots = 1 << (2 * most - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(self.slots, U), np.zeros(self.slots, np.int32)
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes & U(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            seen = self.keys[slot]
            hit = seen == hashes[open_]
            out[open_[hit]] = self.place[slot[hit]]
            more = ~hit & (seen != 0)
            open_, slot = open_[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes & U(self.slots - 1)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.place[slot[put]] = hashes[put], numbers[put]
            rest = np.ones(len(hashes), bool)
            rest[put] = False
            hashes, numbers, slot = hashes[rest], numbers[rest], slot[rest]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & (self.slots - 1), slot)

    def learn(self, units: list[str], hashes: np.ndarray) -> None:
        plain = np.fromiter((u.isalpha() and (u.isascii() or unicodedata.is_normalized("NFC", u)) for u in units), bool, len(units))
        for simple in (True, False):
            at = np.flatnonzero(plain == simple)
            for lo in range(0, len(at), 2048):
                part = at[lo : lo + 2048]
                text = (" " if simple else f" {_MARK} ").join([units[i] for i in part])
                ids = np.array((self.bare if simple else self.tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)
                if simple:
                    lens = np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])])
                else:
                    lens = np.diff(np.r_[-1, np.flatnonzero(ids == self.mark), len(ids)]) - 1
                    ids = ids[ids != self.mark]
                if len(lens) != len(part):
                    raise AssertionError("units and ids do not match")
                self.add(hashes[part], ids, lens)

    def add(self, hashes: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        n, m = self.n, len(hashes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while n + m > len(self.start):
            self.start, self.length = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.length, np.zeros_like(self.length)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(lens) - lens
        self.length[n : n + m] = lens
        self.insert(hashes, np.arange(n, n + m, dtype=np.int32))
        self.used, self.n = self.used + len(ids), n + m

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        easy = pc.utf8_lower(easy)
        if pc.any(pc.match_substring_regex(easy, f"[{WIDE_SPACES}]")).as_py():
            easy = pc.replace_substring_regex(easy, f"[{WIDE_SPACES}]", " ")
        raw, offsets = tn.buffers(easy)
        starts, ends = _units(raw, offsets)
        hashes = tn.span_hashes(raw, starts, ends) | U(1)
        if self.n > self.most:
            self.forget()
        number = self.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            names, first = np.unique(hashes[new], return_index=True)
            if self.n + len(names) > self.slots * 3 // 4:
                self.forget()
                return self.encode(texts) if len(names) < self.slots // 2 else [self.whole(x) for x in texts.to_pylist()]
            at = new[first]
            data = raw.tobytes()
            self.learn([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], names)
            number = self.find(hashes)
        lens = self.length[number].astype(np.int64)
        flat = self.ids[tn.ragged(self.start[number], lens)]
        upto = np.r_[0, np.cumsum(lens)][np.searchsorted(starts, offsets, "left")]
        out = [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White-space words, cut at sure borders; words with an apostrophe stay whole."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    first = _BORDER[kind[:-1] * np.uint8(6) + kind[1:]]  # of the byte after
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    if (kind == 5).any():
        starts, ends = tn.word_spans(raw, offsets, ~tn._OFF)
        quoted = np.unique(np.searchsorted(starts, np.flatnonzero(kind == 5), "right") - 1)
        first[tn.ragged(starts[quoted], ends[quoted] - starts[quoted] - 1)] = False
    first[inner - 1] = True
    word = kind != 0
    return np.flatnonzero(np.r_[True, first] & word), np.flatnonzero(np.r_[first, True] & word) + 1


def encoder(path: str):
    """The encoding function of this process for a tokenizer file."""
    if path not in _ready:
        _ready[path] = Words(path)
    return _ready[path].encode


def verify(path: str, texts: list[str]) -> list[int]:
    """Places of the texts that differ from the tokenizer's own ids."""
    words = Words(path)
    return [i for i, (a, t) in enumerate(zip(words.encode(pa.array(texts, pa.string())), texts, strict=True)) if not np.array_equal(a, words.whole(t))]
