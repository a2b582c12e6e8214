"""Token counts: byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch of texts becomes one array of code points; class changes in it give the pre-tokens. Pre-tokens not
met before become one ragged array of byte symbols, and in each step every sequence merges all places of its
own lowest-ranked pair at once. What survives is counted (or returned as ids).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches

#: Code points handled at once; a longer text is a batch of its own.
SLICE_CHARS = 250_000
#: Slots of the pre-token cache and token ids that it may hold before it starts anew: both bound a worker's memory.
CACHE_SLOTS = 1 << 20
CACHE_IDS = 1 << 20
#: Longer pre-tokens are merged each time they occur.
CACHE_CHARS = 64

LETTER, NUMBER, SPACE, OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_NONE = np.iinfo(np.int32).max


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            a, b = ord(run[0][0]), ord(run[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in byte-level vocabularies, by their published rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _room(pool: np.ndarray, used: int, size: int) -> np.ndarray:
    """The pool with its first ``used`` entries and room for ``size``."""
    return pool if size <= len(pool) else np.concatenate([pool[:used], np.zeros(max(size, len(pool)), pool.dtype)])


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of two arrays, given by their beginnings and sizes (1 or more), are equal."""
    if not len(sizes):
        return np.zeros(0, bool)
    ramp = _ramp(sizes)
    same = a[np.repeat(at, sizes) + ramp] == b[np.repeat(bt, sizes) + ramp]
    return np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)


class ByteBPE:
    """A byte-level BPE vocabulary read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.made = made
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        self.power = np.ones(1, np.uint64)
        self.unpower = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.slot_key = np.zeros(CACHE_SLOTS, np.uint64)
        self.slot_at = np.zeros(CACHE_SLOTS, np.int32)
        self.slot_len = np.zeros(CACHE_SLOTS, np.int32)
        self.slot_text = np.zeros(CACHE_SLOTS, np.int32)
        self.slot_chars = np.zeros(CACHE_SLOTS, np.int32)
        self.texts = np.zeros(1 << 16, np.uint32)
        self.texts_size = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.pool_size = 0

    def _keep(self, ids: np.ndarray) -> int:
        """Adds ids to the pool and returns where they begin."""
        at, self.pool_size = self.pool_size, self.pool_size + len(ids)
        self.pool = _room(self.pool, at, self.pool_size)
        self.pool[at : self.pool_size] = ids
        return at

    def _remember(self, points: np.ndarray) -> int:
        """Adds code points to those of the cached pre-tokens and returns where they begin."""
        at, self.texts_size = self.texts_size, self.texts_size + len(points)
        self.texts = _room(self.texts, at, self.texts_size)
        self.texts[at : self.texts_size] = points
        return at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_owner, done_symbols = [], []
        while len(symbols):
            last = np.empty(len(owner), bool)
            last[-1], last[:-1] = True, owner[1:] != owner[:-1]
            pair = symbols << 32
            pair[:-1] |= symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            rank = np.where((self.pair_keys[at] == pair) & ~last, self.pair_ranks[at], _NONE)
            begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            lowest = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(owner)))
            if (lowest == _NONE).any():  # finished sequences leave
                ended = np.repeat(lowest == _NONE, lengths)
                done_owner.append(owner[ended])
                done_symbols.append(symbols[ended])
                owner, symbols, rank = owner[~ended], symbols[~ended], rank[~ended]
                lengths, lowest = lengths[lowest != _NONE], lowest[lowest != _NONE]
                if not len(owner):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # in a run of places such as "aaa" every second one merges
            breaks = np.concatenate([[True], np.diff(hit) != 1])
            run = np.flatnonzero(breaks)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            left = np.ones(len(owner), bool)
            left[hit + 1] = False
            owner, symbols = owner[left], symbols[left]
        if not done_owner:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        return symbols[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings; the text of each unit and whether it is such a string."""
        units, owner, special = [], [], []
        for i, text in enumerate(texts):
            parts = [text]
            for mark in self.specials:
                if mark in text:
                    parts = [y for x in parts for y in (_cut(x, mark) if x not in self.specials else [x])]
            for part in parts:
                if part:
                    units.append(part)
                    owner.append(i)
                    special.append(part in self.specials)
        return units, np.array(owner, np.int64), np.array(special, bool)

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, by the published pattern of this vocabulary.

        Runs of letters, of numbers and of other marks take one plain space before them along; a run of white
        space before something else leaves its last character; 's 't 're 've 'm 'll 'd stand alone.
        """
        kind = _classes()[points]
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        start = change.copy()
        at = np.flatnonzero(change & (kind != SPACE) & ~first)
        at = at[kind[at - 1] == SPACE]
        start[at[points[at - 1] == 32]] = False
        start[at - 1] = True
        at = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
        if len(at):
            n = len(points)
            one, after = points[at + 1], np.minimum(at + 2, n - 1)
            two = np.where((at + 2 < n) & ~first[after], points[after], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(short, 2, np.where(long, 3, 0))
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            end = at + size
            end = end[end < n]
            start[end] = True
        return start

    def _keys(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit key of each stretch, from prefix sums of a polynomial over the code points."""
        if len(self.power) < len(points):
            size = max(len(points), SLICE_CHARS)
            step, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.power, self.unpower = np.multiply.accumulate(step), np.multiply.accumulate(back)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.power[: len(points)], out=total[1:])
        key = (total[end] - total[begin]) * self.unpower[begin]
        key = (key ^ key >> np.uint64(29)) * np.uint64(_MIX) + (end - begin).astype(np.uint64)
        return (key ^ key >> np.uint64(32)) | np.uint64(1)  # never 0, the key of an empty slot

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each pre-token: the text it is from, where its ids are in the pool, how many, and the pool."""
        if self.pool_size > CACHE_IDS:
            self._forget()
        units, owner, special = self._units(texts)
        if not units:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, self.pool
        whole = "".join(units)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[begins] = True
        start = self._starts(points, first)
        if special.any():
            for i in np.flatnonzero(special):
                start[begins[i] + 1 : begins[i] + sizes[i]] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(points))
        key = self._keys(points, begin, end)
        slot = (key >> np.uint64(1)).astype(np.int64) & (CACHE_SLOTS - 1)
        chars = end - begin
        hit = (self.slot_key[slot] == key) & (chars <= CACHE_CHARS) & (self.slot_chars[slot] == chars)
        # a key only says where to look: the text itself decides
        sure = np.flatnonzero(hit)
        hit[sure] = _equal(self.texts, self.slot_text[slot[sure]].astype(np.int64), points, begin[sure], chars[sure])
        at, size = self.slot_at[slot].astype(np.int64), self.slot_len[slot].astype(np.int64)
        if not hit.all():
            single = chars > CACHE_CHARS
            miss = np.flatnonzero(~hit & ~single)
            _, where, back = np.unique(key[miss], return_index=True, return_inverse=True)
            like = miss[where][back]
            same = chars[miss] == chars[like]
            same[same] = _equal(points, begin[miss[same]], points, begin[like[same]], chars[miss[same]])
            single[miss[~same]] = True
            new = miss[where]
            if len(new):
                learned = self._learn([whole[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
                at[miss], size[miss] = (x[back] for x in learned)
                taken = self._remember(points[np.repeat(begin[new], chars[new]) + _ramp(chars[new])]) + np.cumsum(chars[new]) - chars[new]
                self.slot_key[slot[new]], self.slot_at[slot[new]], self.slot_len[slot[new]] = key[new], *learned
                self.slot_text[slot[new]], self.slot_chars[slot[new]] = taken, chars[new]
            for i in np.flatnonzero(single).tolist():  # taken singly: no key stands for them
                at[i : i + 1], size[i : i + 1] = self._learn([whole[begin[i] : end[i]]])
        unit = np.repeat(np.arange(len(units)), sizes)[begin]
        return owner[unit], at, size, self.pool

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of pre-tokens and special strings into the pool; where they begin and how many they are."""
        ids, counts = self.merge([word.encode() for word in words])
        if self.specials and any(word in self.specials for word in words):
            ends = np.cumsum(counts)
            parts = [np.array([self.specials[w]], np.int32) if w in self.specials else ids[e - c : e] for w, e, c in zip(words, ends, counts, strict=True)]
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return self._keep(ids) + np.cumsum(counts) - counts, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(texts):
            owner, _, size, _ = self._slice(texts[a:b])
            out[a:b] = np.bincount(owner, weights=size, minlength=b - a).astype(np.int64)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The token ids of each text."""
        for a, b in slices(texts):
            owner, at, size, pool = self._slice(texts[a:b])
            ids = pool[np.repeat(at, size) + _ramp(size)] if len(owner) else np.zeros(0, np.int32)
            each = np.bincount(owner, weights=size, minlength=b - a).astype(np.int64)
            ends = np.cumsum(each)
            for i in range(b - a):
                yield ids[ends[i] - each[i] : ends[i]]


def _cut(text: str, mark: str) -> list[str]:
    """The parts of a text, with the mark itself between them."""
    first, *rest = text.split(mark)
    return [first, *[y for x in rest for y in (mark, x)]]


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    a = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield a, i
            a, held = i, 0
        held += len(text)
    if a < len(texts):
        yield a, len(texts)


@functools.cache
def vocabulary(path: str) -> ByteBPE:
    """The vocabulary of a file, read once in each Python worker."""
    return ByteBPE(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text column by the vocabulary file at ``path``; null counts as the empty text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for texts in batches:
            yield pd.Series(bpe.counts(texts.tolist()))

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, UTF-8 bytes, tokens and whether they exceed ``limit``, one row for each row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; null ids, repeated rows and further columns are no matter;
    texts of any length are counted whole (in memory of about forty bytes a character of the longest one); an empty
    table gives an empty result. Special strings inside a text count as one token each.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
