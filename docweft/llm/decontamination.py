"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some word positions of a window and ignore the rest, so a substituted word spoils only the
seeds that look at it. Seeds of the benchmark are joined with seeds of every document; each hit is then extended
along its diagonal and kept where enough of the words around it agree. A word inserted or left out ends a passage:
its parts on either side count by themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches
from docweft.llm.words import mix, sliced, word_hashes, words

#: Which positions of a window count. The first mask alone has a hit in every passage of 13 to 22 words with one word in five
#: replaced between its first and last, wherever these are (tests try all); a longer one holds such a passage.
MASKS = ("110101", "1001001001")
#: A passage has at least so many words in common with an item (or the whole item), this share of them equal.
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Shorter items say too little to be found in a text.
LEAST_ITEM = 3
#: Words of benchmark text that are sent to the executors at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 2_000_000
#: Seed hits looked at at once.
HITS = 200_000

_RESULT = "doc_id long, item_id long, words long, equal_words long, doc_word long, item_word long"


@dataclass
class Seeds:
    """Seeds of one mask over the benchmark block, sorted."""

    offsets: np.ndarray
    key: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray
    shift: np.uint64


def _offsets(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def _seed(hashes: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The seed at each beginning; positions that the mask ignores play no part."""
    total = np.zeros(len(begin), np.uint64)
    for k, offset in enumerate(offsets.tolist()):
        total += hashes[begin + offset] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mix(total)


def _places(bounds: np.ndarray, span: int) -> np.ndarray:
    """Where windows of ``span`` words begin that lie within one text."""
    room = np.maximum(np.diff(bounds) - span + 1, 0)
    ends = np.cumsum(room)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - room - bounds[:-1], room)


def item_masks(n: int, replaced: int) -> list[str]:
    """Masks over a whole item of ``n`` words of which one at least overlooks any ``replaced`` words.

    Positions are dealt to two classes more than that, in turn; each mask ignores ``replaced`` of the classes.
    """
    every = replaced + 2
    return ["".join("0" if i % every in left_out else "1" for i in range(n)) for left_out in itertools.combinations(range(every), replaced)]


def _spread(mask: str) -> np.ndarray:
    offsets = _offsets(mask)
    return offsets if len(offsets) else np.zeros(1, np.int64)


def seed_tables(items: list[np.ndarray], masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, share: float = MIN_SHARE) -> list[Seeds]:
    """The seeds of benchmark items given as word hashes; items under ``min_words`` words have masks for their length."""
    rows: dict[tuple[int, str], list[int]] = {(0, m): [i for i, x in enumerate(items) if len(x) >= max(min_words, len(m))] for m in masks}
    for n in range(LEAST_ITEM, max(min_words, *map(len, masks))):
        if short := [i for i, x in enumerate(items) if len(x) == n]:
            rows |= {(n, m): short for m in item_masks(n, int((1 - share) * n + 1e-9))}
    tables = []
    for (whole, mask), chosen in rows.items():
        if not chosen:
            continue
        bounds = np.cumsum([0, *(len(items[i]) for i in chosen)])
        begin = bounds[:-1] if whole else _places(bounds, len(mask))
        key = _seed(np.concatenate([items[i] for i in chosen]), begin, _spread(mask))
        owner = np.searchsorted(bounds, begin, side="right") - 1
        order = np.argsort(key, kind="stable")
        bits = min(24, max(10, (64 * len(key)).bit_length()))
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[(key >> shift).astype(np.int64)] = True
        tables.append(Seeds(_spread(mask), key[order], np.array(chosen)[owner][order], (begin - bounds[owner])[order], seen, shift))
    return tables


def best_passage(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """The longest stretch with at least ``share`` of its words equal: where it begins, its length, its equal words."""
    if not equal.any():
        return 0, 0, 0
    # in hundredths, so that sums are exact
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100, 0) - round(100 * share))])
    low = np.minimum.accumulate(total)
    # for each end, the first beginning whose sum is no higher; the running minimum falls, so it can be searched
    first = np.searchsorted(-low, -total, side="left")
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    begin = int(first[end])
    at = np.flatnonzero(equal[begin:end])
    if not len(at):
        return 0, 0, 0
    begin, end = begin + int(at[0]), begin + int(at[-1]) + 1
    return begin, end - begin, len(at)


class Index:
    """Benchmark items by their seeds."""

    def __init__(self, items: list[np.ndarray], masks: tuple[str, ...], min_words: int, share: float):
        self.items, self.min_words, self.share = items, min_words, share
        self.tables = seed_tables(items, masks, min_words, share)
        self.words = np.concatenate([np.zeros(0, np.uint64), *items])
        self.bounds = np.cumsum([0, *map(len, items)])

    def _promising(self, hashes: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
        """Which hits have enough equal words around them to be part of a passage."""
        low, high = bounds[text], bounds[text + 1]
        first, last = self.bounds[item], self.bounds[item + 1]
        equal = np.zeros(len(place), np.int64)
        for step in range(1 - self.min_words, span + self.min_words):
            x, y = place + step, first + at + step
            inside = (x >= low) & (x < high) & (y >= first) & (y < last)
            equal += inside & (hashes[np.where(inside, x, 0)] == self.words[np.where(inside, y, 0)])
        # a passage has a stretch around some seed with that share, and replaced words may be crowded in it
        return equal >= 0.9 * self.share * np.minimum(self.min_words, last - first) - 1e-9

    def _hits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of promising seed hits; a bounded number of hits is held at once."""
        found = [np.zeros((3, 0), np.int64)]
        for table in self.tables:
            span = int(table.offsets[-1]) + 1
            begin = _places(bounds, span)
            if not len(begin):
                continue
            key = _seed(hashes, begin, table.offsets)
            near = table.seen[(key >> table.shift).astype(np.int64)]
            begin, key = begin[near], key[near]
            low, high = np.searchsorted(table.key, key, "left"), np.searchsorted(table.key, key, "right")
            size = high - low
            begin, low, size = begin[size > 0], low[size > 0], size[size > 0]
            ends = np.cumsum(size)
            for a in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                number = np.arange(a, min(a + HITS, int(ends[-1])))
                row = np.searchsorted(ends, number, side="right")
                entry = low[row] + number - (ends - size)[row]
                place, item, at = begin[row], table.item[entry], table.at[entry]
                text = np.searchsorted(bounds, place, side="right") - 1
                good = self._promising(hashes, bounds, text, item, place, at, span)
                found.append(np.unique(np.stack([text, item, place - bounds[text] - at])[:, good], axis=1))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def passages(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """For each text and item with a passage in common, the longest: text, item, words, equal words, where in both."""
        best: dict[tuple[int, int], tuple] = {}
        for text, item, diagonal in self._hits(hashes, bounds).T.tolist():
            own, other = hashes[bounds[text] : bounds[text + 1]], self.items[item]
            a, b = max(0, diagonal), min(len(own), diagonal + len(other))
            equal = own[a:b] == other[a - diagonal : b - diagonal]
            if len(other) < self.min_words:  # a short item counts as a whole, its first and last words too
                at, length, n = 0, len(equal), int(equal.sum())
                if length < len(other) or n < self.share * length - 1e-9:
                    continue
            else:
                at, length, n = best_passage(equal, self.share)
            if length >= min(self.min_words, len(other)) and (length, n) > best.get((text, item), (0, 0))[:2]:
                best[text, item] = (length, n, a + at, a - diagonal + at)
        return [(*k, *v) for k, v in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items with a text in blocks of about ``block_words`` words; the size is measured."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    size = asked.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [asked.filter(block == b).orderBy("item_id", "text") for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every pair of a document and a benchmark item with a passage in common, with the longest such passage.

    ``words`` and ``equal_words`` size the passage; ``doc_word`` and ``item_word`` tell where it begins in both.
    Whole texts are searched, long ones too. A benchmark of at most ``block_words`` words (its size is measured)
    goes to the executors as one table of seeds, a larger one in several blocks, each a pass over the documents.

    Null or empty texts and items match nothing, nor do items under ``LEAST_ITEM`` words. Items under ``min_words``
    words match as a whole, with the same share of equal words. Repeated rows give repeated pairs; equally long
    passages: the one with more equal words, then the first. Null ids are kept; an empty table on either side gives
    no rows; further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_search(texts, asked, masks, min_words, min_share) for asked in _blocks(benchmark, block_words)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _sent(asked: DataFrame, masks: tuple[str, ...], min_words: int, share: float) -> Callable[[], tuple[Index, np.ndarray, np.ndarray]]:
    """Items of one block (a bounded number of words) for the executors: their index, ids and which ids are known."""
    bounded_batches(asked.sparkSession)
    rows = asked.toArrow().to_pylist()
    items = [word_hashes(r["text"]) for r in rows]
    names = np.array([-1 if r["item_id"] is None else r["item_id"] for r in rows], np.int64)
    known = np.array([r["item_id"] is not None for r in rows], bool)
    sent = asked.sparkSession.sparkContext.broadcast((items, names, known))

    def received() -> tuple[Index, np.ndarray, np.ndarray]:
        items, names, known = sent.value
        return Index(items, masks, min_words, share), names, known

    return received


def _search(texts: DataFrame, asked: DataFrame, masks: tuple[str, ...], min_words: int, share: float) -> DataFrame:
    """``contaminated`` for one block."""
    received = _sent(asked, masks, min_words, share)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, known = received()
        for batch in batches:
            for part in sliced(batch):
                held = words(part.column("text"))
                if found := index.passages(held.hashes(), held.bounds):
                    text, item, *rest = map(np.array, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(text)), pa.array(names[item], mask=~known[item]), *(pa.array(x.astype(np.int64)) for x in rest)],
                        names=["doc_id", "item_id", "words", "equal_words", "doc_word", "item_word"],
                    )

    return texts.mapInArrow(search, _RESULT)


def has_passage(text: Column, asked: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, share: float = MIN_SHARE) -> Column:
    """Whether a text holds a passage of an item of one block; false for null."""
    received = _sent(asked, masks, min_words, share)

    @F.arrow_udf("boolean")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = received()[0]
        for batch in batches:
            out = np.zeros(len(batch), bool)
            at = 0
            for part in sliced(pa.RecordBatch.from_arrays([batch], names=["text"])):
                held = words(part.column("text"))
                for text, *_ in index.passages(held.hashes(), held.bounds):
                    out[at + text] = True
                at += part.num_rows
            yield pa.array(out)

    return search(text)


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows without a passage of a benchmark item, with all their columns.

    Each row is judged by its own text: ids, null or shared, play no part, and nothing is shuffled. Otherwise as
    ``contaminated``.
    """
    for asked in _blocks(benchmark, block_words):
        docs = docs.filter(~has_passage(F.col("text"), asked, masks, min_words, min_share))
    return docs
