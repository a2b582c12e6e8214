"""Words of whole texts as 64-bit hashes, for batches of texts at once, without a string object for each word.

A word is a run of letters and digits of the lower-cased text. Its hash is a polynomial over its UTF-8 bytes,
taken from prefix sums over the whole batch.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is a batch of its own.
SLICE_BYTES = 250_000

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * _MIX
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


@functools.cache
def _wordlike() -> np.ndarray:
    """For code points of up to three UTF-8 bytes: letter, mark or number."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x10000)])


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


@dataclass
class Words:
    """Words of a few texts: their bytes, where each word begins and ends, and where each text's words begin."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    _sums: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``most`` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.begin + most)
        unpower = _powers(_room(len(self.data)))[1]
        raw = (self._sums[end] - self._sums[self.begin]) * unpower[self.begin] + (end - self.begin).astype(np.uint64)
        return mix(raw)

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _room(size: int) -> int:
    return max(SLICE_BYTES, 1 << max(size, 1).bit_length())


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased UTF-8 text belong to words."""
    mask = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    if len(two):
        out = two[~_wordlike()[(data[two].astype(np.int32) & 0x1F) << 6 | data[two + 1] & 0x3F]]
        mask[out] = mask[out + 1] = False
    three = np.flatnonzero((data >= 0xE0) & (data <= 0xEF))
    if len(three):
        point = (data[three].astype(np.int32) & 0x0F) << 12 | (data[three + 1].astype(np.int32) & 0x3F) << 6 | data[three + 2] & 0x3F
        out = three[~_wordlike()[point]]
        mask[out] = mask[out + 1] = mask[out + 2] = False
    return mask


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the lower-cased texts (null: empty) and where each text begins, and the end."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def words(texts: pa.Array) -> Words:
    """The words of all texts of an Arrow string array."""
    data, offsets = lowered(texts)
    mask = word_mask(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    begin = np.flatnonzero(mask & (~before | first[:-1]))
    end = np.flatnonzero(mask & (~after | first[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_room(len(data)))[0][: len(data)], out=sums[1:])
    return Words(data, begin, end, np.searchsorted(begin, offsets), sums)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        held = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, held + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def word_hashes(text: str) -> np.ndarray:
    """The hashes of one text's words."""
    return words(pa.array([text], pa.string())).hashes()
