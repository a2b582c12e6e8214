"""Fill-in-the-middle transformation with a piece table.

A document becomes descriptors (buffer, start, length) over two buffers that never change: its UTF-8 text and the
sentinels. Cutting splits a descriptor, an arrangement permutes them, the inverse permutation restores the text, and
hashes stream the bytes that descriptors name. No text is copied until an output is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches
from docweft.llm.words import sliced

#: Sentinels before prefix, suffix and middle; they stand one after another in the sentinel buffer.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts in the output of each form.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLAIN = "plain"
#: Documents in a hundred that are transformed, and of these the ones in form spm.
TRANSFORMED, SPM = 90, 20
SEED = 1
#: Bytes searched at once for the place of a unit.
BLOCK = 1 << 16
#: Bytes of text handled for one output batch.
BATCH_BYTES = 1_000_000

TEXT, MARKS = 0, 1
_MARKS = b"".join(SENTINELS.values())


class Piece(NamedTuple):
    """A descriptor: ``length`` bytes of a buffer from ``start`` on."""

    buffer: int
    start: int
    length: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` bytes and the rest."""
        return Piece(self.buffer, self.start, at), Piece(self.buffer, self.start + at, self.length - at)


def _mark(part: str) -> Piece:
    return Piece(MARKS, _MARKS.index(SENTINELS[part]), len(SENTINELS[part]))


def unit_starts(text: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text begin a unit: a run of ASCII letters, or any other code point by itself."""
    letter = ((text | 0x20) >= 97) & ((text | 0x20) <= 122)
    starts = (text & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def place(starts: np.ndarray, units: int) -> int:
    """The byte where the unit number ``units`` (from 0) begins; after the last unit, the length of the text."""
    counts = np.cumsum(np.add.reduceat(starts, np.arange(0, len(starts), BLOCK), dtype=np.int64)) if len(starts) else np.zeros(0, np.int64)
    block = int(np.searchsorted(counts, units, side="right"))
    if block == len(counts):
        return len(starts)
    before = int(counts[block - 1]) if block else 0
    return block * BLOCK + int(np.flatnonzero(starts[block * BLOCK : (block + 1) * BLOCK])[units - before])


def chosen(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers that depend on seed and id only; a null id counts as the empty string."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(found[:8], 16), int(found[8:16], 16), int(found[16:24], 16), int(found[24:32], 16)


def arranged(parts: dict[str, Piece], form: str) -> list[Piece]:
    """The descriptors of the output: each part behind its sentinel, in the order of the form."""
    return [piece for part in FORMS[form] for piece in (_mark(part), parts[part])]


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that give the text again: the parts found between its sentinels, in text order.

    Parts never contain a sentinel, and no sentinel can begin in a part and end in another sentinel.
    """
    whole = Piece(TEXT, 0, len(output))
    if form == PLAIN:
        return [whole]
    at = [output.index(SENTINELS[FORMS[form][0]])]
    for part in FORMS[form][1:]:
        at.append(output.index(SENTINELS[part], at[-1]))
    ends = [*at[1:], len(output)]
    parts = {part: Piece(TEXT, a + len(SENTINELS[part]), b - a - len(SENTINELS[part])) for part, a, b in zip(FORMS[form], at, ends, strict=True)}
    return [parts["prefix"], parts["middle"], parts["suffix"]]


def streamed(pieces: list[Piece], text: memoryview | bytes) -> Iterator[memoryview]:
    """The bytes that descriptors name, piece by piece and uncopied."""
    buffers = memoryview(text), memoryview(_MARKS)
    for p in pieces:
        yield buffers[p.buffer][p.start : p.start + p.length]


def digest(pieces: list[Piece], text: memoryview | bytes) -> str:
    found = hashlib.sha256()
    for part in streamed(pieces, text):
        found.update(part)
    return found.hexdigest()


class Transformed(NamedTuple):
    """A document's number of units, form, code points of prefix and middle (none if plain) and descriptors."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[Piece]


def transformed(doc_id: int | None, text: memoryview | bytes, seed: int = SEED) -> Transformed:
    """The descriptors of one document, whose text is UTF-8."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n, (h1, h2, h3, h4) = int(np.count_nonzero(starts)), chosen(doc_id, seed)
    whole = Piece(TEXT, 0, len(data))
    held = bytes(text)
    if not len(data) or h3 % 100 >= TRANSFORMED or any(mark in held for mark in SENTINELS.values()):
        return Transformed(n, PLAIN, None, None, [whole])
    form = "spm" if h4 % 100 < SPM else "psm"
    low, high = sorted((place(starts, h1 % (n + 1)), place(starts, h2 % (n + 1))))
    prefix, rest = whole.cut(low)
    middle, suffix = rest.cut(high - low)
    points = (data[:high] & 0xC0) != 0x80
    counts = int(np.count_nonzero(points[:low])), int(np.count_nonzero(points[low:]))
    return Transformed(n, form, *counts, arranged({"prefix": prefix, "middle": middle, "suffix": suffix}, form))


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_PIECES = "pieces array<struct<buffer: int, start: long, length: long>>, output string"


def transform(docs: DataFrame, seed: int = SEED, outputs: bool = True) -> DataFrame:
    """Every document in fill-in-the-middle form, one row for each row.

    ``pieces`` are the descriptors of the output (buffer 0: the UTF-8 text, 1: the sentinels ``<P><S><M>``), ``output``
    is the text they give; without ``outputs`` both are left out and only their digests leave the Python workers.
    ``restored_sha256`` is that of the text rebuilt from output and form alone.

    Null texts are empty. Empty texts and texts that hold a sentinel stay plain, and so do a tenth of the others, by
    the id. A null id counts as the empty string; rows with one id are cut alike, as far as their lengths agree;
    repeated rows give repeated results. Texts of any length are read whole, in memory of a few bytes a byte of the
    text. Further columns are ignored, whatever their names; an empty table gives an empty result.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if outputs:
        kinds += [pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "pieces", "output"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, most=BATCH_BYTES):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    data = memoryview(text.as_buffer())
                    made = transformed(doc_id, data, seed)
                    output = b"".join(streamed(made.pieces, data))
                    row = [doc_id, *made[:4], digest(made.pieces, data), digest(restored(output, made.form), output)]
                    rows.append(row + [[p._asdict() for p in made.pieces], output.decode()] * outputs)
                columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"{_RESULT}, {_PIECES}" if outputs else _RESULT)


ORACLE_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), hashed AS (
    SELECT doc_id, text, units, len(units) AS n,
           list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(string_split(h[i:i + 7], ''), lambda c: strpos('0123456789abcdef', c)::BIGINT - 1), lambda a, b: a * 16 + b)) AS h
    FROM cut
), chosen AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
           array_to_string(units[high + 1:], '') AS suffix
    FROM chosen
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
