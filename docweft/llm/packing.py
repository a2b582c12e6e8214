"""Sequence packing: concatenate all token streams and cut them at fixed windows.

First pass: every partition tokenises its documents and notes running offsets within itself. The partition
totals give prefix sums, hence global offsets. Second pass: each document is cut at the window bounds of the
one long stream; a boundary record tells where each piece lies. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.shared import bounded_batches, written
from docweft.llm.token_count import vocabulary
from docweft.llm.words import sliced

WINDOW = 1024
#: Ends each document.
END_ID = 0
#: Bytes of text tokenised for one output batch.
BATCH_CHARS = 500_000

_STREAM = "part int, doc_id long, at long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_streams(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit, ``end_id`` last) and its offset in its partition, written once."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = vocabulary(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in sliced(batch, most=BATCH_CHARS):
                ids = [np.append(x, end_id).astype("<u4") for x in bpe.encode(piece.column("text").to_pylist())]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), piece.column("doc_id"), pa.array(offsets), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "doc_id", "at", "doc_tokens", "ids"],
                )

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.mapInArrow(tokenise, _STREAM), "token-streams")


def cut(streams: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of every document of ``token_streams``, cut at the window bounds of the whole stream."""
    totals = streams.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row a partition of the first pass, so the window and the broadcast are over a few rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = streams.join(F.broadcast(bases), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("at")).alias("at"), "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = batch.column("at").to_numpy(), batch.column("doc_tokens").to_numpy()
            first = at // window
            count = (at + sizes - 1) // window - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(sequence * window, at[row]) - at[row]
            length = np.minimum((sequence + 1) * window, at[row] + sizes[row]) - at[row] - start
            views = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            checks = [zlib.crc32(views[r][4 * s : 4 * (s + n)]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, np.array(checks, np.int64), sizes[row], sequence, at[row] + start - sequence * window))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs all documents into sequences of ``window`` tokens and returns the boundary records.

    A null or empty text is the single ``end_id``. Null ids and repeated rows are packed like any other row,
    each in its own place; further columns are ignored; an empty table gives no piece. Only the last sequence
    is padded. Every id of a document lies in exactly one piece, and offsets in a sequence have no gaps.
    """
    return cut(token_streams(docs, path, end_id), window)
