"""Sum-of-squares online packing of documents into training sequences.

Every document's ids and a closing id 0 are cut into full windows and a remainder.  A remainder of ``s`` ids goes to
the fill level ``h`` (an open window of that level, or a new one at 0) that least increases the sum of squared counts
of open windows by level, kept in one array of ``window`` counters; ties take the fullest window.  Each input partition
packs its own documents in one pass, so nothing is shuffled, and a lost task is packed again in the same way.  When a
partition ends, its open windows are joined end to end and cut anew, which leaves one short sequence per partition.

Null and empty texts are one id (0).  Repeated ids are documents of their own.  Memory: one Arrow batch, the longest
document, and the open windows (few: the rule keeps their squared counts small).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TEXT, arrow_type, small_batches
from .tokens import encode, vocabulary_path

END_ID = 0

Piece = tuple  # (doc, start, ids, doc_tokens)


class SumOfSquares:
    """Open windows by fill level, with the pieces that they hold."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of 1..window ids; the pieces of the window if that fills it."""
        size, w, n = len(piece[2]), self.window, self.counts
        if size == w:
            return [piece]
        # change of the sum of squares for each level h in 0..w-size
        gain = 2 * (n[size : w + 1] - n[: w - size + 1]) + 2
        gain[0] = 2 * n[size] + 1
        gain[-1] = 1 - 2 * n[w - size]
        usable = n[: w - size + 1] > 0
        usable[0] = True
        gain[~usable] = np.iinfo(np.int64).max
        level = w - size - int(np.argmin(gain[::-1]))
        held = self.open[level].pop() if level else []
        n[level] -= level > 0
        held.append(piece)
        if level + size == w:
            return held
        n[level + size] += 1
        self.open[level + size].append(held)
        return None

    def finish(self) -> Iterator[list[Piece]]:
        """What is open, fullest first, joined and cut into windows; all but the last are full."""
        held: list[Piece] = []
        room = self.window
        for level in range(self.window, 0, -1):
            for doc, start, ids, total in (p for pieces in self.open[level] for p in pieces):
                while len(ids):
                    held.append((doc, start, ids[:room], total))
                    start, ids, room = start + len(held[-1][2]), ids[room:], room - len(held[-1][2])
                    if not room:
                        yield held
                        held, room = [], self.window
        if held:
            yield held


def packed(texts: Iterator[tuple[object, bytes]], window: int, path: str) -> Iterator[list[Piece]]:
    """The sequences, as lists of pieces, of (doc, text) pairs."""
    bins = SumOfSquares(window)
    for doc, text in texts:
        ids = np.append(encode(text.decode("utf-8", "replace"), path), np.uint32(END_ID)).astype(np.uint32)
        for start in range(0, len(ids), window):
            if full := bins.place((doc, start, ids[start : start + window], len(ids))):
                yield full
    yield from bins.finish()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column("doc"), batch.column(TEXT), strict=True):
            yield doc.as_py(), text.as_py()


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` (input partition in the upper bits) and ``offset`` there."""
    small_batches(docs.sparkSession)
    path = tokenizer or vocabulary_path()
    picked = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))
    kind = picked.schema["doc"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows = TaskContext.get().partitionId() << 40, []
        for number, pieces in enumerate(packed(_texts(batches), window, path)):
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, base + number, at))
                at += len(ids)
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return picked.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
