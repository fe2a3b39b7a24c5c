"""Shared plumbing: durable intermediate tables, whole-text Arrow maps and vectorised word hashing.

Conventions of every operator in this subpackage:

* a null text counts as the empty text, unless the operator says otherwise;
* only the id, the text and the columns named in ``keep`` travel with a document.  Where an output column has the
  name of a kept column, the output wins;
* intermediate results that are read more than once are written as Parquet below ``spark.checkpoint.dir`` (shared by
  driver and executors), so that a lost executor costs a re-read and not the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__text"
#: Texts are handed to vectorised code in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold BATCH_ROWS rows, unless the session sets their size itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    small_batches(spark)
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _store(spark, top)[0].deleteOnExit(_store(spark, top)[1])  # with the session
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _store(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for tables that nothing reads any more."""
    for t in tables:
        store, at = _store(t.sparkSession, t._cut)
        store.delete(at, True)


def map_texts(
    docs: DataFrame,
    fn: Callable[[list[bytes], pa.RecordBatch], list],
    fields: list[tuple[str, T.DataType]],
    *,
    text_col: str = "text",
    keep: Iterable[str] = ("doc_id",),
) -> DataFrame:
    """Kept columns plus the columns that ``fn(texts, kept_batch)`` makes, one value per document.

    ``texts`` are UTF-8 bytes (null: empty), in slices of about SLICE_BYTES.
    """
    small_batches(docs.sparkSession)
    names = [n for n, _ in fields]
    kept = [c for c in dict.fromkeys(keep) if c not in names]
    picked = docs.select(*kept, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))
    schema = T.StructType([picked.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(TEXT).to_pylist()
            outer = part.select(kept)
            made = fn(texts, outer)
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, arrow_type(t)) for a, (_, t) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*outer.columns, *arrays], names=[*kept, *names])

    return picked.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = TEXT) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text."""
    for batch in batches:
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


# ---------------------------------------------------------------- words and hashes

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the rolling hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.ones(n, np.uint64)
            step, size = base, 1
            while size < n:
                out[size : 2 * size] = out[:size] * np.uint64(step)
                step, size = step * step & M64, 2 * size
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[j] - p[i]) * inverse_power[i]`` as the hash of ``data[i:j]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts.

    ``start`` and ``end`` are byte positions in ``data`` (the texts with a line feed between), ``doc`` the text's
    number, ``first`` the index of each text's first word (with one more entry at the end), ``hash`` 64-bit hashes.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, hashed: bool = True):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = joined
        self.data = LOWER[joined] if lower else joined
        space = SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(joined) and not space[0]:
            edge = np.concatenate((np.zeros(1, edge.dtype), edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, self.offset)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashed:
            p, inverse = prefix_hash(self.data), powers(len(joined) + 1)[1]
            self.hash = mix((p[self.end] - p[self.start]) * inverse[self.start])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every n-word shingle; a text of 1..n-1 words has one of all its words."""
        h, doc = self.hash, self.doc
        if not len(h):
            return h, doc
        full = len(h) - n + 1
        if full > 0:
            out = np.zeros(full, np.uint64)
            for k in range(n):
                out = mix(out + h[k : full + k] + np.uint64(k + 1))
            whole = doc[:full] == doc[n - 1 :]
            out, owner = out[whole], doc[:full][whole]
        else:
            out, owner = h[:0], doc[:0]
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                has = self.counts[short] > k
                extra[has] = mix(extra[has] + h[self.first[short[has]] + k] + np.uint64(k + 1))
            # the word count is part of the hash, so that no short sequence equals a full shingle
            extra = mix(extra ^ (self.counts[short].astype(np.uint64) << np.uint64(40)))
            out, owner = np.concatenate((out, extra)), np.concatenate((owner, short))
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
        return out, owner


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (text, hash), and the index at which each text's begin (and one past)."""
    h, owner = Words(texts).shingles(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def sibling(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
