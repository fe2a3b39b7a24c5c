"""Training-order materialisation of token ids.

Documents are tokenised and packed into sequences of one fixed stride (16-bit ids when the vocabulary allows).  Each sequence gets a
dense index (prefix sums over the counts per input partition, the only figures that the driver sees) and from it a
global slot: a keyed Feistel permutation over the next even power of two, walked along its cycle until the value falls below
the number of sequences.  The map is a bijection, needs no state, and any slot can be recomputed.  Rows are partitioned
by ranges of slots, one partition for each shard of ``shard_rows`` strides; a reader seeks to
``(slot % shard_rows) * stride`` of shard ``slot // shard_rows`` and can resume anywhere.

Null and empty texts are one id (0).  Document ids may be of any type, null included; rows that repeat an id are documents of their own, and
``doc_ids`` names an id once a sequence.  An empty table gives no sequences; columns other than id and text don't matter.
Which sequence has which slot follows from the input's partitions and the key alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TEXT, arrow_type, cut, mix, shared_dir, small_batches
from .packing import _texts, packed
from .tokens import vocabulary_path

ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [mix(np.array([(key + r * 0x9E3779B97F4A7C15) & (1 << 64) - 1], np.uint64)) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, tokenizer: str | None = None, id_bytes: int = 2) -> DataFrame:
    """Packed sequences: ``part``, ``local``, ``n_tokens``, ``doc_ids`` and ``ids`` (window * id_bytes bytes, padded with 0)."""
    small_batches(docs.sparkSession)
    path = tokenizer or vocabulary_path()
    kind = docs.schema[id_col].dataType
    most, stride = (1 << 8 * id_bytes) - 1, f"<u{id_bytes}"
    picked = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow_type(kind)), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "local", "n_tokens", "doc_ids", "ids"])

        for local, pieces in enumerate(packed(_texts(batches), window, path)):
            ids = np.concatenate([p[2] for p in pieces])
            if len(ids) and ids.max() > most:
                raise ValueError(f"an id of more than {id_bytes} bytes: pass id_bytes=4")
            padded = np.zeros(window, stride)
            padded[: len(ids)] = ids
            rows.append((part, local, len(ids), list(dict.fromkeys(p[0] for p in pieces)), padded.tobytes()))
            if len(rows) >= 1000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    fields = [("part", T.LongType()), ("local", T.LongType()), ("n_tokens", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("ids", T.BinaryType())]
    return picked.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def training_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, key: int = 20240229, shard_rows: int = 8192, tokenizer: str | None = None, id_bytes: int = 2) -> DataFrame:
    """``slot``, ``shard_id``, ``byte_offset``, ``n_tokens``, ``doc_ids``, ``ids``; in slot order, partition k being shard k."""
    spark = docs.sparkSession
    made = cut(sequences(docs, id_col=id_col, text_col=text_col, window=window, tokenizer=tokenizer, id_bytes=id_bytes), "sequences")
    counts = made.groupBy("part").agg(F.count("*").alias("n")).collect()  # one figure per input partition, 8 bytes each
    sizes = np.zeros(1 + max((r["part"] for r in counts), default=-1), np.int64)
    for r in counts:
        sizes[r["part"]] = r["n"]
    total, stride = int(sizes.sum()), id_bytes * window
    starts = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, local: pd.Series) -> pd.Series:
        return pd.Series(feistel(starts.value[part.to_numpy(np.int64)] + local.to_numpy(np.int64), total, key))

    placed = made.withColumn("slot", slot_of("part", "local")).withColumn("shard_id", F.expr(f"slot div {shard_rows}"))
    shards = max(1, -(-total // shard_rows))
    return (
        placed.repartitionById(shards, F.col("shard_id").cast("int"))
        .sortWithinPartitions("slot")
        .select("slot", "shard_id", ((F.col("slot") % shard_rows) * stride).alias("byte_offset"), "n_tokens", "doc_ids", "ids")
    )


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Write ``shard-XXXXXXXX.bin`` files below a folder that all executors reach (any pyarrow file system); the manifest.

    A shard is written under a temporary name and then moved, so a repeated or speculative task does no harm.
    Needs the rows of a shard in one partition and in slot order, as ``training_order`` gives them.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        store.create_dir(base, recursive=True)
        now, out, temp, rows, done = None, None, "", 0, []

        def close() -> None:
            out.close()
            if store.get_file_info(f"{base}/shard-{now:08d}.bin").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/shard-{now:08d}.bin")  # of an earlier try; some stores don't move onto a file
            store.move(temp, f"{base}/shard-{now:08d}.bin")
            done.append((now, rows))

        for batch in batches:
            for shard, ids in zip(batch.column("shard_id").to_pylist(), batch.column("ids"), strict=True):
                if shard != now:
                    if out:
                        close()
                    now, rows, temp = shard, 0, f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                out.write(ids.as_buffer())
                rows += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)], names=["shard_id", "n_rows"])

    return ordered.select("shard_id", "ids").mapInArrow(run, "shard_id long, n_rows long")


def read_slots(uri: str, begin: int, end: int, *, window: int = 1024, shard_rows: int = 8192, id_bytes: int = 2) -> Iterator[np.ndarray]:
    """Ids of the slots begin..end-1, read sequentially."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    slot, stride = begin, id_bytes * window
    while slot < end:
        shard, last = slot // shard_rows, min(end, (slot // shard_rows + 1) * shard_rows)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(slot % shard_rows * stride)
            for _ in range(slot, last):
                yield np.frombuffer(f.read(stride), f"<u{id_bytes}")
        slot = last


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest (shard_id, n_rows) of shard files written below the shared folder."""
    uri = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    return write_shards(training_order(spark.read.parquet(f"{sf_dir}/documents.parquet")), uri)
