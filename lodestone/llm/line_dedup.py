"""Line deduplication with a pair of Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  One pass over the texts
sets a "once seen" and a "twice seen" filter; a second pass lets only keys of the twice-seen filter (suspected
repeats) into a shuffle, where their document counts are exact.  Both filters have a fixed number of bits (a
parameter): if the corpus outgrows them more keys are suspected, and the result stays exact.

Each input partition reports the sorted positions of its set bits by filter segment, and segments are merged where they
are (``filters.twice_seen``); the twice-seen filter (bits / 8 bytes, whatever the corpus) is broadcast.

Null and empty texts are one empty line.  Keys of fewer than ``min_chars`` code points are never dropped.  Repeated
rows are documents of their own, also where they share an id (``OP6_SQL`` counts ids).  A key counts once per document.  Output columns
win over kept ones of their name, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TEXT, cut, map_texts, small_batches
from .filters import has_bit, twice_seen

#: Keys that a task counts before it passes them on.
HELD = 200_000
#: Bytes that a broadcast key takes in a worker.
KEY_BYTES = 160
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    """128-bit digests of the distinct keys of one text that may be dropped."""
    return {xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in text.split(b"\n")} if _long_enough(k, min_chars)}


def _positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 128-bit digest."""
    mask = np.uint64(bits - 1)
    return np.concatenate((digests[:, 0] & mask, digests[:, 1] & mask)).astype(np.uint32)


def suspects_filter(docs: DataFrame, *, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """The packed twice-seen filter over the keys of all documents."""
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))

    def hashes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.frombuffer(b"".join(d for batch in batches for t in batch.column(TEXT) for d in _digests(t.as_py(), min_chars)), "V16")

    return twice_seen(source, hashes, lambda keys: _positions(np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2), bits), bits)


def _suspected(digests: list[bytes], packed: np.ndarray) -> list[bytes]:
    if not digests:
        return []
    pos = _positions(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), len(packed) * 8)
    hit = has_bit(packed, pos).reshape(2, -1).all(0)
    return [digests[i] for i in np.flatnonzero(hit)]


def hot_keys(docs: DataFrame, *, id_col: str, text_col: str, min_docs: int, min_chars: int, bits: int) -> tuple[DataFrame, object]:
    """(key, first): digests of the keys that at least ``min_docs`` documents have, with the smallest id; and the broadcast filter."""
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(suspects_filter(docs, text_col=text_col, min_chars=min_chars, bits=bits))
    source = _picked(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        first: dict[bytes, object] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([first[k] for k in seen], kind)], names=["key", "n", "first"])
            seen.clear()
            first.clear()
            return out

        for batch in batches:
            kind = batch.column("id").type
            for doc, t in zip(batch.column("id").to_pylist(), batch.column(TEXT), strict=True):
                for key in _suspected(list(_digests(t.as_py(), min_chars)), packed.value):
                    seen[key] += 1
                    old = first.get(key)
                    if old is None or doc is not None and doc < old:
                        first[key] = doc
            if len(seen) >= HELD:
                yield counted()
        if seen:
            yield counted()

    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("first", source.schema["id"].dataType)])
    counted = source.mapInArrow(count, schema).groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return cut(counted.where(F.col("n") >= min_docs).select("key", "first"), "hot-lines"), packed


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))


def drop_common_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Iterable[str] = ("doc_id",),
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    bits: int = 1 << 26,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Kept columns, ``text`` without the lines of common keys, ``n_lines`` and ``n_dropped``.

    A key is common if at least ``min_docs`` documents have it.  With ``keep_first`` the document of the smallest id
    keeps its first line of each common key.  The common keys are broadcast up to ``broadcast_bytes`` (at KEY_BYTES a key); more
    of them are joined to the suspected lines instead, and each document then carries only its own common keys.
    """
    spark = docs.sparkSession
    hot, packed = hot_keys(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, bits=bits)
    fields = [("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]

    def strip(text: bytes, common, doc: object) -> tuple[bytes, int, int]:
        """``common`` gives each common key's first document."""
        lines, out, used = text.split(b"\n"), [], set()
        for line in lines:
            key = line_key(line)
            if key and _long_enough(key, min_chars) and (d := xxhash.xxh3_128_digest(key)) in common:
                if not keep_first or d in used or common[d] != doc:
                    continue
                used.add(d)
            out.append(line)
        return b"\n".join(out), len(lines), len(lines) - len(out)

    def columns(rows: list[tuple[bytes, int, int]]) -> list:
        texts, n, dropped = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), list(n), list(dropped)]

    docs = docs.withColumn("__id", F.col(id_col))
    if hot.count() * KEY_BYTES <= broadcast_bytes:
        packed.destroy()
        common = spark.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in hot.toLocalIterator()})

        def apply(texts: list[bytes], batch: pa.RecordBatch) -> list:
            return columns([strip(t, common.value, doc) for t, doc in zip(texts, batch.column("__id").to_pylist(), strict=True)])

        return map_texts(docs, apply, fields, text_col=text_col, keep=[*keep, "__id"]).drop("__id")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, t in zip(batch.column("id").to_pylist(), batch.column(TEXT), strict=True):
                found = _suspected(list(_digests(t.as_py(), min_chars)), packed.value)
                ids += [doc] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(keys, pa.binary())], names=["id", "key"])

    picked = _picked(docs, id_col, text_col)
    pairs = picked.mapInArrow(suspects, T.StructType([picked.schema["id"], T.StructField("key", T.BinaryType())]))
    own = pairs.join(hot, "key").groupBy("id").agg(F.collect_list("key").alias("__keys"), F.collect_list("first").alias("__first"))  # one document's lines
    joined = docs.join(own.withColumnRenamed("id", "__own"), F.col("__id").eqNullSafe(F.col("__own")), "left")

    def apply_own(texts: list[bytes], batch: pa.RecordBatch) -> list:
        keys, first, ids = (batch.column(c).to_pylist() for c in ("__keys", "__first", "__id"))
        return columns([strip(t, dict(zip(k or (), f or (), strict=True)), doc) for t, k, f, doc in zip(texts, keys, first, ids, strict=True)])

    return map_texts(joined, apply_own, fields, text_col=text_col, keep=[*keep, "__id", "__keys", "__first"]).drop("__id", "__keys", "__first")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
