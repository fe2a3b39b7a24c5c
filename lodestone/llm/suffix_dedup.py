"""Exact removal of repeated byte strings, by suffix arrays over anchored contexts.

Contract: with ``length`` = 100, every byte goes that a string of 100 bytes covers which also starts earlier - in a document of a smaller
id, or earlier in the same one.  Strings are judged on the input, never cross documents, and may overlap.

Anchors.  Each window of 100 bytes has an anchor: of its strings of ``k`` = 52 bytes the one with the least hash, the
leftmost on ties.  Equal windows have the same anchor at the same place, so all repeats of a window meet at the anchor's
hash.  An anchor's context is what its windows cover: up to 48 bytes to its left and 48 to its right.  Only anchors
that a twice-seen filter suspects of repeating leave the scan.

Copies.  Anchors of equal contexts are counted by hash (64 bits of the anchor and 64 of its context stand for their bytes); all
but the one of the smallest document (and, within a document, all but the first) repeat in every window.  This settles whole copies
and the inside of repeated passages.

Suffix arrays.  What is left are anchors with several different contexts, one representative each: the ends of repeated
passages and the places where near copies differ.  A task takes whole groups of such contexts and writes their bytes as one
text: what precedes the anchor, one symbol for the anchor (its group's), what follows, an end mark.  A window of 100 bytes is a
string of 49 symbols of that text.  Its suffix array, by linear grouping (``suffix_array``), brings equal windows together
wherever they are; neighbours are compared symbol by symbol, and all but the first of each class of equal windows repeat.

Hot groups.  An anchor with more than ``hot`` contexts (one common passage in many documents) is dealt into ranges of window
places, of lengths 2, 2, 4, 8, ... from both ends, and in each range by the bytes that its windows share; equal
shortened contexts are counted by hash as above.  A range that still has more than ``hot`` different ones is dealt by single window
places, where equal keys are equal windows and counting settles the rest.  So a suffix array's group has at most ``hot`` contexts
of 148 bytes, however many documents share a passage.

Null texts are empty; texts of fewer than 100 bytes lose nothing.  Ids may be of any type with an order, and a null id counts as the
smallest.  Rows that repeat an id are one document and get equal results.  An empty table gives no rows; columns other than id and text
don't matter.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TEXT, cut, mix, powers, prefix_hash, slices, small_batches
from .filters import bit_set, has_bit, twice_seen
from .suffix_array import suffix_array

LENGTH = 100
K = 52
SIDE = LENGTH - K  # bytes of context at either side, a multiple of 8
HOT = 1000
CHUNK = 2000  # contexts, and what the last group adds, in one suffix array
BITS = 1 << 28


class Anchors:
    """The anchors of several texts: ``row`` (the text), ``p`` (byte place there), window places ``least`` to ``most``
    (bytes of a window before its anchor), and hashes of the anchor and of its whole context."""

    def __init__(self, texts: list[bytes]):
        long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
        self.data = data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
        self.offset = offset = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(texts[i]) for i in long], dtype=np.int64)))
        if not long:
            none = np.zeros(0, np.int64)
            self.row = self.at = self.p = self.least = self.most = none
            self.anchor = self.context = none.view(np.uint64)
            return
        sums, inverse = prefix_hash(data), powers(len(data) + 1)[1]
        n = len(data) - K + 1
        h = mix((sums[K:] - sums[:-K]) * inverse[:n])
        bits = max(24, int(n).bit_length())
        low = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        width, step = SIDE + 1, 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        at = (low & np.uint64((1 << bits) - 1)).astype(np.int64)  # of the window that starts at each byte
        start = np.arange(len(at))
        doc = np.repeat(np.arange(len(long)), np.diff(offset))[: len(at)]
        inside = start + LENGTH <= offset[doc + 1]
        start, at, doc = start[inside], at[inside], doc[inside]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
        lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
        self.at, doc = at[new], doc[new]
        self.row = np.array(long)[doc]
        self.p = self.at - offset[doc]
        self.least, self.most = self.at - hi, self.at - lo
        self.anchor = h[self.at]
        self.context = mix((sums[hi + LENGTH] - sums[lo]) * inverse[lo]) ^ mix((self.most * 256 + self.least + 1).astype(np.uint64))

    def packed(self) -> np.ndarray:
        return self.p << 16 | self.least << 8 | self.most

    def sides(self, keep: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Left sides, read outwards, and right sides of some anchors."""
        raw = self.data
        left = [raw[a - m : a][::-1].tobytes() for a, m in zip(self.at[keep].tolist(), self.most[keep].tolist(), strict=True)]
        right = [raw[a + K : a + LENGTH - m].tobytes() for a, m in zip(self.at[keep].tolist(), self.least[keep].tolist(), strict=True)]
        return left, right


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each context the window places, as bits, whose window an earlier one (by ``rank``) of its group has too."""
    m = len(group)
    out = np.zeros(m, np.int64)
    if not m:
        return out
    # places at which no other context of the group can have the same window are left out, and so are the bytes for them alone
    least = np.maximum(least, SIDE - _shared(group, right))
    most = np.minimum(most, _shared(group, left))
    use = np.flatnonzero(least <= most)
    if len(use) < m:
        out[use] = repeated(group[use], [left[k] for k in use], [right[k] for k in use], least[use], most[use], rank[use])
        return out
    left = [x[:k] for x, k in zip(left, most.tolist(), strict=True)]
    right = [x[: SIDE - k] for x, k in zip(right, least.tolist(), strict=True)]
    names = np.unique(group, return_inverse=True)[1]
    before, after = (np.fromiter(map(len, side), np.int64, m) for side in (left, right))
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(before + after + 2)))
    text = np.zeros(begin[-1], np.int32)  # 0: the end mark; 1 .. 256: bytes; beyond: anchors
    anchor = begin[:-1] + before
    _fill(text, begin[:-1], before, b"".join(x[::-1] for x in left))
    text[anchor] = 257 + names
    _fill(text, anchor + 1, after, b"".join(right))
    # the windows: of each context one for every place, the bytes before the anchor in it
    counts = most - least + 1
    owner = np.repeat(np.arange(m), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + least[owner]
    at = np.full(len(text), -1, np.int64)
    at[anchor[owner] - place] = np.arange(len(owner))
    order = at[suffix_array(text)]
    order = order[order >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, SIDE + 1)
    start = (anchor[owner] - place)[order]
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 16):
        to = min(len(order), k + (1 << 16))
        new[k:to] = (windows[start[k:to]] != windows[start[k - 1 : to - 1]]).any(1)
    kind = np.cumsum(new) - 1
    first = np.full(int(kind[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, kind, rank[owner[order]])
    again = rank[owner[order]] != first[kind]
    np.bitwise_or.at(out, owner[order][again], np.int64(1) << place[order][again])
    return out


def _shared(group: np.ndarray, side: list[bytes]) -> np.ndarray:
    """At least as many bytes of each side as another one of its group begins with (and fewer than 8 more)."""
    blocks = np.frombuffer(b"".join(x.ljust(SIDE, b"\0") for x in side), ">u8").reshape(len(side), -1).astype(np.uint64)
    h, out, alike = mix(group.view(np.uint64)), np.full(len(side), 7), np.ones(len(side), bool)
    for k in range(blocks.shape[1]):
        h = mix(h ^ mix(blocks[:, k] + np.uint64(k + 1)))
        _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        alike = alike & (counts[which] > 1)
        out[alike] = 8 * k + 15
    return np.minimum(out, SIDE)


def _fill(text: np.ndarray, begin: np.ndarray, size: np.ndarray, data: bytes) -> None:
    """Write ``data``, cut into pieces of ``size``, at the places ``begin``."""
    end = np.cumsum(size)
    text[np.arange(len(data)) + np.repeat(begin - (end - size), size)] = np.frombuffer(data, np.uint8).astype(np.int32) + 1


MARK = "doc long, p long, mask long"


def _marks(rows: DataFrame) -> DataFrame:
    """All windows of the anchors (doc, pos)."""
    return rows.selectExpr("doc", "shiftright(pos, 16) AS p", "shiftleft(1L, cast((pos & 255) + 1 AS int)) - shiftleft(1L, cast((shiftright(pos, 8) & 255) AS int)) AS mask")


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Marks of contexts (gkey, doc, p, least, most, left, right), by suffix arrays over whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table["gkey"].to_numpy()
                end = int(np.searchsorted(keys == keys[-1], True))  # the last group may go on
                if end:
                    yield judged(table.slice(0, end))
                    held = table.slice(end).to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    def judged(table: pa.Table) -> pa.RecordBatch:
        group, doc, p = (table[c].to_numpy() for c in ("gkey", "doc", "p"))
        order = np.lexsort((p, doc, group))
        again = (group[order[1:]] == group[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
        if again.any():  # rows that repeat an id
            table = table.take(pa.array(np.sort(order[np.concatenate(([True], ~again))])))
        group, doc, p, least, most = (table[c].to_numpy() for c in ("gkey", "doc", "p", "least", "most"))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((p, doc))] = np.arange(len(doc))
        mask = repeated(group, table["left"].to_pylist(), table["right"].to_pylist(), least, most, rank)
        hit = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, p, mask)], names=["doc", "p", "mask"])

    return rows.select("gkey", "doc", "p", "least", "most", "left", "right").repartition("gkey").sortWithinPartitions("gkey").mapInArrow(run, MARK)


def _ranges() -> list[tuple[int, int]]:
    """Window places 0..SIDE in ranges that double from both ends to the middle."""
    half, cuts, size = SIDE // 2, [0], 2
    while cuts[-1] + size < half:
        cuts.append(cuts[-1] + size)
        size = cuts[-1]
    low = [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], half + 1], strict=True)]
    return low + [(SIDE - b, SIDE - a) for a, b in reversed([(a, min(b, half - 1)) for a, b in low])]


def _dealt(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of hot groups: the marks of shortened contexts that repeat, and one row for each different one."""
    ranges = F.array(*(F.struct(F.lit(a).alias("j0"), F.lit(b).alias("j1")) for a, b in _ranges()))
    rows = hot.withColumn("r", F.explode(ranges)).withColumn("least", F.expr("greatest(least, r.j0)")).withColumn("most", F.expr("least(most, r.j1)")).where("least <= most")
    rows = rows.selectExpr(
        "xxhash64(kmer, r.j0, substring(left, 1, r.j0), substring(right, 1, %d - r.j1)) AS gkey" % SIDE, "doc", "p", "least", "most",
        "substring(left, 1, cast(most AS int)) AS left", "substring(right, 1, cast(%d - least AS int)) AS right" % SIDE,
    )
    rows = cut(rows.withColumn("short", F.xxhash64("left", "right", "least", "most")), "ranges")
    first = cut(rows.groupBy("gkey", "short").agg(F.min(F.struct("doc", "p")).alias("first")), "first")
    rows = rows.join(first, ["gkey", "short"])
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("p") == F.col("first.p"))
    rest = rows.where(~is_first).selectExpr("doc", "p", "shiftleft(1L, cast(most AS int) + 1) - shiftleft(1L, cast(least AS int)) AS mask")
    return rest, cut(rows.where(is_first).select("gkey", "doc", "p", "least", "most", "left", "right"), "different")


def _placed(different: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Of groups that still have more than ``hot`` contexts: the marks of all windows that repeat; and the rows of the others."""
    sizes = cut(different.groupBy("gkey").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("gkey"), "large")
    each = different.join(sizes, "gkey").withColumn("j", F.explode(F.expr("sequence(cast(least AS int), cast(most AS int))")))
    window = (F.col("gkey"), F.col("j"), F.expr("substring(left, 1, j)"), F.expr(f"substring(right, 1, {SIDE} - j)"))
    each = cut(each.select("doc", "p", "j", F.xxhash64(*window).alias("a"), F.xxhash64(F.lit(1), *window).alias("b")), "windows")
    first = cut(each.groupBy("a", "b").agg(F.min(F.struct("doc", "p")).alias("first")), "first")
    again = each.join(first, ["a", "b"]).where("doc <> first.doc OR p <> first.p").selectExpr("doc", "p", "shiftleft(1L, j) AS mask")
    return again, different.join(sizes, "gkey", "left_anti")


def marks(source: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(doc, p, mask) of every anchor with windows that repeat, for (doc, TEXT)."""
    spark = source.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(Anchors(b.column(TEXT).to_pylist()).anchor for b in slices(batches))])

    suspected = spark.sparkContext.broadcast(twice_seen(source.select(TEXT), hashes, lambda h: (h & np.uint64(bits - 1)).astype(np.uint32), bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a = Anchors(b.column(TEXT).to_pylist())
            hit = np.flatnonzero(has_bit(suspected.value, a.anchor & np.uint64(bits - 1)))
            own = np.ones(len(hit), bool)
            own[np.unique(mix(a.anchor[hit] ^ mix(a.context[hit] ^ mix(a.row[hit].astype(np.uint64)))), return_index=True)[1]] = False
            doc = b.column("doc").to_numpy()[a.row[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.anchor[hit].view(np.int64), a.context[hit].view(np.int64), doc, a.packed()[hit], own)], names=["kmer", "ctx", "doc", "pos", "own"])

    found = cut(source.mapInArrow(emit, "kmer long, ctx long, doc long, pos long, own boolean"), "anchors")
    once = found.where(~F.col("own"))
    per = once.groupBy("kmer", "ctx").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    per = cut(per, "contexts")
    many = per.groupBy("kmer").agg(F.count("*").alias("m")).where("m > 1")
    firsts = cut(per.select("kmer", "ctx", "first").join(many, "kmer"), "different")
    rest = once.join(per.where("n > 1").select("kmer", "ctx", "first"), ["kmer", "ctx"]).where("doc <> first")
    settled = cut(_marks(found.where("own").select("doc", "pos").unionByName(rest.select("doc", "pos"))), "copies")

    place_bits = bits >> 1
    wanted = spark.sparkContext.broadcast(bit_set(firsts.selectExpr(f"(kmer ^ ctx ^ first) & {place_bits - 1}L AS h"), place_bits))
    fields = [("kmer", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("p", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a = Anchors(b.column(TEXT).to_pylist())
            doc = b.column("doc").to_numpy()[a.row]
            hit = np.flatnonzero(has_bit(wanted.value, (a.anchor ^ a.context ^ doc.view(np.uint64)) & np.uint64(place_bits - 1)))
            hit = hit[np.sort(np.unique(mix(a.anchor[hit] ^ mix(a.context[hit] ^ mix(a.row[hit].astype(np.uint64)))), return_index=True)[1])]
            left, right = a.sides(hit)
            yield _batch(fields, [a.anchor[hit].view(np.int64), a.context[hit].view(np.int64), doc[hit], a.p[hit], a.least[hit], a.most[hit], left, right])

    rows = source.mapInArrow(contexts, "kmer long, ctx long, doc long, p long, least long, most long, left binary, right binary")
    rows = cut(rows.join(firsts.withColumnRenamed("first", "doc"), ["kmer", "ctx", "doc"]), "sides")
    suspected.destroy()
    wanted.destroy()
    rest, different = _dealt(rows.where(F.col("m") > hot))
    again, different = _placed(different, hot)
    cold = rows.where(F.col("m") <= hot).select(F.col("kmer").alias("gkey"), "doc", "p", "least", "most", "left", "right")
    return settled.unionByName(rest).unionByName(again).unionByName(_sorted_out(cold.unionByName(different)))


def covered(size: int, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a text the marked windows cover."""
    places = np.arange(SIDE + 1)
    row, j = np.nonzero((mask[:, None] >> places) & 1)
    start = p[row] - j
    start = start[(start >= 0) & (start + LENGTH <= size)]
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc``, an integer in the order of the ids."""
    if isinstance(docs.schema["id"].dataType, T.IntegralType):
        return docs.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))))
    ranks = cut(docs.select("id").distinct().orderBy("id").select(F.col("id").alias("known"), F.monotonically_increasing_id().alias("doc")), "ranks")
    return docs.join(ranks, F.col("id").eqNullSafe(F.col("known")), "left").drop("known")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, hot: int = HOT) -> DataFrame:
    """The id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = docs.select("id", "doc", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(TEXT))
    found = marks(rows.select("doc", TEXT), bits, hot)
    lists = cut(found.groupBy("doc").agg(F.collect_list(F.struct("p", "mask")).alias("marks")), "marks")  # one document's
    for _ in range(2):  # shuffle files of what is written go before the texts move
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    place_bits = bits >> 1
    known = spark.sparkContext.broadcast(bit_set(lists.select(F.expr(f"pmod(xxhash64(doc), {place_bits}L)").alias("h")), place_bits))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("hit", pa.array(has_bit(known.value, b.column("h").to_numpy())))

    placed = rows.withColumn("h", F.expr(f"pmod(xxhash64(doc), {place_bits}L)"))
    flagged = placed.mapInArrow(flag, T.StructType([*placed.schema, T.StructField("hit", T.BooleanType())]))
    kind = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("mask", T.LongType())]))
    whole = flagged.where(~F.col("hit")).select("id", TEXT, F.lit(None).cast(kind).alias("marks"))
    some = flagged.where("hit").join(lists, "doc", "left").select("id", TEXT, "marks")
    both = whole.unionByName(some)
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(n, T.BinaryType() if n == "kept" else T.LongType()) for n in names)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, own in zip(b.column(TEXT).to_pylist(), b.column("marks"), strict=True):
                if not own.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                p, mask = (own.values.field(n).to_numpy() for n in ("p", "mask"))
                gone = covered(len(text), p, mask)
                spans = int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in out], pa.binary() if k == 3 else pa.int64()) for k in range(4))], names=[id_col, *names])

    return both.mapInArrow(apply, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
