"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

For each length L of the benchmark items (lengths within an eighth share their middle one), every window of L words of every
document gets a 64-bit SimHash of its five-word shingles, each with the weight of its bytes, and is looked up among these items.  The index has a table
for each of the fingerprint's 4 blocks of 16 bits, in which an item stands under every value within ``radius // 4`` bits of its
own: two fingerprints within ``radius`` differ by no more than that in one block at least, so all of them are found.

What is found is verified exactly: the weighted Jaccard similarity of the shingles of item and window must reach
``percent``, at the window found or one up to an eighth of the item's length away (the best counts, the earliest on ties).  A
found window near which too few bytes of benchmark shingles lie to reach it is put aside without a look at the item.

Windows of 80 per cent have a cosine of 0.86 to 0.89, and so differ from the item in about 10 bits with a deviation of
3; the radius is 15, and a passage is missed only if all windows around it fall outside.  Weights count in the fingerprint as in the
similarity, so neither very long words nor very short ones change that.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  An item of fewer than ``n`` words has one shingle, of all its words.
Null and empty texts and items hold nothing.  A window is shorter than its item only if the document ends.  Items are broadcast
in blocks of about ``block_items`` (a worker's tables take 32 KB an item), one block at a time, with one pass over the documents
for each.  Repeated rows
give repeated results; equal items are all reported; item ids may be of any type; an empty table gives no rows, an empty
benchmark no hits; a kept column named ``hits`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Words, cut, map_texts, mix, sibling

RADIUS = 15
BLOCKS = 4
#: Windows are fingerprinted in chunks of so many, which stay in the processor's cache.
CHUNK = 16384
MAP_BITS = 20


def shingles_at(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle of n words that begins at each word; no weight if it does not end in the same text."""
    size = len(w.hash)
    out, weight, full = np.zeros(size, np.uint64), np.zeros(size, np.int64), size - n + 1
    if full > 0:
        bytes_of = w.end - w.start
        for k in range(n):
            out[:full] = mix(out[:full] + w.hash[k : full + k] + np.uint64(k + 1))
            weight[:full] += bytes_of[k : full + k]
        weight[:full][w.doc[:full] != w.doc[n - 1 :]] = 0
    return out, weight


class Sums:
    """Running sums of signed weights by bit of the shingle hashes; windows' fingerprints come from their differences."""

    def __init__(self, h: np.ndarray, weight: np.ndarray, longest: int):
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(weight)))
        ends = np.minimum(np.arange(len(h)) + longest, len(h))
        most = int((total[ends] - total[:-1]).max()) if len(h) else 0
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64  # sums may wrap, differences do not
        signs = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(kind)
        signs *= 2
        signs -= 1
        signs *= weight.astype(kind)[:, None]
        self.sums = np.zeros((len(h) + 1, 64), kind)
        np.cumsum(signs, axis=0, dtype=kind, out=self.sums[1:])

    def prints(self, begin: int, size: int, shingles: int) -> np.ndarray:
        """Fingerprints of the windows at begin .. begin + size - 1 that hold so many shingles."""
        s = self.sums
        return _packed(s[begin + shingles : begin + shingles + size] - s[begin : begin + size])

    def prints_at(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _packed(self.sums[ends] - self.sums[begins])


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits((sums > sums.dtype.type(0)).ravel(), bitorder="little").view(np.uint64)


class Group:
    """Up to 16 items that share a window size: their numbers, fingerprints and the tables of the multi-index (bits are items)."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        values = np.arange(1 << 16, dtype=np.uint16)
        near = values[np.bitwise_count(values) <= radius // BLOCKS]
        self.tables = np.zeros((BLOCKS, 1 << 16), np.uint16)
        for k, own in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS)):
            for table, value in zip(self.tables, own, strict=True):
                table[near ^ value] |= np.uint16(1 << k)

    def near(self, prints: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all fingerprints within the radius."""
        mask = self.tables[0].take(blocks[0])
        for k in range(1, BLOCKS):
            mask |= self.tables[k].take(blocks[k])
        at = np.flatnonzero(mask)
        row, item = np.nonzero(np.bitwise_count(prints[at][:, None] ^ self.prints) <= self.radius)
        return at[row], self.items[item]


def near_lengths(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of lengths, of which the longest is at most an eighth longer than the shortest."""
    out: list[list[int]] = []
    for x in sorted(set(lengths)):
        if out and x <= out[-1][0] + out[-1][0] // 8:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


class Index:
    """A block of benchmark items, ready for lookups: sorted shingles with weights, and groups by length."""

    def __init__(self, items: list[tuple[object, str | None]], n: int, radius: int):
        self.n = n
        w = Words([(t or "").encode() for _, t in items])
        self.ids, self.sizes = [i for i, _ in items], w.counts
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(items)
        self.radius = radius
        self.parts: list[tuple] = []  # words in a shingle, length, items, fingerprints
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.first = w.first
        for m in sorted({min(n, c) for c in w.counts.tolist() if c}):
            of = np.flatnonzero(w.counts == m if m < n else w.counts >= n)
            h, weight = shingles_at(w, m)
            for k in of.tolist():
                a, b = int(w.first[k]), int(w.first[k + 1]) - m + 1
                own, at = np.unique(h[a:b], return_index=True)
                self.shingles[k] = own, weight[a:b][at]
            every = np.unique(np.concatenate([self.shingles[k][0] for k in of.tolist()]))
            flags = np.zeros(1 << MAP_BITS, bool)
            flags[every & np.uint64((1 << MAP_BITS) - 1)] = True
            self.known[m] = every, flags
            sums = Sums(h, weight, int(w.counts[of].max()))
            prints = sums.prints_at(w.first[of], w.first[of + 1] - m + 1)
            for low, high in near_lengths(w.counts[of].tolist()):
                own = np.flatnonzero((w.counts[of] >= low) & (w.counts[of] <= high))
                self.parts += [(m, (low + high + 1) // 2, of[own[a : a + 16]], prints[own[a : a + 16]]) for a in range(0, len(own), 16)]
        self.made: dict | None = None
        self.totals = np.array([int(x.sum()) for _, x in self.shingles], np.int64)

    def groups(self) -> dict[int, dict[int, list[Group]]]:
        """By words in a shingle and length; made once in each worker, for the tables are larger than what they are made from."""
        if self.made is None:
            self.made = {}
            for m, size, items, prints in self.parts:
                self.made.setdefault(m, {}).setdefault(size, []).append(Group(items, prints, self.radius))
        return self.made

    def search(self, texts: list[bytes], least: float) -> list[list[tuple]]:
        """For each text its (item id, similarity, first word, words): the best window for each item."""
        out: list[list[tuple]] = [[] for _ in texts]
        w = Words(texts)
        for m, lengths in self.groups().items():
            best: dict[tuple[int, int], tuple] = {}
            h, weight = shingles_at(w, m)
            known = Verifier(self, w, m, h, weight, least)
            longest = max(lengths)
            for c in range(0, len(h), CHUNK):
                to = min(len(h), c + CHUNK)
                sums = Sums(h[c : to + longest], weight[c : to + longest], longest)
                room = len(h) - c
                text_end = w.first[w.doc[c:to] + 1] - c  # of each window's text, from the chunk's begin
                begins = np.arange(to - c)
                for size, groups in lengths.items():
                    inner = max(0, min(to - c, room - size + 1))
                    prints = np.zeros(to - c, np.uint64)
                    prints[:inner] = sums.prints(0, inner, size - m + 1)
                    late = np.flatnonzero(begins + size > text_end)  # windows that the text's end cuts short
                    if len(late):
                        prints[late] = sums.prints_at(late, np.maximum(late, text_end[late] - m + 1))
                    blocks = np.ascontiguousarray(prints.view(np.uint16).reshape(-1, BLOCKS).T.astype(np.intp))
                    for group in groups:
                        window, item = group.near(prints, blocks)
                        if len(window):
                            known.verify(window + c, item, best)
            for (doc, item), (similarity, a, words) in sorted(best.items()):
                out[doc].append((self.ids[item], -similarity, a - int(w.first[doc]), words, item))
        return [[x[:4] for x in sorted(rows, key=lambda x: x[4])] for rows in out]


class Verifier:
    """Exact similarities of windows of some texts."""

    def __init__(self, index: Index, w: Words, m: int, h: np.ndarray, weight: np.ndarray, least: float):
        self.index, self.w, self.m, self.h, self.weight, self.least = index, w, m, h, weight, least
        every, flags = index.known[m]
        own = np.zeros(len(h), np.int64)
        at = np.flatnonzero((weight > 0) & flags[h & np.uint64((1 << MAP_BITS) - 1)])
        at = at[every[np.minimum(np.searchsorted(every, h[at]), len(every) - 1)] == h[at]]
        own[at] = weight[at]
        self.known = np.concatenate((np.zeros(1, np.int64), np.cumsum(own)))
        self.seen: dict[tuple[int, int], float] = {}

    def verify(self, window: np.ndarray, item: np.ndarray, best: dict) -> None:
        """Put the best windows near the found ones into ``best``, by text and item."""
        w = self.w
        real = self.weight[window] > 0
        window, item = window[real], item[real]
        doc, sizes = w.doc[window], self.index.sizes[item]
        slack = -(-sizes // 8)
        low = np.maximum(window - slack, w.first[doc])
        high = np.minimum(window + slack + sizes, w.first[doc + 1])
        good = self.known[high] - self.known[low] >= self.least * self.index.totals[item] - 1e-9
        for d, at, k, size, slack in zip(*(x[good].tolist() for x in (doc, window, item, sizes, slack)), strict=True):
            begin, end = int(w.first[d]), int(w.first[d + 1])
            last = max(begin, end - self.m)
            for a in range(max(begin, at - slack), min(last, at + slack) + 1):
                if (similarity := self.seen.get((k, a))) is None:
                    similarity = self.seen[k, a] = self.similarity(a, min(a + size, end), k)
                if similarity + 1e-12 >= self.least and (-similarity, a) < best.get((d, k), (0,))[:2]:
                    best[d, k] = (-similarity, a, min(a + size, end) - a)

    def similarity(self, begin: int, end: int, item: int) -> float:
        own, at = np.unique(self.h[begin : end - self.m + 1], return_index=True)
        weight = self.weight[begin + at]
        other, total = self.index.shingles[item][0], self.index.totals[item]
        place = np.minimum(np.searchsorted(other, own), len(other) - 1)
        common = int(weight[other[place] == own].sum())
        return common / (int(weight.sum()) + int(total) - common)


def _hits(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: Iterable[str] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", n: int = 5, percent: int = 80, radius: int = RADIUS, block_items: int = 4096) -> DataFrame:
    """Kept columns and ``hits`` (array of item_id, similarity, start_word, n_words) of every document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    count = max(1, -(-items.count() // block_items))
    hits, names = _hits(items.schema["item_id"].dataType), ("item_id", "similarity", "start_word", "n_words")

    def passed(block: int, source: DataFrame, own: list[str]) -> tuple[DataFrame, object]:
        rows = [tuple(r) for r in items.where(F.expr(f"pmod(xxhash64(item_id, item_text), {count})") == block).orderBy("item_id", "item_text").collect()]  # about block_items
        index = spark.sparkContext.broadcast(Index(rows, n, radius))

        def search(texts: list[bytes], _: pa.RecordBatch) -> list:
            return [[[dict(zip(names, x, strict=True)) for x in found] for found in index.value.search(texts, percent / 100)]]

        return map_texts(source, search, [("hits", hits)], text_col=text_col, keep=own), index

    kept = [c for c in dict.fromkeys(keep) if c != "hits"]
    if count == 1:
        return passed(0, docs, kept)[0]
    source = cut(docs.select(*kept, *({text_col} - {*kept}), F.monotonically_increasing_id().alias("__row")), "searched")
    found = None
    for block in range(count):
        rows, index = passed(block, source, ["__row"])
        part = cut(rows.where(F.size("hits") > 0), "hits")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    found = cut(found.groupBy("__row").agg(F.flatten(F.collect_list("hits")).alias("hits")), "hits")  # one document's
    return source.select(*kept, "__row").join(found, "__row", "left").select(*kept, F.coalesce("hits", F.array().cast(hits)).alias("hits"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (sibling(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = contaminated(docs, benchmark).where(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*").withColumn("similarity", F.round("similarity", 9))
