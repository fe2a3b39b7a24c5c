"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A text's set holds the hashes of its distinct n-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; with
fewer words the whole sequence is the one shingle).  Texts of equal sets form a class, named by its smallest id; only
one member of a class goes on.

Sketch: round i = 0, 1, ... hashes every element to a bin (in the first t rounds a hashed bin, in the next t rounds
bin i - t) with the value (i, hash), and a bin keeps its least value; after a round that leaves no bin empty the sketch is done.
Every coordinate is filled after 2t rounds at the latest, and the share of equal coordinates estimates the Jaccard
similarity with the concentration of t independent ones.

Candidates share one of ``bands`` bands of ``rows`` coordinates (at similarity 0.8, 40 bands of 5 miss a pair with
probability 2e-7).  In each band bucket all members are compared, on full sets, with the smallest id: a star, not all
pairs; the members of a large star are dealt over tasks, each with its own copy of that one text.  Links give
components.  Where the members of a star are in several components, pairs across components are compared as well: the
members of its largest component are dealt into blocks once and the others meet every block, each pair settled exactly by
what the two sets differ by from the star's centre; only links between components leave a task.  Nothing is capped.

Null texts and texts without words have an empty set and are linked with nothing.  A row with a null id is linked with nothing
either: its ``component_id`` is null and it is kept.  Rows that repeat an id are judged each by its own text; an id that names a
class of equal sets carries the links of all its rows.  Ids may be of any type with an order.  The result is empty for an empty table; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import M64, cut, map_texts, mix, release, shingle_sets, slices
from .filters import bit_set, has_bit

#: Members of a star in a task, beside its centre; and members of a block of pairs across components.
SALT = 128
BLOCK = 256
FILTER_BITS = 1 << 26
_EMPTY = np.uint64(M64)


def sketches(h: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set ``h[first[k]:first[k + 1]]``; rows of empty sets hold no values."""
    n = len(first) - 1
    out = np.full(n * t, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * t):
        if not len(h):
            break
        r = mix(h ^ mix(np.array([i + 1], np.uint64)))
        bins = ((r >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, np.uint64(i << 32) | (r & np.uint64(0xFFFFFFFF)))
        rest = (out.reshape(n, t) == _EMPTY).any(1)[owner]
        h, owner = h[rest], owner[rest]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + part[:, :, k])
    return key.view(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return (c[first[1:]] - c[first[:-1]]).view(np.int64)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Id, ``n_shingles``, a 128-bit hash of the set (null if empty), and band keys."""
    t = bands * rows

    def sign(texts: list[bytes], _: pa.RecordBatch) -> list:
        h, first = shingle_sets(texts, n)
        sizes = np.diff(first)
        sketch = sketches(h, first, t)
        empty = sizes == 0
        keys = band_keys(sketch, bands, rows)
        # rows of empty sets get no band keys
        ends = np.concatenate(([0], np.cumsum(np.where(empty, 0, bands)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~empty].ravel()))
        return [
            pa.array(sizes.astype(np.int64)),
            pa.array(_sums(mix(h ^ np.uint64(0xA5A5)), first), mask=empty),
            pa.array(_sums(mix(h ^ np.uint64(0x5A5A5A)), first), mask=empty),
            lists,
        ]

    fields = [("n_shingles", T.LongType()), ("set_a", T.LongType()), ("set_b", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    return map_texts(docs, sign, fields, text_col=text_col, keep=[id_col])


def similar_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted arrays of distinct values: 100 * |both| >= percent * |either|."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def likely(rows: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, Broadcast]:
    """The rows whose ``id`` is in ``ids``, and few others: a broadcast set of ``bits`` bits lets texts that nothing needs
    stay where they are.  With more ids it lets more rows through."""
    place = lambda: F.pmod(F.xxhash64("id"), F.lit(bits))
    known = rows.sparkSession.sparkContext.broadcast(bit_set(ids.select(place().alias("h")), bits))
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(known.value, batch.column(0).to_numpy()))).select(columns)

    return rows.select(place().alias("__place"), *columns).mapInArrow(run, rows.schema), known


def compared(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """For distinct pairs (a, b): ``linked`` (the full sets are similar enough), and where a has several pairs the size of
    b's set and the elements by which it differs from a's (``delta``).

    The texts of a star go to tasks of SALT members, each with a copy of the centre's, which comes first there.
    """
    sizes = cut(pairs.groupBy("a").agg(F.count("*").alias("n")), "sizes")
    deal = F.expr(f"cast(ceil(n / {SALT}) as bigint)")
    members = pairs.join(sizes, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), deal).alias("salt"), F.lit(1).alias("part"), (F.col("n") > 1).alias("many"))
    centres = sizes.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), deal - 1)).alias("salt"), F.lit(0).alias("part"), (F.col("n") > 1).alias("many"))
    roles = cut(members.unionByName(centres), "roles")
    needed, known = likely(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), roles)
    rows = needed.join(roles, "id").select("a", "salt", "part", "id", "many", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in batches:
            for part in slices([batch], "text"):
                h, first = shingle_sets([x or b"" for x in part.column("text").to_pylist()], n)
                out: list[list] = [[], [], [], [], []]
                columns = (part.column(c).to_pylist() for c in ("a", "salt", "part", "id", "many"))
                for k, (a, salt, member, b, many) in enumerate(zip(*columns, strict=True)):
                    own = h[first[k] : first[k + 1]]
                    if not member:
                        if (a, salt) != key:
                            key, centre = (a, salt), []
                        if not any(np.array_equal(own, c) for c in centre):  # rows that repeat an id
                            centre = sorted([*centre, own.copy()], key=lambda x: (len(x), x.tobytes()))
                        continue
                    delta = np.setxor1d(centre[0], own, assume_unique=True).tobytes() if many else None
                    for column, x in zip(out, (a, b, any(similar_enough(c, own, percent) for c in centre), len(own), delta), strict=True):
                        column.append(x)
                ids = part.column("id").type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (ids, ids, pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "linked", "size", "delta"])

    fields = [T.StructField("linked", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("delta", T.BinaryType())]
    made = cut(rows.mapInArrow(check, T.StructType([pairs.schema["a"], pairs.schema["b"], *fields])), "stars")
    known.destroy()
    release(sizes, roles)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (a, b): the smallest id that it reaches.

    Contraction: each round every node takes the name of the least node near it, edges follow, and loops and repeats go.
    The first rounds' order is that of the ids, under which a star falls to its centre at once; later ones order by a new
    hash each, under which any graph loses a constant share of its nodes a round.  Joins on a hub's name have written
    tables at both sides, so that a skewed partition can be split.
    """
    now = cut(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    names, rounds = None, 0
    while not now.isEmpty():
        both = now.union(now.select("v", "u"))
        if rounds < 2:
            near = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        else:
            order = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), F.col(c).alias("v"))
            near = both.groupBy("u").agg(F.min(order("v")).alias("w")).select("u", F.least(order("u"), "w")["v"].alias("m"))
        near = cut(near, "near")
        moved = now.join(near, "u").select("v", F.col("m").alias("x")).join(near.withColumnRenamed("u", "v"), "v").select(F.col("x").alias("u"), F.col("m").alias("v"))
        then = cut(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        if names is None:
            names = near.select(F.col("u").alias("id"), F.col("m").alias("name"))
        else:
            further = near.select(F.col("u").alias("name"), "m")
            names = cut(names.join(further, "name", "left").select("id", F.coalesce("m", "name").alias("name")), "names")
        release(now)
        now, rounds = then, rounds + 1
    if names is None:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if rounds <= 2:  # every name is the least id already
        return names.withColumnRenamed("name", "component")
    least = cut(names.groupBy("name").agg(F.min("id").alias("component")), "least")
    return names.join(least, "name").select("id", "component")


def block_links(ids: np.ndarray, comp: np.ndarray, size: np.ndarray, delta: list[bytes], left: np.ndarray, percent: int) -> list[tuple]:
    """Pairs of components (at most as many as connect them) that similar enough members have, of which one is in ``left``.

    ``delta`` holds each member's difference from one common set.  Two members differ by the difference of theirs, so
    the matrix of common elements needs these only, and of them only those that two members have.
    """
    lengths = np.array([len(x) // 8 for x in delta], np.int64)
    _, place, counts = np.unique(np.frombuffer(b"".join(delta), np.uint64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), lengths)
    often = counts[place] > 1
    column = (np.cumsum(counts > 1) - 1)[place[often]]
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rows = np.flatnonzero(left)
    both = np.zeros((len(rows), len(ids)), np.float32)
    width = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(ids), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part[rows] @ part.T
    apart = lengths[rows][:, None] + lengths - 2 * both.astype(np.int64)
    total = size[rows][:, None] + size
    names, label = np.unique(comp, return_inverse=True)
    x, y = np.nonzero((100 * (total - apart) >= percent * (total + apart)) & (label[rows][:, None] != label))
    x, y = label[rows[x]], label[y]
    _, once = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_index=True)
    parent, out = list(range(len(names))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k in once.tolist():
        p, q = root(int(x[k])), root(int(y[k]))
        if p != q:
            parent[p] = q
            out.append((names[x[k]], names[y[k]]))
    return out


def _remaining(stars: DataFrame, labels: DataFrame, *, percent: int) -> DataFrame:
    """Links (a, b) between components, from pairs of one star's members that are in different ones.

    The members of a star's largest component (the main one) need no comparison with each other: they are dealt into blocks once,
    and only the others, the strays, are copied to every block of the main ones and of the strays.
    """
    named = stars.where("delta is not null").join(labels.withColumnRenamed("id", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    named = cut(named.select("a", "b", "component", "size", "delta"), "named")
    per = named.groupBy("a", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("a").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where("main.n < n")
    main = cut(main.select("a", F.col("main.component").alias("main"), F.expr(f"cast(ceil(main.n / {BLOCK}) as bigint)").alias("mains"), F.expr(f"cast(ceil((n - main.n) / {BLOCK}) as bigint)").alias("strays")), "mixed")
    rows = named.join(main, "a")
    own = F.when(F.col("component") == F.col("main"), F.pmod(F.xxhash64("b"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("b"), F.col("strays")))
    last = F.col("mains") + F.col("strays") - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("own") < F.col("mains"), F.sequence("mains", last)).otherwise(F.sequence(F.lit(0).cast("long"), last))))
    rows = rows.select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "b", "component", "size", "delta")
    kind = rows.schema["b"].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        comp = pdf["component"].to_numpy()
        out = block_links(pdf["b"].to_numpy(), comp, pdf["size"].to_numpy(), pdf["delta"].tolist(), (pdf["own"] == pdf["j"]).to_numpy(), percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype(comp.dtype)

    found = cut(rows.repartition("a", "i", "j").groupBy("a", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}"), "links")
    release(named, main)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """Per document: the id, ``n_shingles``, ``component_id`` and ``kept`` (the id is its component's smallest)."""
    sig = cut(signatures(docs, id_col=id_col, text_col=text_col, n=n, bands=bands, rows=rows).withColumnRenamed(id_col, "id"), "signatures")
    some = sig.where("n_shingles > 0 and id is not null")
    classes = cut(some.groupBy("set_a", "set_b").agg(F.min("id").alias("id")), "classes")
    keyed = some.select("id", "bands").join(classes.select("id"), "id", "left_semi").select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    pairs = cut(keyed.join(shared, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    stars = compared(pairs, docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    labels = components(stars.where("linked").select("a", "b"))
    found = _remaining(stars, labels, percent=percent)
    if not found.isEmpty():
        merged = components(found).select(F.col("id").alias("name"), F.col("component").alias("into"))
        every = labels.union(found.select("a", "a").union(found.select("b", "b"))).distinct()  # ids that no star links are their own component
        labels = cut(every.withColumnRenamed("component", "name").join(merged, "name", "left").select("id", F.coalesce("into", "name").alias("component")), "labels")
    named = cut(classes.join(labels, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id")), "components")
    release(pairs, stars)
    out = sig.select("id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2, percent=80)
