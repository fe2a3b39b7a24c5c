"""Filters of a fixed number of bits, built where the data is and broadcast: twice-seen hashes and sets of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = 64
BITMAP = 32768  # bits of Spark's bitmap aggregate


def _pack(positions: np.ndarray) -> bytes:
    """Sorted positions as gaps, which compress well."""
    return np.diff(positions, prepend=np.uint32(0)).astype(np.uint32).tobytes()


def _merge(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """once = a.once | b.once and twice = a.twice | b.twice | (a.once & b.once), over all rows."""
    once, twice = np.zeros(width, bool), np.zeros(width, bool)
    for a, b in zip(rows["once"].to_pylist(), rows["twice"].to_pylist(), strict=True):
        seen = np.cumsum(np.frombuffer(a, np.uint32), dtype=np.uint32)
        twice[seen[once[seen]]] = True
        once[seen] = True
        twice[np.cumsum(np.frombuffer(b, np.uint32), dtype=np.uint32)] = True
    return once, twice


def twice_seen(source: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], np.ndarray], positions: Callable[[np.ndarray], np.ndarray], bits: int, fan_in: int = 256) -> np.ndarray:
    """The packed filter of the hashes seen twice or more.

    ``hashes`` gives a partition's hashes (repeats included), ``positions`` the bit positions (uint32) of some.  No
    hash seen twice is missed; the fuller the filter, the more others pass.  Partitions report sorted positions by segment; beyond
    ``fan_in`` partitions these are merged in two levels.
    """
    width = bits // SEGMENTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(hashes(batches), return_counts=True)
        part, rows = TaskContext.get().partitionId(), []
        once, twice = np.unique(positions(keys)), np.unique(positions(keys[counts > 1]))
        for seg in range(SEGMENTS):
            lo, hi = seg * width, (seg + 1) * width
            a, b = (x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - np.uint32(lo) for x in (once, twice))
            if len(a):
                rows.append((seg, part % fan_in, _pack(a), _pack(b)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["seg", "grp", "once", "twice"])

    def level(rows: pa.Table) -> pa.Table:
        once, twice = _merge(rows, width)
        return pa.table({"seg": rows["seg"].slice(0, 1), "once": pa.array([_pack(np.flatnonzero(once).astype(np.uint32))], pa.binary()), "twice": pa.array([_pack(np.flatnonzero(twice).astype(np.uint32))], pa.binary())})

    def last(rows: pa.Table) -> pa.Table:
        return pa.table({"seg": rows["seg"].slice(0, 1), "packed": pa.array([np.packbits(_merge(rows, width)[1], bitorder="little").tobytes()], pa.binary())})

    parts = source.mapInArrow(local, "seg int, grp int, once binary, twice binary")
    if source.rdd.getNumPartitions() > fan_in:
        parts = parts.groupBy("seg", "grp").applyInArrow(level, "seg int, once binary, twice binary")
    merged = parts.groupBy("seg").applyInArrow(last, "seg int, packed binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # SEGMENTS rows of width / 8 bytes
        out[row["seg"] * width // 8 : (row["seg"] + 1) * width // 8] = np.frombuffer(row["packed"], np.uint8)
    return out


def has_bit(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return ((packed[positions >> positions.dtype.type(3)] >> (positions & positions.dtype.type(7)).astype(np.uint8)) & 1).astype(bool)


def bit_set(places: DataFrame, bits: int) -> np.ndarray:
    """The packed set of column ``h`` (0 <= h < bits) of ``places``, by bitmap aggregation."""
    maps = places.select("h").groupBy(F.expr(f"h div {BITMAP}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(h % {BITMAP})").alias("map"))
    packed = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # bits / 8 bytes at most
        packed[r["bucket"] * BITMAP // 8 : (r["bucket"] + 1) * BITMAP // 8] = np.frombuffer(r["map"], np.uint8)
    return packed
