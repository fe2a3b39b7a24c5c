"""Incremental maintenance: hash diffs and copy-on-write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status): added, changed, same or removed, from (path, hash) of what is there and what was indexed."""
    both = current.select("path", F.col("hash").alias("now"), F.lit(True).alias("here")).join(indexed.select("path", F.col("hash").alias("was"), F.lit(True).alias("known")), "path", "full")
    status = F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "added").when(F.col("now").eqNullSafe(F.col("was")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def needs_update(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows of ``current`` that are new or whose hash differs."""
    was = indexed.select("path", F.col("hash").alias("__was"))
    return current.join(was, "path", "left").where(~F.col("hash").eqNullSafe(F.col("__was"))).drop("__was")


def removed(current: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.select("path").join(current.select("path"), "path", "left_anti")


def summary(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: files to index, to skip and to remove."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return diff(current, indexed).agg(count("added", "changed").alias("indexed"), count("same").alias("skipped"), count("removed").alias("removed"))


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    """``old`` without the rows of paths in ``gone`` (path), and ``new``: the next version of a table."""
    return old.join(gone.select(F.col("path").alias(key)), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def resolve_chunks(rows: DataFrame, chunks: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """``rows`` with the id of the first chunk of the same file and name, null if there is none."""
    first = chunks.where("name is not null").groupBy("file_path", F.col("name").alias(name_col)).agg(F.min("id").alias(id_col))
    return rows.join(first, ["file_path", name_col], "left")
