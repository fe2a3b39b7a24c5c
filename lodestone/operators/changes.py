"""Version-control changes: files by status, line counts, and the symbols in what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_status(changes: DataFrame) -> DataFrame:
    """(status, files): distinct files modified, added or deleted; renames and copies don't count."""
    known = changes.where(F.col("status").substr(1, 1).isin("M", "A", "D"))
    return known.groupBy(F.col("status").substr(1, 1).alias("status")).agg(F.count_distinct("path").alias("files"))


def parse_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """(status, path) of ``status<TAB>path`` lines."""
    parts = F.split(column, "\t", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].substr(1, 1).alias("status"), parts[1].alias("path")).where(F.col("status").isin("M", "A", "D"))


def line_totals(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row: inserted and deleted lines of diff statistics."""
    number = lambda word: F.sum(F.coalesce(F.regexp_extract(column, rf"(\d+) {word}", 1).try_cast("long"), F.lit(0)))
    return lines.agg(F.coalesce(number("insertion"), F.lit(0)).alias("insertions"), F.coalesce(number("deletion"), F.lit(0)).alias("deletions"))


def changed_symbols(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, kind, file, line, change) of symbols in modified or added files; modified wins."""
    files = changes.where(F.col("status").substr(1, 1).isin("M", "A")).groupBy(F.col("path").alias("file_path")).agg(F.max(F.col("status").substr(1, 1) == "M").alias("m"))
    return symbols.join(files, "file_path").select("name", "kind", F.col("file_path").alias("file"), "line", F.when(F.col("m"), "modified").otherwise("added").alias("change")).orderBy("file", "line", "name")
