"""Line operations as native column expressions: splitting, windows, headers, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import HEADER_PREFIXES

BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """The lines of a text; a last line break does not open another line, and an empty text has none."""
    parts = F.split(text, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def windows(df: DataFrame, text: str = "content", size: int = 60, overlap: int = 10) -> DataFrame:
    """``df`` with a row for each window of lines that isn't blank: ``start_line``, ``end_line`` (1-based) and ``block``.

    Starts are 0, size - overlap, ... up to the first window that reaches the last line.
    """
    step = max(1, size - overlap)
    n = F.size("__lines")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) * step
    out = df.withColumn("__lines", split_lines(F.col(text))).where(n > 0)
    out = out.withColumn("__at", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    out = out.withColumn("start_line", F.col("__at") + 1).withColumn("end_line", F.least(F.col("__at") + size, n))
    out = out.withColumn("block", F.array_join(F.slice("__lines", F.col("start_line"), F.col("end_line") - F.col("__at")), "\n"))
    return out.where(F.col("block").rlike("\\S")).drop("__lines", "__at")


def file_header(text: Column, limit: int = 30) -> Column:
    """The leading lines, at most ``limit``, that are blank or begin as imports and comments do; null if that is nothing."""
    lines = F.slice(split_lines(text), 1, limit)
    strip = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    fits = lambda x: (strip(x) == "") | F.greatest(*(strip(x).startswith(p) for p in HEADER_PREFIXES))
    flags = F.transform(lines, fits)
    stop = F.array_position(flags, False)
    head = strip(F.array_join(F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines), "\n"))
    return F.when(head != "", head)


def truncate(text: Column, limit: Column | int) -> Column:
    """A snippet cut at a line boundary to about ``limit`` characters, with the number of lines left out.

    Each line costs its length and one; a first line that is too long leaves only the note.  A limit of 0 is none.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    lines = split_lines(text)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (acc["used"] + F.length(x) + 1 <= limit)
        return F.struct(F.when(fits, acc["used"] + F.length(x) + 1).otherwise(acc["used"]).alias("used"), (acc["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    kept = F.aggregate(lines, start, step)["kept"]
    rest = F.size(lines) - kept
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), kept), "\n"), F.lit("\n... ("), rest.cast("string"), F.lit(" more lines — use rag_source for full code)"))
    return F.when(text.isNull() | (limit <= 0) | (F.length(text) <= limit) | (rest <= 0), text).otherwise(cut)
