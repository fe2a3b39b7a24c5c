"""File trees as DataFrames, with the filters of a source scan."""

from __future__ import annotations

import os
import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..settings import EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, EXCLUDED_NAMES, MAX_FILE_BYTES


def suffix(path: Column) -> Column:
    """The lower-cased last suffix of a path's name, '' if it has none; a leading dot opens no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def allowed(path: Column, size: Column | None = None) -> Column:
    """Whether a scan takes a file, by its relative path and size."""
    ends = "|".join(re.escape(e) for e in EXCLUDED_EXTENSIONS if len(e) > 4)
    out = ~F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(d) for d in EXCLUDED_DIRS)))
    out &= ~suffix(path).isin(*EXCLUDED_EXTENSIONS) & ~name(path).isin(*EXCLUDED_NAMES) & ~name(path).rlike(f"({ends})$")
    return out if size is None else out & (size <= MAX_FILE_BYTES)


def taken(path: str, size: int) -> bool:
    """``allowed`` for the lister, which drops a file before anything opens it."""
    *_, base = parts = path.split("/")
    stem, _, ending = base.rpartition(".")
    if not EXCLUDED_DIRS_SET.isdisjoint(parts) or base in EXCLUDED_NAMES or size > MAX_FILE_BYTES:
        return False
    return not (stem and f".{ending}".lower() in EXCLUDED_EXTENSIONS) and not base.endswith(tuple(e for e in EXCLUDED_EXTENSIONS if len(e) > 4))


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regex, ignored) of an ignore file's lines, in order; the last that matches a path decides."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\") if negated or line[:2] in ("\\#", "\\!") else line
        folder = line.endswith("/")
        body = line.strip("/")
        anchored = "/" in line.rstrip("/")
        out, i = "", 0
        while i < len(body):
            c = body[i]
            if body.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif c == "*":
                out, i = out + "[^/]*", i + 1 + body.startswith("**", i)
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := body.find("]", i + 2)) > 0:
                inner = body[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
            elif c == "\\" and i + 1 < len(body):
                out, i = out + re.escape(body[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        rules.append((("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$"), not negated))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, flag in rules:
        out = F.when(path.rlike(pattern), F.lit(flag)).otherwise(out)
    return out


def strip_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")


EXCLUDED_DIRS_SET = frozenset(EXCLUDED_DIRS)


class TreeReader(DataSourceReader):
    """Lists a tree once and reads it in slices of about SLICE_BYTES, or of SLICE_FILES files."""

    SLICE_BYTES, SLICE_FILES = 64 << 20, 2000

    def __init__(self, root: str, content: bool, every: bool = True):
        self.root, self.content, self.every = root, content, every

    def partitions(self) -> list[InputPartition]:
        store, base = _store(self.root)
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
        out, rows, size, cut = [], [], 0, len(base.rstrip("/")) + 1
        for f in sorted(found, key=lambda f: f.path):
            if not self.every and not taken(f.path[cut:], f.size):
                continue
            if rows and (size + f.size > self.SLICE_BYTES or len(rows) >= self.SLICE_FILES):
                out.append(InputPartition(rows))
                rows, size = [], 0
            rows.append((f.path, f.path[cut:], f.size, f.mtime))
            size += f.size if self.content else 0
        return [*out, InputPartition(rows)]

    def read(self, partition: InputPartition):
        store, _ = _store(self.root)
        for full, path, size, at in partition.value:
            data = None
            if self.content:
                with store.open_input_stream(full) as f:
                    data = f.read()
            yield path, at, size, data


class TreeSource(DataSource):
    """``spark.read.format("filetree").load(root)``: all files, with names that begin with ``.`` or ``_`` as well, which
    Spark's own file sources hide.  Options: ``content`` (true; false lists only), ``every`` (true; false leaves out what no scan takes)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("content", "true").lower() == "true", self.options.get("every", "true").lower() == "true")


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def files(spark: SparkSession, root: str, content: bool = True, every: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of all files, or of those that a scan may take; ``path`` is relative to ``root``."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("content", str(content).lower()).option("every", str(every).lower()).load(root)


def scan(spark: SparkSession, root: str, ignore_text: str | None = None) -> DataFrame:
    """(path, hash, content, text) of the files that a scan takes.

    Bad UTF-8 becomes U+FFFD.
    """
    if ignore_text is None:
        ignore_text = _root_ignore(root)
    found = files(spark, root, every=False).where(allowed(F.col("path"), F.col("length")))
    rules = ignore_rules(ignore_text)
    if rules:
        found = found.where(~ignored(F.col("path"), rules))
    return found.select("path", F.sha2("content", 256).alias("hash"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _root_ignore(root: str) -> str:
    """The root's ignore file, '' if there is none."""
    store, base = _store(root)
    path = f"{base.rstrip('/')}/.gitignore"
    if store.get_file_info(path).type != fs.FileType.File:
        return ""
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def watched(events: DataFrame, root: str) -> DataFrame:
    """Events (path) that a watcher acts on: only the suffix and directory filters hold."""
    path = strip_scheme(F.col("path"))
    inside = path.startswith(re.sub(r"^[a-zA-Z0-9]+:/+", "/", os.path.abspath(root) if "://" not in root else root).rstrip("/") + "/")
    parts = F.split(F.expr("substring(regexp_replace(path, '^[a-zA-Z0-9]+:/+', '/'), %d)" % (len(os.path.abspath(root)) + 2)), "/")
    return events.where(inside & ~suffix(path).isin(*EXCLUDED_EXTENSIONS) & ~F.arrays_overlap(parts, F.array(*(F.lit(d) for d in EXCLUDED_DIRS))))


def byte_slice(chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """Chunks (id, file_path, byte_start, byte_end, content) with ``source``: the bytes of the file as it is now, else what is stored."""
    live = contents.select(F.col("path").alias("file_path"), F.col("content").alias("__bytes"))
    part = F.make_valid_utf8(F.expr("cast(substring(__bytes, cast(byte_start + 1 as int), cast(byte_end - byte_start as int)) as string)"))
    has = F.col("__bytes").isNotNull() & (F.col("byte_end") > F.col("byte_start"))
    return chunks.join(live, "file_path", "left").withColumn("source", F.when(has, part).otherwise(F.col("content"))).drop("__bytes")
