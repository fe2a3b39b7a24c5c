"""Files to rows: structural chunks with a header, line windows where there is no structure, and the code graph.

Chunks are the outermost definitions (methods belong to their class's chunk); symbols, calls, imports and inheritance come
from all levels.  Ids are hashes of file, place and name, so that they are the same in every run.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import HEADER_PREFIXES, LANGUAGES, WINDOW_LINES, WINDOW_OVERLAP
from . import lexical, python_source

ROW = "tag string, file_path string, name string, other string, kind string, line int, start_line int, end_line int, byte_start long, byte_end long, language string, content string"
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in ROW.split(", "))])


def header(text: str, limit: int = 30) -> str | None:
    out = []
    for line in text.splitlines()[:limit]:
        s = line.strip()
        if s and not s.startswith(HEADER_PREFIXES):
            break
        out.append(line)
    return "\n".join(out).strip() or None


def line_windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of windows that aren't blank; as ``functions.lines.windows`` makes them."""
    lines = text.splitlines()
    step = max(1, size - overlap)
    at = 0
    while lines:
        end = min(at + size, len(lines))
        block = "\n".join(lines[at:end])
        if block.strip():
            yield at + 1, end, block
        if end == len(lines):
            break
        at += step


def parse(path: str, text: str, size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> list[dict]:
    """Rows of one file: tag chunk, symbol, call, import or base."""
    ext = os.path.splitext(path)[1].lower()
    language = lexical.BY_EXTENSION.get(ext)
    found = None
    if language == "python":
        found = python_source.read(text)
    elif language:
        found = lexical.read(text, language)
    rows: list[dict] = []
    row = lambda tag, **x: rows.append({"tag": tag, "file_path": path, **x})
    if found and found[0]:
        defs, calls, imports, bases = found
        lines = lexical.Lines(text)
        if head := header(text):
            row("chunk", name=os.path.splitext(os.path.basename(path))[0], kind="file_header", start_line=1, end_line=head.count("\n") + 1, byte_start=0, byte_end=0, language=language, content=head)
        last = -1
        for d in defs:
            if d.start >= last:
                last = d.end
                begin, end = lines.at(d.start), lines.at(max(d.start, d.end - 1))
                content = text[d.start : d.end]
                if end - begin + 1 >= 3 and content.strip():
                    before = len(text[: d.start].encode())
                    row("chunk", name=d.name, kind=d.type, start_line=begin, end_line=end, byte_start=before, byte_end=before + len(content.encode()), language=language, content=content)
            if d.kind:
                row("symbol", name=d.name, kind=d.kind, line=lines.at(d.start), language=language)
    else:
        calls, imports, bases = found[1:] if found else ([], [], [])
        lines = lexical.Lines(text)
        for begin, end, block in line_windows(text, size, overlap):
            row("chunk", kind="block", start_line=begin, end_line=end, byte_start=0, byte_end=0, language=language or LANGUAGES.get(ext, "text"), content=block)
    for caller, callee, at in calls:
        row("call", name=caller, other=callee, line=lines.at(at), language=language)
    for name, module in imports:
        row("import", name=name, other=module, language=language)
    for child, parent, relation, at in bases:
        row("base", name=child, other=parent, kind=relation, line=lines.at(at), language=language)
    return rows


def parsed(files: DataFrame, size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Tagged rows of all (path, text) files; a file that can't be read gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += parse(path, text or "", size, overlap)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "text").mapInArrow(run, ROW)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The index tables of tagged rows (which should be written or cached: each table reads them)."""
    tag = lambda t: rows.where(F.col("tag") == t)
    chunk_id = F.xxhash64("file_path", "start_line", "end_line", "kind", F.coalesce("name", F.lit("")))
    chunks = tag("chunk").select(chunk_id.alias("id"), "file_path", "name", "start_line", "end_line", "byte_start", "byte_end", F.col("kind").alias("chunk_type"), "language", "content").dropDuplicates(["id"])
    from ..operators.incremental import resolve_chunks

    symbols = resolve_chunks(tag("symbol").select("name", "kind", "file_path", "line"), chunks, "name", "chunk_id")
    calls = resolve_chunks(tag("call").select(F.col("name").alias("caller_name"), F.col("other").alias("callee_name"), "line", "file_path"), chunks, "caller_name", "caller_chunk_id")
    imports = tag("import").select("file_path", F.col("name").alias("imported_name"), F.col("other").alias("module_path"))
    bases = tag("base").select(F.col("name").alias("child_name"), F.col("other").alias("parent_name"), F.col("kind").alias("relation"), "file_path", "line")
    return {"chunks": chunks, "symbols": symbols, "calls": calls, "imports": imports, "inheritance": bases}
