"""Schemas of the index tables; rows are keyed by ``file_path``, ids are deterministic hashes."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in spec.split(","))])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}

FILES = _schema("path string, hash string, last_indexed timestamp")
CHUNKS = _schema("id long, file_path string, name string, start_line int, end_line int, byte_start long, byte_end long, chunk_type string, language string, content string")
SYMBOLS = _schema("chunk_id long, name string, kind string, file_path string, line int")
CALLS = _schema("caller_chunk_id long, caller_name string, callee_name string, line int, file_path string")
IMPORTS = _schema("file_path string, imported_name string, module_path string")
INHERITANCE = _schema("child_name string, parent_name string, relation string, file_path string, line int")
VECTORS = _schema("id long, file_path string, embedding vector")
POSTINGS = _schema("term string, id long, file_path string, col int, pos int")
DOC_STATS = _schema("id long, file_path string, dl int")
TABLES = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "calls": CALLS, "imports": IMPORTS, "inheritance": INHERITANCE, "vectors": VECTORS, "postings": POSTINGS, "doc_stats": DOC_STATS}
