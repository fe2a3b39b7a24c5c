"""The stored index: versioned Parquet tables, replaced as a whole by a pointer swap.

A run scans the tree, diffs content hashes, parses and encodes what is new or changed, and writes the next version of every table:
rows of unchanged files are copied over, rows of changed and removed files are not (copy on write by an anti-join on the
file path).  Readers see a version or the next, never a mixture; the version before the current one stays for those who have begun.
Postings (stemmed, by term) and chunk lengths are stored too, so that a search reads its terms' rows and not the texts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .functions.vectors import encoded, hashing_encoder
from .operators import search
from .operators.incremental import needs_update, replaced
from .parse.files import parsed, tables
from .schema import TABLES
from .sources.tree import scan

KEYS = {"files": "path"}
#: What keyword search reads; the postings are made of these.
COLUMNS = ["name", "content", "file_path", "chunk_type"]


class Index:
    def __init__(self, spark: SparkSession, root: str, directory: str | None = None, encoder=None):
        self.spark, self.root = spark, root
        self.directory = directory or store.of_project(store.default(spark), root)
        self.encoder = encoder or hashing_encoder()

    # ------------------------------------------------------------ versions

    def _store(self) -> tuple[fs.FileSystem, str]:
        return store.opened(self.directory)

    def meta(self) -> dict:
        """What the pointer file says; {} if nothing is indexed."""
        return store.read_json(f"{self.directory}/current.json") or {}

    def _swap(self, meta: dict) -> None:
        old = self.meta()
        store.write_json(f"{self.directory}/current.json", meta | {"before": old.get("version")})
        if old.get("before"):  # the version just replaced stays for its readers
            files, base = self._store()
            files.delete_dir(f"{base}/{old['before']}")

    def table(self, name: str) -> DataFrame:
        version = self.meta().get("version")
        if not version:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.directory}/{version}/{name}")

    @property
    def exists(self) -> bool:
        return bool(self.meta())

    def reset(self) -> None:
        files, base = self._store()
        if files.get_file_info(base).type == fs.FileType.Directory:
            files.delete_dir_contents(base)

    # ------------------------------------------------------------ indexing

    def update(self, force: bool = False, progress: Callable[[int, int, str], None] | None = None) -> dict:
        """Bring the index up to date: counts of indexed, skipped and removed files, of chunks, and seconds.

        ``progress`` is told (done, steps, message) as the steps end.
        """
        began = time.time()
        steps, done = 4, 0

        def told(message: str) -> None:
            nonlocal done
            done += 1
            if progress is not None:
                progress(done, steps, message)

        files, base = store.opened(self.root)
        if files.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"Not a directory: {self.root}")
        if force:
            self.reset()
        version = f"v{int(began * 1000)}-{uuid.uuid4().hex[:8]}"
        target = f"{self.directory}/{version}"
        current = scan(self.spark, self.root).select("path", "hash", "text").persist()
        known = self.table("files")
        changed = needs_update(current, known).persist()
        gone = known.select("path").join(current.select("path"), "path", "left_anti").persist()
        n_changed, n_gone, n_all = changed.count(), gone.count(), current.count()
        out = {"indexed": n_changed, "skipped": n_all - n_changed, "removed": n_gone, "chunks": 0}
        told(f"{n_all} files listed, {n_changed} to index")
        if n_changed or n_gone or not self.exists:
            rows = parsed(changed).persist()
            new = tables(rows)
            new["files"] = changed.select("path", "hash", F.current_timestamp().alias("last_indexed"))
            stale = gone.unionByName(changed.select("path"))
            for name in ("files", "chunks", "symbols", "calls", "imports", "inheritance"):
                replaced(self.table(name), new[name], stale, KEYS.get(name, "file_path")).write.parquet(f"{target}/{name}")
            fresh = self.spark.read.schema(TABLES["chunks"]).parquet(f"{target}/chunks").join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
            out["chunks"] = fresh.count()
            told(f"{out['chunks']} chunks parsed")
            vectors = fresh.select("id", "file_path", encoded(F.concat_ws("\n", "name", "content"), self.encoder).alias("embedding"))
            replaced(self.table("vectors"), vectors, stale).write.parquet(f"{target}/vectors")
            told("vectors written")
            words = search.postings(fresh, COLUMNS, stem=True).join(fresh.select("id", "file_path"), "id")
            words = replaced(self.table("postings"), words, stale)
            words.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{target}/postings")  # a term's rows stand together
            stats = search.doc_stats(fresh, COLUMNS, diacritics=True).join(fresh.select("id", "file_path"), "id")
            replaced(self.table("doc_stats"), stats, stale).write.parquet(f"{target}/doc_stats")
            told("postings written")
            rows.unpersist()
            self._swap({"version": version, "root": self.root, "dim": len(self.encoder(pd.Series([""]))[0]), "last_indexed": time.time()})
        for df in (current, changed, gone):
            df.unpersist()
        return out | {"duration": round(time.time() - began, 3)}

    def status(self) -> dict:
        meta = self.meta()
        if not meta:
            return {"status": "not_indexed", "project_path": self.root}
        files, base = self._store()
        size = sum(f.size or 0 for f in files.get_file_info(fs.FileSelector(f"{base}/{meta['version']}", recursive=True)))
        known = self.table("files").agg(F.count("*").alias("total_files"), F.max("last_indexed").alias("last_indexed")).first()
        counts = {f"total_{n}": self.table(n).count() for n in ("chunks", "symbols", "calls", "imports", "inheritance")}
        return {"status": "ready", "project_path": self.root, "total_files": known["total_files"], "last_indexed": str(known["last_indexed"]), "vector_count": self.table("vectors").count(), "size_mb": round(size / 2**20, 2), **counts}
