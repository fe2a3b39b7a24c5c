"""The service surface: thirteen calls over indexes and workspaces.  Each returns plain dictionaries; the plans behind them are DataFrames."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .index import COLUMNS, Index
from .operators import changes, graph, routing, search, workspace
from .sources import tree, vcs
from .streaming.watch import Watchers


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    """``folder`` holds the indexes and project lists (else the session's, see ``store``); ``encoder`` turns a batch of texts into vectors;
    a search waits at most ``wait`` seconds for a project's first index."""

    def __init__(self, spark: SparkSession, folder: str | None = None, encoder=None, wait: float = 60.0):
        self.spark, self.folder, self.encoder, self.wait = spark, folder or store.default(spark), encoder, wait
        self.watchers = Watchers(spark)
        self.pool = ThreadPoolExecutor(4)
        self.jobs: dict[str, Future] = {}
        self.told: set[str] = set()
        self.lock = threading.Lock()

    def index_of(self, root: str) -> Index:
        root = os.path.abspath(root)
        return Index(self.spark, root, store.of_project(self.folder, root), self.encoder)

    # ------------------------------------------------------------ indexing

    def rag_index(self, path: str, force: bool = False, progress: Callable[[int, int, str], None] | None = None) -> dict:
        return self.index_of(path).update(force, progress)

    def ensure_index(self, path: str, wait: float | None = None) -> dict | None:
        """Index a project that has none yet, waiting at most ``wait`` seconds.

        None if it is ready; else its state: in_progress, error, or (once) done.
        """
        root = os.path.abspath(path)
        with self.lock:
            job = self.jobs.get(root)
            if job is None:
                if self.index_of(root).exists:
                    return None
                job = self.jobs[root] = self.pool.submit(self.index_of(root).update)
        try:
            result = job.result(self.wait if wait is None else wait)
        except TimeoutError:
            return {"status": "in_progress", "project_path": root}
        except Exception as e:
            with self.lock:
                self.jobs.pop(root, None)
            return {"status": "error", "project_path": root, "error": str(e)}
        with self.lock:
            if root in self.told:
                return None
            self.told.add(root)
        return {"status": "done", "project_path": root, **result}

    def rag_status(self, path: str) -> dict:
        return self.index_of(path).status()

    def rag_watch(self, path: str) -> dict:
        root = os.path.abspath(path)
        index = self.index_of(root)
        started = self.watchers.start(root, index.update, f"{index.directory}-watch")
        return {"watching": root, "newly_started": started}

    # ------------------------------------------------------------ search

    def rag_search(self, query: str, path: str, top_k: int = 10, path_filter: str | None = None, language: str | None = None) -> dict:
        index = self.index_of(path)
        if not index.exists:
            return {"results": []}
        return {"results": rows(self._search(index, query, top_k, path_filter, language).orderBy(F.desc("score"), "id"))}

    def _search(self, index: Index, query: str, top_k: int, path_filter: str | None = None, language: str | None = None) -> DataFrame:
        vector = [float(x) for x in index.encoder(pd.Series([query]))[0]]
        hits = search.hybrid(index.table("chunks"), index.table("vectors"), query, vector, top_k, columns=COLUMNS, path_filter=path_filter, language=language, index=index.table("postings"), stats=index.table("doc_stats"))
        return search.enriched(search.shaped(search.hydrated(hits, index.table("chunks"))), index.table("calls"))

    def rag_source(self, chunk_id: int, path: str) -> dict:
        index = self.index_of(path)
        found = index.table("chunks").where(F.col("id") == chunk_id)
        paths = [r["file_path"] for r in found.select("file_path").collect()]
        if not paths:
            return {"error": "Chunk not found"}
        live = tree.files(self.spark, index.root).where(F.col("path").isin(*paths))
        return rows(tree.byte_slice(found, live).drop("content"))[0]

    # ------------------------------------------------------------ graph

    def rag_graph(self, name: str, path: str, direction: str = "both", depth: int = 1) -> dict:
        index = self.index_of(path)
        if not index.exists:
            return {"error": "Project not indexed"}
        out: dict = {"name": name, "direction": direction}
        if direction in ("callers", "both"):
            out["callers"] = rows(graph.callers(index.table("calls"), name, 30) if depth < 2 else graph.callers_within(index.table("calls"), name, depth, limit=30))
        if direction in ("callees", "both"):
            out["callees"] = rows(graph.callees(index.table("calls"), name=name))
        if direction == "importers":
            out["importers"] = rows(graph.importers(index.table("imports"), name))
        if direction == "hierarchy":
            found = rows(graph.hierarchy(index.table("inheritance"), name))
            out |= {"parents": [r for r in found if r["direction"] == "parent"], "children": [r for r in found if r["direction"] == "child"]}
        out["symbol"] = next(iter(rows(graph.symbol(index.table("symbols"), index.table("chunks"), name))), None)
        return out

    def rag_deadcode(self, path: str, path_filter: str | None = None, limit: int = 50) -> dict:
        index = self.index_of(path)
        if not index.exists:
            return {"error": "Project not indexed"}
        found = rows(graph.dead_code(index.table("symbols"), index.table("calls"), path_filter, limit))
        return {"dead_code": found, "count": len(found)}

    def rag_impact(self, name: str, path: str, max_depth: int = 10) -> dict:
        index = self.index_of(path)
        if not index.exists:
            return {"error": "Project not indexed"}
        out = rows(graph.impact(index.table("calls"), name, max_depth))[0]
        out["sample_chains"] = [r["chain"] for r in graph.sample_chains(index.table("calls"), name, max_depth).collect()]
        return out

    def rag_git_changes(self, path: str, since: str = "1 week ago", path_filter: str | None = None) -> dict:
        index = self.index_of(path)
        found = changes.parse_status(vcs.log(self.spark, index.root, since, path_filter)).persist()
        counts = {r["status"]: r["files"] for r in changes.by_status(found).collect()}
        files = {s: sorted(r["path"] for r in found.where(F.col("status") == s).select("path").distinct().collect()) for s in "MAD"}
        totals = rows(changes.line_totals(vcs.log(self.spark, index.root, since, kind="stat")))[0]
        hit = rows(changes.changed_symbols(found, index.table("symbols"))) if index.exists else []
        found.unpersist()
        return {"since": since, "modified": files["M"], "added": files["A"], "deleted": files["D"], "total": sum(counts.values()), **totals, "symbols": hit}

    # ------------------------------------------------------------ routing

    def code_search(self, query: str, path: str, top_k: int = 10, path_filter: str | None = None, language: str | None = None, wait: float | None = None) -> dict:
        state = self.ensure_index(path, wait)
        if state and state["status"] != "done":
            return state
        note = {"indexing": state} if state else {}
        if rows(workspace.is_monorepo(self._files(path)))[0]["is_monorepo"]:
            return self.search_workspace(query, path, top_k, path_filter=path_filter, language=language) | note
        return self.smart_search(query, path, top_k, path_filter, language) | note

    def smart_search(self, query: str, path: str, top_k: int = 10, path_filter: str | None = None, language: str | None = None) -> dict:
        asked = self.spark.createDataFrame([(query,)], "query string")
        route = routing.routed(asked).withColumn("in_path", routing.path_in_question(F.col("query"))).first()
        intent, name = route["intent"], route["symbol"]
        if intent == "deadcode":
            return {"intent": intent, **self.rag_deadcode(path, path_filter or route["in_path"])}
        if intent in ("callers", "callees", "importers", "hierarchy"):
            return {"intent": intent, **self.rag_graph(name, path, intent)}
        if intent == "impact":
            return {"intent": intent, **self.rag_impact(name, path)}
        if intent == "git_changes":
            return {"intent": intent, **self.rag_git_changes(path, route["since"], path_filter)}
        return {"intent": "search", **self.rag_search(query, path, top_k, path_filter, language)}

    # ------------------------------------------------------------ workspaces

    def _files(self, path: str) -> DataFrame:
        """(path, content) of the files that decide about projects."""
        near = tree.files(self.spark, os.path.abspath(path), content=False).where(F.size(F.split("path", "/")) <= 2).select("path")
        packages = tree.files(self.spark, os.path.abspath(path)).where(F.col("path").endswith("package.json") & (F.size(F.split("path", "/")) == 2))
        return near.join(packages.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")), "path", "left")

    def _workspace_file(self, path: str) -> str:
        return f"{store.of_project(f'{self.folder}/workspaces', path)}/workspace.json"

    def rag_projects(self, path: str) -> dict:
        """The saved list; detected, and saved, where there is none or it can't be read."""
        file = self._workspace_file(path)
        try:
            found = store.read_json(file)
        except ValueError:
            found = None
        if found is None:
            found = rows(workspace.detect(self._files(path), os.path.abspath(path)))
            store.write_json(file, found)
        return {"projects": found, "is_monorepo": rows(workspace.is_monorepo(self._files(path)))[0]["is_monorepo"]}

    def _listed(self, path: str) -> DataFrame:
        found = self.rag_projects(path)["projects"]
        return self.spark.createDataFrame([(p["name"], p["path"], p["type"], p["language"]) for p in found], workspace.PROJECT)

    def rag_projects_add(self, path: str, name: str, project_path: str, kind: str = "unknown", language: str = "unknown") -> dict:
        if not os.path.isdir(project_path):
            raise ValueError(f"Not a directory: {project_path}")
        kept = rows(workspace.with_project(self._listed(path), name, os.path.abspath(project_path), kind, language))
        store.write_json(self._workspace_file(path), kept)
        return {"projects": kept}

    def rag_projects_remove(self, path: str, name: str) -> dict:
        listed = self._listed(path)
        kept = rows(workspace.without_project(listed, name))
        found = listed.count() > len(kept)
        if found:
            store.write_json(self._workspace_file(path), kept)
        return {"removed": found, "projects": kept}

    def search_workspace(self, query: str, path: str, top_k: int = 10, project: str | None = None, path_filter: str | None = None, language: str | None = None) -> dict:
        """All chosen projects in one plan: each ranked and fused by itself, the best of all by score."""
        kind = self.spark.createDataFrame([(query,)], "query string").select(routing.project_type(F.col("query")).alias("t")).first()["t"]
        chosen = rows(workspace.chosen(self._listed(path), project, None if project else kind))
        parts = []
        for p in chosen:
            index = self.index_of(p["path"])
            if not index.exists:
                index.update()
            parts.append(self._search(index, query, top_k, path_filter, language).withColumns({"project": F.lit(p["name"]), "project_type": F.lit(p["type"])}))
        if not parts:
            return {"intent": "search", "results": [], "projects": []}
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df)
        return {"intent": "search", "results": rows(out.orderBy(F.desc("score"), "project", "id").limit(top_k)), "projects": [p["name"] for p in chosen]}
