import os
import subprocess

import pytest

from lodestone.engine import Engine
from lodestone.functions.vectors import hashing_encoder

MAIN = '''
import utils
from utils import handle_error as h


def greet(name):
    """Says hello."""
    return handle_error(name)


class Calculator:
    def multiply(self, a, b):
        return add(a, b)

    def divide(self, a, b):
        return a / b


def add(a, b):
    total = a + b
    return total
'''
UTILS = '''import logging


def handle_error(error):
    logging.error(error)
    return validate_email(error)


def validate_email(text):
    found = "@" in text
    return found


class Special(dict):
    pass
'''


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "code"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "main.py").write_text(MAIN)
    (root / "pkg" / "__init__.py").write_text("VALUE = 1\nOTHER = 2\nTHIRD = 3\n")
    (root / "utils.py").write_text(UTILS)
    (root / "node_modules" / "x.py").write_text(MAIN)
    (root / "skip.py").write_text(MAIN)
    (root / ".gitignore").write_text("skip.py\n*.pyc\n")
    return str(root)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "data"), hashing_encoder(64))


def test_index_search_graph(engine, project):
    assert engine.rag_status(project)["status"] == "not_indexed"
    assert engine.rag_search("x", project) == {"results": []}
    first = engine.rag_index(project)
    assert (first["indexed"], first["skipped"], first["removed"]) == (4, 0, 0)  # with the ignore file itself
    assert engine.rag_index(project)["indexed"] == 0 and engine.rag_index(project)["skipped"] == 4
    found = engine.rag_search("validate email", project, top_k=3)["results"]
    assert found[0]["name"] == "validate_email" and found[0]["callers"] == ["handle_error"]
    assert not engine.rag_search("email", project, path_filter="nothing")["results"]
    callers = engine.rag_graph("handle_error", project)["callers"]
    assert [c["caller"] for c in callers] == ["greet"]
    assert {c["callee"] for c in engine.rag_graph("handle_error", project, "callees")["callees"]} == {"error", "validate_email"}
    assert engine.rag_graph("utils", project, "importers")["importers"][0]["file"] == "main.py"
    assert engine.rag_graph("Special", project, "hierarchy")["parents"][0]["name"] == "dict"
    dead = {r["name"] for r in engine.rag_deadcode(project)["dead_code"]}
    assert dead == {"greet", "multiply", "divide"}
    assert engine.rag_impact("validate_email", project)["transitive_callers"] == 2
    chunk = next(r for r in found if r["name"] == "validate_email")
    assert engine.rag_source(chunk["id"], project)["source"].startswith("def validate_email(text):")
    assert engine.rag_source(1, project) == {"error": "Chunk not found"}
    asked = engine.code_search("who calls 'handle_error'?", project)
    assert asked["intent"] == "callers" and asked["callers"][0]["caller"] == "greet"
    assert engine.code_search("find dead code", project)["count"] == 3
    assert engine.code_search("handle failures", project)["intent"] == "search"

    os.remove(f"{project}/utils.py")
    with open(f"{project}/main.py", "a") as f:
        f.write("\n\ndef later():\n    x = 1\n    return x\n")
    third = engine.rag_index(project)
    assert (third["indexed"], third["skipped"], third["removed"]) == (1, 2, 1)
    status = engine.rag_status(project)
    assert status["total_files"] == 3 and status["vector_count"] == status["total_chunks"]
    assert not engine.rag_graph("validate_email", project, "callers")["callers"]
    with pytest.raises(ValueError, match="Not a directory"):
        engine.rag_index(project + "/none")


def test_ensure_index_tells_once_and_bounds_the_wait(engine, project):
    assert engine.ensure_index(project, 0.0)["status"] == "in_progress"
    assert engine.ensure_index(project, 120)["status"] == "done"
    assert engine.ensure_index(project) is None


def test_git_changes(engine, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@example.org", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    (root / "a.py").write_text("def one():\n    x = 1\n    return x\n")
    (root / "b.py").write_text("y = 1\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (root / "a.py").write_text("def one():\n    x = 2\n    return x\n")
    (root / "b.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "second")
    engine.rag_index(str(root))
    out = engine.rag_git_changes(str(root))
    assert out["modified"] == ["a.py"] and out["added"] == ["a.py", "b.py"] and out["deleted"] == ["b.py"] and out["total"] == 4
    assert (out["insertions"], out["deletions"]) == (5, 2)
    assert [(s["name"], s["change"]) for s in out["symbols"]] == [("one", "modified")]


def test_workspace(engine, tmp_path):
    root = tmp_path / "mono"
    for d in ("api-core", "web-app", "shared-lib", ".hidden"):
        (root / d).mkdir(parents=True)
    (root / "api-core" / "api.csproj").write_text("<x/>")
    (root / "web-app" / "package.json").write_text('{"dependencies": {"next": "1", "react": "1"}}')
    (root / "web-app" / "page.ts").write_text("export function render(a: string): string {\n  const b = a;\n  return b;\n}\n")
    (root / "shared-lib" / "pyproject.toml").write_text("")
    (root / "shared-lib" / "lib.py").write_text("def render(a):\n    b = a\n    return b\n")
    (root / ".hidden" / "go.mod").write_text("")
    found = engine.rag_projects(str(root))
    assert found["is_monorepo"] and {(p["name"], p["type"], p["language"]) for p in found["projects"]} == {("api-core", "backend", "csharp"), ("web-app", "frontend", "typescript"), ("shared-lib", "backend", "python")}
    out = engine.search_workspace("render", str(root))
    assert {r["project"] for r in out["results"] if r["name"] == "render"} == {"web-app", "shared-lib"}
    assert {r["project"] for r in engine.search_workspace("render the button component", str(root))["results"]} == {"web-app"}
    assert engine.search_workspace("render", str(root), project="nope")["results"] == []
    assert engine.rag_projects_remove(str(root), "api-core")["removed"] and not engine.rag_projects_remove(str(root), "api-core")["removed"]
    added = engine.rag_projects_add(str(root), "extra", str(root / "api-core"), "library")
    assert {p["name"] for p in added["projects"]} == {"web-app", "shared-lib", "extra"}
    with pytest.raises(ValueError):
        engine.rag_projects_add(str(root), "bad", str(root / "missing"))


def test_stored_postings_follow_the_files(engine, project):
    from lodestone.index import COLUMNS
    from lodestone.operators import search

    steps = []
    engine.rag_index(project, progress=lambda done, of, message: steps.append((done, of)))
    assert steps == [(k, 4) for k in range(1, 5)]
    with open(os.path.join(project, "utils.py"), "a") as f:
        f.write("\n\ndef validated(emails):\n    return [validate_email(e) for e in emails]\n")
    os.remove(os.path.join(project, "pkg", "__init__.py"))
    engine.rag_index(project)
    index = engine.index_of(project)
    chunks = index.table("chunks")
    for question in ("validate email", "handle_error", "multiply"):
        scores = [
            sorted((r["id"], round(r["score"], 9)) for r in search.bm25(chunks, COLUMNS, question, 20, stem=True, **more).collect())
            for more in ({}, {"index": index.table("postings"), "stats": index.table("doc_stats")})
        ]
        assert scores[0] == scores[1] and scores[0]
    assert index.table("doc_stats").count() == chunks.count()


def test_the_store_is_in_the_warehouse_or_where_the_session_says(spark):
    from lodestone import store

    assert store.default(spark) == spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/lodestone"
    try:
        spark.conf.set(store.CONF, "s3://bucket/place/")
        assert store.default(spark) == "s3://bucket/place"
    finally:
        spark.conf.unset(store.CONF)
