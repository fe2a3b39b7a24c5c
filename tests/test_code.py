import os

import pytest

from lodestone.operators import graph, incremental
from lodestone.parse.files import parse
from lodestone.sources.tree import ignore_rules, scan

SOURCES = {
    "a.kt": ("package x\nimport java.util.Date\n\nclass Store(val db: Db) : Base(db), Closer {\n    fun load(id: Int): Item {\n        // helper(1)\n        return convert(db.fetch(id))\n    }\n}\n\nfun convert(x: Any): Item {\n    val s = \"call(me)\"\n    return Item(x)\n}\n",
             {"Store": "class_declaration", "convert": "function_declaration"}, {"Store", "load", "convert"}, {("load", "convert"), ("load", "fetch"), ("convert", "Item")}, {("Date", "java.util.Date")}, {("Store", "Base", "extends"), ("Store", "Closer", "extends")}),
    "b.rb": ("require 'json'\nrequire_relative './lib/tool'\n\nmodule Shop\n  class Cart < Base\n    def total(x)\n      if x\n        sum(x)\n      end\n    end\n  end\nend\n",
             {"Shop": "module"}, {"Shop", "Cart", "total"}, {("total", "sum")}, {("json", "json"), ("tool", "./lib/tool")}, {("Cart", "Base", "extends")}),
    "c.c": ("#include <stdio.h>\n#include \"lib/u.h\"\n\nstruct P {\n  int a;\n};\n\nstatic int *find(int a) {\n  printf(\"{\");\n  return look(a);\n}\n",
            {"P": "struct_specifier", "find": "function_definition"}, {"find"}, {("find", "printf"), ("find", "look")}, {("stdio", "stdio.h"), ("u", "lib/u.h")}, set()),
    "d.php": ("<?php\n\nuse App\\Models\\User;\n\nclass Svc extends Core implements Runs {\n    public function go($x) {\n        return $this->load($x);\n    }\n}\n\nfunction top() {\n    $s = go(1);\n    return $s;\n}\n",
              {"Svc": "class_declaration", "top": "function_definition"}, {"Svc", "go", "top"}, {("go", "load"), ("top", "go")}, {("User", "App\\Models\\User")}, {("Svc", "Core", "extends"), ("Svc", "Runs", "implements")}),
    "e.ts": ("import { a, b as c } from './m';\nimport d from \"n\";\n\ninterface Shape extends Base {\n  side: number;\n}\n\nexport class Box extends Item<string> implements Shape, Other {\n  area(x: number): number {\n    return mul(x, this.side());\n  }\n}\n\nconst f = (x: number) => {\n  const y = a(x);\n  return y;\n};\n",
             {"Shape": "interface_declaration", "Box": "class_declaration", "f": "arrow_function"}, {"Shape", "Box", "area", "f"}, {("area", "mul"), ("area", "side"), ("f", "a")}, {("a", "./m"), ("b", "./m"), ("d", "n")},
             {("Shape", "Base", "extends"), ("Box", "Item", "extends"), ("Box", "Shape", "implements"), ("Box", "Other", "implements")}),
    "f.go": ("package m\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Run(n int) error {\n\tfmt.Println(n)\n\treturn work(n)\n}\n\nfunc work(n int) error {\n\tvar e error\n\treturn e\n}\n",
             {"T": "type_declaration", "Run": "method_declaration", "work": "function_declaration"}, {"Run", "work"}, {("Run", "Println"), ("Run", "work")}, {("fmt", "fmt"), ("b", "a/b")}, set()),
    "g.rs": ("use std::fmt::Display;\n\nstruct S {\n    a: i32,\n}\n\nimpl Shape for S {\n    fn area(&self) -> i32 {\n        mul(self.a)\n    }\n}\n\nfn mul(a: i32) -> i32 {\n    let b = 2;\n    a * b\n}\n",
             {"S": "impl_item", "mul": "function_item"}, {"S", "area", "mul"}, {("area", "mul")}, {("Display", "std::fmt::Display")}, {("S", "Shape", "implements")}),
    "h.java": ("package p;\nimport java.util.List;\n\npublic class A extends B implements C, D {\n    public int run(List<String> x) throws E {\n        return help(x);\n    }\n}\n",
               {"A": "class_declaration"}, {"A", "run"}, {("run", "help")}, {("List", "java.util.List")}, {("A", "B", "extends"), ("A", "C", "implements"), ("A", "D", "implements")}),
    "i.cs": ("using System.Text;\n\nnamespace N\n{\n    public class A : B, IRun\n    {\n        public int Go(int x)\n        {\n            return Help(x);\n        }\n    }\n}\n",
             {"A": "class_declaration"}, {"A", "Go"}, {("Go", "Help")}, {("Text", "System.Text")}, {("A", "B", "extends"), ("A", "IRun", "implements")}),
    "j.swift": ("import UIKit\n\nclass V: Base, Proto {\n    func show(x: Int) -> Int {\n        return draw(x)\n    }\n}\n", {"V": "class_declaration"}, {"V", "show"}, {("show", "draw")}, {("UIKit", "UIKit")}, {("V", "Base", "extends"), ("V", "Proto", "extends")}),
    "k.scala": ("import a.b.C\n\nobject O extends Base with Mix {\n  def run(x: Int): Int = {\n    help(x)\n  }\n}\n", {"O": "object_definition"}, {"O", "run"}, {("run", "help")}, {("C", "a.b.C")}, {("O", "Base", "extends"), ("O", "Mix", "extends")}),
    "l.cpp": ("#include <vector>\n\nclass A : public B {\n public:\n  int run(int x) {\n    return help(x);\n  }\n};\n\nint A::other(int y) {\n  int z = help(y);\n  return z;\n}\n",
              {"A": "class_specifier", "other": "function_definition"}, {"A", "run", "other"}, {("run", "help"), ("other", "help")}, {("vector", "vector")}, {("A", "B", "extends")}),
    "m.js": ("const u = require('util');\n\nfunction go(a) {\n  return u.fmt(a); // skip(x)\n}\n\nclass K extends L {\n  run() {\n    return go(1);\n  }\n}\n", {"go": "function_declaration", "K": "class_declaration"}, {"go", "K", "run"}, {("go", "fmt"), ("run", "go")}, {("util", "util")}, {("K", "L", "extends")}),
    "n.py": ("import os.path\nfrom m import a as b, c\nfrom . import d\n\n\n@deco\ndef f(x):\n    return g(os.path.join(x))\n\n\nclass K(Base, object, m.Other):\n    def run(self):\n        \"\"\"é\"\"\"\n        return self.f(x)\n",
             {"f": "decorated_definition", "K": "class_definition"}, {"f", "K", "run"}, {("f", "g"), ("f", "join"), ("run", "f")}, {("path", "os.path"), ("a", "m"), ("c", "m"), ("d", ".")}, {("K", "Base", "extends"), ("K", "m.Other", "extends")}),
}
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", SOURCES)
def test_languages(name):
    text, chunks, symbols, calls, imports, bases = SOURCES[name]
    rows = parse(name, text)
    tagged = lambda t: [r for r in rows if r["tag"] == t]
    found = {r["name"]: r["kind"] for r in tagged("chunk") if r["kind"] not in ("file_header", "namespace_definition")}
    assert chunks.items() <= found.items()
    assert {r["name"] for r in tagged("symbol")} == symbols
    assert calls <= {(r["name"], r["other"]) for r in tagged("call")}
    assert not {"skip", "helper", "me"} & {r["other"] for r in tagged("call")}
    assert {(r["name"], r["other"]) for r in tagged("import")} == imports
    assert {(r["name"], r["other"], r["kind"]) for r in tagged("base")} == bases
    for r in tagged("chunk"):
        if r["byte_end"]:
            assert text.encode()[r["byte_start"] : r["byte_end"]].decode() == r["content"]


def test_unknown_and_broken_files_fall_back_to_windows():
    rows = parse("notes.txt", "one\ntwo\n")
    assert [(r["kind"], r["start_line"], r["end_line"], r["language"]) for r in rows] == [("block", 1, 2, "text")]
    assert [r["kind"] for r in parse("bad.py", "def f(:\n  x\n")] == ["block"] and parse("empty.py", "") == []


def test_scan(spark, tmp_path):
    files = {"a.py": b"x = 1\n", "_b.py": b"y = 1\n", "bad.py": b"\xff\xfe ok", "build/c.py": b"", "lib/x.min.js": b"", "lib/ok.js": b"1", "go.sum": b"", "big.py": b"x" * 1_000_001, "log/one.py": b"", "log/keep.py": b"1", "deep/t.tmp": b""}
    for name, data in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r["text"] for r in scan(spark, str(tmp_path), "log/*\n!log/keep.py\n*.tmp\n# note\n").collect()}
    assert got == {"a.py": "x = 1\n", "_b.py": "y = 1\n", "bad.py": "�� ok", "lib/ok.js": "1", "log/keep.py": "1"}


def test_ignore_rules():
    import re

    def ignored(path, text):
        out = False
        for pattern, flag in ignore_rules(text):
            if re.match(pattern, path):
                out = flag
        return out

    assert ignored("a/b/x.pyc", "*.pyc") and ignored("d/x", "d/") and not ignored("d", "d/") and ignored("a/d/x", "d/")
    assert ignored("top/x", "/top") and not ignored("a/top", "/top") and ignored("a/b/c", "a/**/c") and ignored("a/c", "a/**/c")
    assert not ignored("k.log", "*.log\n!k.log") and ignored("x1", "x[0-9]") and not ignored("xa", "x[!a]") and ignored("#h", "\\#h") and ignored("a/b", "a/**")


CALLS = [("process", "helper", 6, "a.py"), ("main", "process", 2, "b.py"), ("main", "helper", 2, "b.py"), (None, "process", 9, "b.py")]
CHAIN = [("validate", "format_date", 1, "helper.py"), ("process", "validate", 1, "service.py"), ("api_handler", "process", 1, "endpoint.py"), ("test_process", "process", 1, "tests/test_service.py")]
CALL = "caller_name string, callee_name string, line int, file_path string"


def test_graph_lookups(spark):
    calls = spark.createDataFrame(CALLS, CALL)
    symbols = spark.createDataFrame([("helper", "function", "a.py", 1), ("process", "function", "a.py", 5), ("unused_fn", "function", "a.py", 12), ("main", "function", "b.py", 1), ("K", "class", "b.py", 3)], "name string, kind string, file_path string, line int")
    assert [r["caller"] for r in graph.callers(calls, "helper").collect()] == ["process", "main"]
    assert [r["caller"] for r in graph.callers(calls, "process").collect()] == ["main", "(top-level)"]
    assert [r["callee"] for r in graph.callees(calls, name="main").collect()] == ["helper", "process"]
    assert [r["name"] for r in graph.dead_code(symbols, calls).collect()] == ["unused_fn"]
    assert {(r["hop"], r["caller"]) for r in graph.callers_within(calls, "helper", 2).collect()} == {(1, "process"), (1, "main"), (2, "main"), (2, "(top-level)")}


def test_impact(spark):
    calls = spark.createDataFrame(CHAIN, CALL)
    one = graph.impact(calls, "format_date").first()
    assert (one["direct_callers"], one["transitive_callers"], one["risk"]) == (1, 4, "medium")
    assert one["affected_files"] == ["endpoint.py", "helper.py", "service.py", "tests/test_service.py"] and one["affected_tests"] == ["test_process"]
    none = graph.impact(calls, "api_handler").first()
    assert (none["direct_callers"], none["transitive_callers"], none["risk"], none["affected_files"]) == (0, 0, "low", [])
    cycle = spark.createDataFrame([("a", "b", 1, "f"), ("b", "a", 1, "f")] + [(f"n{i + 1}", f"n{i}", 1, "f") for i in range(15)] + [(None, "n2", 1, "g")], CALL)
    edges = cycle.selectExpr("callee_name AS `to`", "caller_name AS `from`")
    assert {(r["name"], r["depth"]) for r in graph.closure(edges, "a").collect()} == {("b", 1)}
    assert {r["name"] for r in graph.closure(edges, "n0").collect()} == {f"n{i}" for i in range(1, 11)}
    assert ["n0", "n1", "n2", "(top-level)"] in [r["chain"] for r in graph.sample_chains(cycle, "n0").collect()]


def test_incremental(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None)], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("e", "9")], "path string, hash string")
    assert {(r["path"], r["status"]) for r in incremental.diff(now, was).collect()} == {("a", "same"), ("b", "changed"), ("c", "same"), ("d", "removed"), ("e", "added")}
    assert incremental.summary(now, was).first().asDict() == {"indexed": 2, "skipped": 2, "removed": 1}
    assert {r["path"] for r in incremental.needs_update(now, was).collect()} == {"b", "e"} and [r["path"] for r in incremental.removed(now, was).collect()] == ["d"]


def test_excluded_files_are_not_opened(spark, tmp_path):
    """The lister leaves out what the filter on rows would drop, so nothing reads it."""
    from lodestone.sources.tree import MAX_FILE_BYTES, TreeReader, allowed, files, scan

    names = ["a.py", "node_modules/x.py", "b.PNG", "lib/c.min.js", "d.js", ".env", ".lock", "noext", "dist", "e/build/f.ts", "big.py"]
    for n in names:
        at = tmp_path / n
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * (MAX_FILE_BYTES + 1 if n == "big.py" else 3))
    want = sorted(r["path"] for r in files(spark, str(tmp_path), content=False).where(allowed(F.col("path"), F.col("length"))).collect())
    assert sorted(row[1] for part in TreeReader(str(tmp_path), True, False).partitions() for row in part.value) == want
    assert sorted(r["path"] for r in scan(spark, str(tmp_path)).collect()) == want and "a.py" in want and "big.py" not in want
