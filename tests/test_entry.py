import ast
import pathlib

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry_and_every_query_run_on_the_smallest_tables(spark):
    assert entry.entry(spark).count() == 10
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys()
    for name in queries:
        if not name.startswith(("op", "pipeline")):
            df = queries[name](spark, SMALL)
            assert df.count() >= 0 and len(set(df.columns)) == len(df.columns), name


def test_only_the_entry_module_knows_the_training_data_subpackage():
    root = pathlib.Path(entry.__file__).parent
    for path in (root / "lodestone").rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
