"""Queries over all rows of their tables, against brute force on small fixtures."""

from lodestone.operators import graph, search
from lodestone.plans import bindings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def truncated(text, limit):
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    if limit <= 0 or len(text) <= limit:
        return text
    used = kept = 0
    while kept < len(lines) and used + len(lines[kept]) + 1 <= limit:
        used, kept = used + len(lines[kept]) + 1, kept + 1
    rest = len(lines) - kept
    return text if rest <= 0 else "\n".join(lines[:kept]) + f"\n... ({rest} more lines — use rag_source for full code)"


def test_truncation_of_long_texts_and_unknown_lengths(spark, tmp_path):
    texts = {1: "short", 2: "line of words\n" * 2000, 3: "x" * 25000, 4: "a\n" * 400, 5: None, 6: "first\n" + "y" * 30000 + "\nlast"}
    rows = [(k, t, "en", "s", None if k in (4, 5) else len(t)) for k, t in texts.items()]
    got = {r["doc_id"]: r["snippet"] for r in bindings.snippet_truncate(spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {k: truncated(t or "", 700) for k, t in texts.items()}


def responses(spark, folder, n, first_file="f"):
    """n documents of 1 to n lines, the longest of them in ``first_file``; 3 files otherwise."""
    return documents(spark, folder, [(k, "\n".join(["a line"] * (k + 1)), "en", first_file if k == n - 1 else f"f{k % 3}", 1) for k in range(n)])


def test_responses_are_made_of_all_documents(spark, tmp_path):
    d = responses(spark, tmp_path, 40)
    best = sorted(range(40), reverse=True)
    files = {k: "f" if k == 39 else f"f{k % 3}" for k in best}
    few = {k for k in best if sum(files[j] == files[k] for j in best if j > k) < 2}
    assert {r["id"] for r in bindings.dedup_per_file(spark, d).collect()} == few
    assert {r["id"] for r in bindings.snippet_budget(spark, d).collect()} == few
    sizes, total, want = {k: len(f'{{"id":{k},"file":"{files[k]}"}}') for k in best}, 0, set()
    for k in best:
        total += sizes[k]
        want |= {k} if total <= 3000 else set()
    assert {r["id"] for r in bindings.hard_cap_prefix(spark, d).collect()} == want


def test_a_first_result_beyond_the_cap_leaves_all_of_them(spark, tmp_path):
    assert bindings.hard_cap_prefix(spark, responses(spark, tmp_path, 1200, "f" * 4000)).count() == 1200


def test_the_cap_by_brute_force(spark):
    rows = [(k, float(k * 7 % 10), "x" * (k * 13 % 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, score double, snippet string")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    sizes = [len(f'{{"id":{k},"score":{s},"snippet":"{t}"}}') for k, s, t in order]
    for cap in (3, sizes[0] - 1, sizes[0], 100, 500, 10**9):
        want = [r[0] for i, r in enumerate(order) if sum(sizes[: i + 1]) <= cap or sizes[0] > cap]
        assert sorted(r["id"] for r in search.capped(df, cap).collect()) == sorted(want), cap


def test_projects_of_documents_of_any_id(spark, tmp_path):
    d = documents(spark, tmp_path, [(k, "t", "en", "s", 1) for k in (1000, 1001, 1002, 1003)])
    got = {tuple(r) for r in bindings.detect_projects(spark, d).collect()}
    assert got == {("proj1", "proj1", "backend", "csharp"), ("proj2", "proj2", "frontend", "typescript"), ("proj3", "proj3", "backend", "go"), ("proj4", "proj4", "backend", "unknown")}
    assert bindings.monorepo_check(spark, d).first()["projects"] == 4


def test_a_symbol_is_searched_in_the_whole_table(spark, tmp_path, monkeypatch):
    d = documents(spark, tmp_path, [(k, "t", "en", "s", 1) for k in (2000031, 2000021, 2000011, 2000012)])
    seen = []
    monkeypatch.setattr(bindings.graph, "symbol", lambda s, *rest, symbol=graph.symbol: seen.append(s.count()) or symbol(s, *rest))
    assert [r["name"] for r in bindings.symbol_lookup(spark, d).collect()] == ["odd"] and seen == [4]
    rows = [(k, "f", "function", "a.py", 1) for k in (9, 3, 5)]
    chunks = spark.createDataFrame([(k, k, k, "c") for k in (9, 3, 5)], "id long, start_line int, end_line int, content string")
    assert graph.symbol(spark.createDataFrame(rows, "chunk_id long, name string, kind string, file_path string, line int").coalesce(1), chunks, "f").first()["start_line"] == 3
