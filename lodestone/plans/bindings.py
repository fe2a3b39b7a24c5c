"""Every operator bound to the star-schema and document tables, with the same result in SQL.

Documents are chunks (file_path: source, language: lang), their ids carry the vectors, foreign keys of the star schema are the code graph
(a key refers to, so calls, the row that it names), page links are imports, and events are changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import file_header, split_lines, truncate, windows
from ..functions.text import sanitize
from ..operators import changes, graph, incremental, routing, search, workspace
from ..settings import EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, EXCLUDED_NAMES, HEADER_PREFIXES
from ..sources.tree import allowed, ignore_rules, ignored, watched
from ..streaming.watch import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.lit(1).alias("start_line"), n.alias("end_line"), F.lit("block").alias("chunk_type"), F.col("lang").alias("language"), F.col("text").alias("content"),
    )


CHUNKS_SQL = "chunks AS (SELECT doc_id AS id, source AS file_path, 'doc_' || doc_id AS name, 1 AS start_line, len(string_split(coalesce(text, ''), chr(10)))::INT AS end_line, 'block' AS chunk_type, lang AS language, text AS content FROM documents)"

# ---------------------------------------------------------------- scans and filters


@query(
    f"""
WITH f AS (
  SELECT doc_id, n_chars * 400 AS size, ['src', 'node_modules', '.git', 'lib', 'bin'][doc_id % 5 + 1] AS dir,
         'f' || doc_id || ['.py', '.min.js', '.JSON', '.png', '.go', '.ts', '.woff2', ''][doc_id % 8 + 1] AS base, source FROM documents
), p AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'go.sum' ELSE base END AS name FROM f)
SELECT source || '/' || dir || '/' || name AS path, size FROM p
WHERE NOT list_has_any([source, dir, name], [{quoted(EXCLUDED_DIRS)}]) AND lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) NOT IN ({quoted(EXCLUDED_EXTENSIONS)})
  AND name NOT IN ({quoted(EXCLUDED_NAMES)}) AND NOT regexp_matches(name, '({"|".join(e.replace(".", "[.]") for e in EXCLUDED_EXTENSIONS if len(e) > 4)})$') AND size <= 1000000
"""
)
def scan_filter(spark, d):
    docs = table(spark, d, "documents")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % n + 1).cast("int"))
    name = F.when(F.col("doc_id") % 50 == 0, "go.sum").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), pick([".py", ".min.js", ".JSON", ".png", ".go", ".ts", ".woff2", ""], 8)))
    found = docs.select(F.concat_ws("/", "source", pick(["src", "node_modules", ".git", "lib", "bin"], 5), name).alias("path"), (F.col("n_chars") * 400).alias("size"))
    return found.where(allowed(F.col("path"), F.col("size")))


@query(f"WITH {CHUNKS_SQL} SELECT id, file_path, language FROM chunks WHERE file_path ILIKE '%SRC1%' AND language = 'en'")
def path_language_filter(spark, d):
    return search.matching(chunks(spark, d), "SRC1", "en").select("id", "file_path", "language")


@query(
    """
WITH l AS (SELECT doc_id, CASE WHEN text[-1] = chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, lines, unnest(range(0, greatest(0, ceil((len(lines) - 6) / 4.0)::INT) * 4 + 1, 4)) AS st FROM l WHERE len(lines) > 0),
b AS (SELECT doc_id, (st + 1)::INT AS start_line, least(st + 6, len(lines))::INT AS end_line, array_to_string(lines[st + 1:least(st + 6, len(lines))], chr(10)) AS block FROM w)
SELECT doc_id, start_line, end_line, sha256(block) AS block_hash FROM b WHERE regexp_matches(block, '\\S')
"""
)
def sliding_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return windows(docs, "text", 6, 2).select("doc_id", "start_line", "end_line", F.sha2("block", 256).alias("block_hash"))


@query(
    """
WITH c AS (SELECT doc_id, ['function', 'class', 'block', 'file_header'][doc_id % 4 + 1] AS chunk_type, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, chunk_type, n::INT AS n_lines FROM c WHERE chunk_type IN ('file_header', 'block') OR n >= 3
"""
)
def tiny_chunk_filter(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("function", "class", "block", "file_header"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", kind.alias("chunk_type"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return rows.where(F.col("chunk_type").isin("file_header", "block") | (F.col("n_lines") >= 3))


@query(
    f"""
WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'import a' || doc_id || chr(10) || '# note' || chr(10) || chr(10) || text WHEN 1 THEN '  // x' || chr(10) || text ELSE text END AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10))[:30], lambda x: {{'line': x, 's': trim(x, ' ' || chr(9) || chr(13))}}) AS lines FROM c),
f AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: x.s = '' OR list_bool_or(list_transform([{quoted(HEADER_PREFIXES)}], lambda p: starts_with(x.s, p)))), false) AS stop FROM l),
h AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(CASE WHEN stop > 0 THEN lines[:stop - 1] ELSE lines END, lambda x: x.line), chr(10)), '^\\s+|\\s+$', '', 'g') AS header FROM f)
SELECT doc_id, nullif(header, '') AS header FROM h
"""
)
def file_headers(spark, d):
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('import a', doc_id, '\\n# note\\n\\n', text) WHEN 1 THEN concat('  // x\\n', text) ELSE text END")
    return table(spark, d, "documents").select("doc_id", file_header(text).alias("header"))


TRUNCATE_SQL = """
lined AS (SELECT *, CASE WHEN body[-1] = chr(10) OR body = '' THEN string_split(body, chr(10))[:-2] ELSE string_split(body, chr(10)) END AS lines FROM src),
kept AS (SELECT *, len(list_filter(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)) <= lim)) AS fits FROM lined),
cut AS (SELECT *, CASE WHEN lim <= 0 OR length(body) <= lim OR len(lines) <= fits THEN body ELSE array_to_string(lines[1:fits], chr(10)) || chr(10) || '... (' || (len(lines) - fits) || ' more lines — use rag_source for full code)' END AS snippet FROM kept)
"""


@query(f"WITH src AS (SELECT doc_id, coalesce(text, '') AS body, 700 AS lim FROM documents), {TRUNCATE_SQL} SELECT doc_id, snippet FROM cut")
def snippet_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate(F.coalesce("text", F.lit("")), 700).alias("snippet"))


# ---------------------------------------------------------------- incremental maintenance

VERSIONS_SQL = """
was AS (SELECT 'd' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
now AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
"""


def _versions(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    was = docs.where("doc_id % 13 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return now, was


@query(f"WITH {VERSIONS_SQL} SELECT n.path, n.hash FROM now n LEFT JOIN was w USING (path) WHERE n.hash IS DISTINCT FROM w.hash")
def hash_diff_changed(spark, d):
    return incremental.needs_update(*_versions(spark, d))


@query(f"WITH {VERSIONS_SQL} SELECT path FROM was WHERE path NOT IN (SELECT path FROM now)")
def hash_diff_removed(spark, d):
    return incremental.removed(*_versions(spark, d))


@query(
    f"""WITH {VERSIONS_SQL}, b AS (SELECT n.path AS np, w.path AS wp, n.hash AS nh, w.hash AS wh FROM now n FULL JOIN was w USING (path))
SELECT count(*) FILTER (wp IS NULL OR (np IS NOT NULL AND nh IS DISTINCT FROM wh)) AS indexed, count(*) FILTER (np IS NOT NULL AND wp IS NOT NULL AND nh IS NOT DISTINCT FROM wh) AS skipped,
       count(*) FILTER (np IS NULL) AS removed FROM b"""
)
def hash_diff_summary(spark, d):
    return incremental.summary(*_versions(spark, d))


# ---------------------------------------------------------------- vectors and keywords


def _query_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.where("vec_id = 0").select("embedding").first()[0])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


COSINE_SQL = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT vec_id AS id, label, list_inner_product(embedding::DOUBLE[], q.v) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q.v, q.v)) AS score FROM embeddings, q)
"""


@query(f"WITH {COSINE_SQL} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20")
def vector_topk(spark, d):
    v = _vectors(spark, d)
    return search.vector_topk(v, _query_vector(v), 20, id_col="vec_id").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {COSINE_SQL} SELECT id, round(score, 6) AS score FROM scored WHERE label IN (1, 2) ORDER BY scored.score DESC, id LIMIT 20")
def vector_topk_filtered(spark, d):
    v = _vectors(spark, d)
    allowed = v.where("label IN (1, 2)").select(F.col("vec_id").alias("id"))
    return search.vector_topk(v, _query_vector(v), 20, id_col="vec_id", allowed=allowed).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {COSINE_SQL}, top AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20) SELECT t.id, round(t.score, 6) AS score, d.source AS file, d.lang AS language FROM top t JOIN documents d ON d.doc_id = t.id")
def vector_legacy_search(spark, d):
    v = _vectors(spark, d)
    hits = search.vector_topk(v, _query_vector(v), 20, id_col="vec_id")
    return search.hydrated(hits, chunks(spark, d)).select("id", F.round("score", 6).alias("score"), "file", "language")


@query(
    r"""
WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')), lambda x: x <> '') AS words FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(words, lambda x: '"' || x || '"'), ' OR '), '') AS query FROM w
"""
)
def query_sanitize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sanitize(F.col("text")).alias("query"))


def bm25_sql(phrases: list[list[str]], where: str = "true") -> str:
    """BM25 of phrases of one or two words over content and file_path, over all documents; ranked rows of ids that fit ``where``."""
    parts = []
    for k, p in enumerate(phrases):
        follow = "" if len(p) == 1 else f" JOIN tokens b ON b.id = a.id AND b.col = a.col AND b.pos = a.pos + 1 AND b.term = '{p[1]}'"
        parts.append(f"SELECT {k} AS phrase, a.id, count(*) AS f FROM tokens a{follow} WHERE a.term = '{p[0]}' GROUP BY a.id")
    return f"""
{CHUNKS_SQL},
lists AS (SELECT id, 0 AS col, regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+') AS terms FROM chunks UNION ALL SELECT id, 1, regexp_extract_all(lower(coalesce(file_path, '')), '[\\p{{L}}\\p{{N}}]+') FROM chunks),
tokens AS (SELECT id, col, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM lists),
stats AS (SELECT id, sum(len(terms)) AS dl FROM lists GROUP BY id),
total AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM stats),
f AS ({" UNION ALL ".join(parts)}),
df AS (SELECT phrase, count(*) AS n FROM f GROUP BY phrase),
bm AS (SELECT f.id, sum(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM f JOIN df USING (phrase) JOIN stats USING (id), total WHERE f.id IN (SELECT id FROM chunks WHERE {where}) GROUP BY f.id)"""


BM_COLUMNS = ["content", "file_path"]
WORDS = "the onou ersh of the"
WORD_LIST = [["the"], ["onou"], ["ersh"], ["of"], ["the"]]


@query(f"WITH {bm25_sql(WORD_LIST)} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return search.bm25(chunks(spark, d), BM_COLUMNS, WORDS, 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(WORD_LIST, "language = 'en' AND file_path ILIKE '%src1%'")} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def bm25_topk_filtered(spark, d):
    c = chunks(spark, d)
    return search.bm25(c, BM_COLUMNS, WORDS, 20, allowed=search.matching(c, "src1", "en")).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql([['of', 'the'], ['that']])} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, id LIMIT 20")
def bm25_phrase(spark, d):
    return search.bm25(chunks(spark, d), BM_COLUMNS, "of_the that", 20).select("id", F.round("score", 6).alias("score"))


@query()
def bm25_stemmed(spark, d):
    return search.bm25(chunks(spark, d), BM_COLUMNS, "thing hands", 20, stem=True).select("id", F.round("score", 6).alias("score"))


def hybrid_sql(where: str = "true", k: int = 10) -> str:
    return f"""{bm25_sql(WORD_LIST, where)}, {COSINE_SQL.strip()},
vec AS (SELECT s.id, row_number() OVER (ORDER BY round(s.score, 9) DESC, s.id) AS r FROM scored s WHERE s.id IN (SELECT id FROM chunks WHERE {where}) OR {where == "true"} QUALIFY r <= {3 * k}),
kw AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm QUALIFY r <= {3 * k}),
fused AS (SELECT id, round(coalesce(1.0 / (60 + vec.r), 0) + coalesce(1.0 / (60 + kw.r), 0), 6)::DOUBLE AS score FROM vec FULL JOIN kw USING (id)),
best AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT {k})"""


def _hybrid(spark, d, k=10, **filters):
    v = _vectors(spark, d).withColumnRenamed("vec_id", "id")
    q = list(v.where("id = 0").select("embedding").first()[0])
    return search.hybrid(chunks(spark, d), v, WORDS, q, k, columns=BM_COLUMNS, stem=False, **filters)


@query(f"WITH {hybrid_sql()} SELECT id, score FROM best")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d)


HYBRID_FILTER = "language = 'en' AND file_path ILIKE '%src1%'"


@query(f"WITH {hybrid_sql(HYBRID_FILTER)} SELECT id, score FROM best")
def hybrid_rrf_filtered(spark, d):
    return _hybrid(spark, d, path_filter="src1", language="en")


# ---------------------------------------------------------------- responses

RESULTS_SQL = f"{CHUNKS_SQL}, results AS (SELECT id, (end_line / 100.0)::DOUBLE AS score, file_path AS file, name, language, content AS snippet FROM chunks)"


def _results(spark, d):
    return chunks(spark, d).select("id", (F.col("end_line") / 100.0).alias("score"), F.col("file_path").alias("file"), "name", "language", F.col("content").alias("snippet"))


@query(f"WITH {RESULTS_SQL} SELECT id, score, file FROM results QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, id) <= 2")
def dedup_per_file(spark, d):
    return search.per_file(_results(spark, d)).select("id", "score", "file")


@query(
    f"""WITH {RESULTS_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS n FROM results),
few AS (SELECT * FROM one WHERE n <= 2), sums AS (SELECT sum(length(snippet)) AS total, greatest(15000 // count(*), 200) AS lim FROM few),
src AS (SELECT few.*, snippet AS body, total, lim FROM few, sums),
{TRUNCATE_SQL.replace("lim <= 0 OR", "total <= 15000 OR lim <= 0 OR").replace("SELECT *, CASE WHEN total", "SELECT * EXCLUDE (snippet), CASE WHEN total")}
SELECT id, score, file, length(snippet)::INT AS snippet_chars, sha256(snippet) AS snippet_hash FROM cut"""
)
def snippet_budget(spark, d):
    out = search.shaped(_results(spark, d), cap=10**9)
    return out.select("id", "score", "file", F.length("snippet").alias("snippet_chars"), F.sha2("snippet", 256).alias("snippet_hash"))


@query(
    f"""WITH {RESULTS_SQL}, s AS (SELECT id, score, file, length(to_json({{'id': id, 'file': file}})) AS size FROM results),
r AS (SELECT *, sum(size) OVER w AS running, first(size) OVER w AS head FROM s WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))
SELECT id, file FROM r WHERE running <= 3000 OR head > 3000"""
)
def hard_cap_prefix(spark, d):
    return search.capped(_results(spark, d).select("id", "file", "score"), 3000, ["id", "file"]).select("id", "file")


def _document_calls(spark, d):
    """Each document calls the three after it."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    callee = F.explode(F.array(*(F.col("doc_id") + k for k in (1, 2, 3))))
    rows = docs.select("doc_id", "source", callee.alias("to"))
    return rows.select(F.col("doc_id").alias("caller_chunk_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("caller_name"), F.concat(F.lit("doc_"), F.col("to").cast("string")).alias("callee_name"), (F.col("to") - F.col("doc_id")).cast("int").alias("line"), F.col("source").alias("file_path"))


@query(
    f"""WITH {hybrid_sql()}, calls AS (SELECT doc_id AS caller_chunk_id, 'doc_' || doc_id AS caller_name, 'doc_' || (doc_id + k) AS callee_name, k AS line, source AS file_path FROM documents, (SELECT unnest([1, 2, 3]) AS k)),
few AS (SELECT id, 'doc_' || id AS name FROM best JOIN chunks USING (id) ORDER BY best.score DESC, id LIMIT 5),
up AS (SELECT f.id, c.caller_name, c.file_path, c.line FROM few f JOIN calls c ON c.callee_name = f.name QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY c.file_path, c.line, c.caller_name) <= 3),
ups AS (SELECT id, list(caller_name ORDER BY file_path, line, caller_name) AS callers FROM up GROUP BY id),
downs AS (SELECT f.id, list(c.callee_name ORDER BY c.line, c.callee_name)[:3] AS callees FROM few f JOIN calls c ON c.caller_chunk_id = f.id GROUP BY f.id)
SELECT b.id, b.score, c.file_path AS file, coalesce(array_to_string(callers, ','), '') AS callers, coalesce(array_to_string(callees, ','), '') AS callees
FROM best b JOIN chunks c USING (id) LEFT JOIN ups USING (id) LEFT JOIN downs USING (id)"""
)
def search_enriched(spark, d):
    results = search.hydrated(_hybrid(spark, d), chunks(spark, d))
    out = search.enriched(results, _document_calls(spark, d))
    return out.select("id", "score", "file", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


# ---------------------------------------------------------------- the graph of foreign keys

CALLS_SQL = """
calls AS (
  SELECT 'order_' || l_orderkey AS caller_name, 'part_' || l_partkey AS callee_name, l_linenumber AS line, 'lineitem' AS file_path FROM lineitem
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, 0, 'tests/orders' FROM orders
  UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey, 0, 'customer' FROM customer
  UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 0, 'supplier' FROM supplier
  UNION ALL SELECT CASE WHEN n_regionkey = 0 THEN NULL ELSE 'region_' || n_regionkey END, 'nation_' || n_nationkey, 0, 'nation' FROM nation
)"""
SYMBOLS_SQL = """
symbols AS (
  SELECT 'part_' || p_partkey AS name, 'function' AS kind, 'part' AS file_path, p_size AS line FROM part
  UNION ALL SELECT 'customer_' || c_custkey, 'method', 'customer', c_nationkey FROM customer
  UNION ALL SELECT 'order_' || o_orderkey, 'function', 'orders', 0 FROM orders
  UNION ALL SELECT 'nation_' || n_nationkey, 'class', 'nation', n_regionkey FROM nation
  UNION ALL SELECT '_hidden', 'function', 'part', 1 UNION ALL SELECT 'main', 'function', 'part', 2 UNION ALL SELECT 'test_me', 'function', 'part', 3
)"""
INHERITANCE_SQL = """
inheritance AS (
  SELECT 'nation_' || n_nationkey AS child_name, 'region_' || n_regionkey AS parent_name, 'extends' AS relation, 'nation' AS file_path FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'extends', 'customer' FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'implements', 'supplier' FROM supplier
)"""


def _node(kind: str, key: str):
    return F.concat(F.lit(kind + "_"), F.col(key).cast("string"))


def calls(spark, d) -> DataFrame:
    def edges(name, caller, callee, line, file):
        return table(spark, d, name).select(caller.alias("caller_name"), callee.alias("callee_name"), line.alias("line"), F.lit(file).alias("file_path"))

    zero = F.lit(0)
    out = edges("lineitem", _node("order", "l_orderkey"), _node("part", "l_partkey"), F.col("l_linenumber"), "lineitem")
    out = out.unionByName(edges("orders", _node("customer", "o_custkey"), _node("order", "o_orderkey"), zero, "tests/orders"))
    out = out.unionByName(edges("customer", _node("nation", "c_nationkey"), _node("customer", "c_custkey"), zero, "customer"))
    out = out.unionByName(edges("supplier", _node("nation", "s_nationkey"), _node("supplier", "s_suppkey"), zero, "supplier"))
    return out.unionByName(edges("nation", F.when(F.col("n_regionkey") != 0, _node("region", "n_regionkey")), _node("nation", "n_nationkey"), zero, "nation"))


def symbols(spark, d) -> DataFrame:
    def rows(name, node, kind, file, line):
        return table(spark, d, name).select(node.alias("name"), F.lit(kind).alias("kind"), F.lit(file).alias("file_path"), line.cast("int").alias("line"))

    out = rows("part", _node("part", "p_partkey"), "function", "part", F.col("p_size"))
    out = out.unionByName(rows("customer", _node("customer", "c_custkey"), "method", "customer", F.col("c_nationkey")))
    out = out.unionByName(rows("orders", _node("order", "o_orderkey"), "function", "orders", F.lit(0)))
    out = out.unionByName(rows("nation", _node("nation", "n_nationkey"), "class", "nation", F.col("n_regionkey")))
    return out.unionByName(spark.createDataFrame([("_hidden", "function", "part", 1), ("main", "function", "part", 2), ("test_me", "function", "part", 3)], "name string, kind string, file_path string, line int"))


def inheritance(spark, d) -> DataFrame:
    def rows(name, child, parent, relation):
        return table(spark, d, name).select(child.alias("child_name"), parent.alias("parent_name"), F.lit(relation).alias("relation"), F.lit(name).alias("file_path"))

    out = rows("nation", _node("nation", "n_nationkey"), _node("region", "n_regionkey"), "extends")
    out = out.unionByName(rows("customer", _node("customer", "c_custkey"), _node("nation", "c_nationkey"), "extends"))
    return out.unionByName(rows("supplier", _node("supplier", "s_suppkey"), _node("nation", "s_nationkey"), "implements"))


@query(f"WITH {CALLS_SQL} SELECT DISTINCT coalesce(nullif(caller_name, ''), '(top-level)') AS caller, file_path AS file, line FROM calls WHERE callee_name = 'part_1' ORDER BY file, line, caller LIMIT 20")
def callers(spark, d):
    return graph.callers(calls(spark, d), "part_1")


@query(
    f"""WITH {CALLS_SQL}, named AS (SELECT DISTINCT callee_name, coalesce(nullif(caller_name, ''), '(top-level)') AS caller, file_path AS file, line FROM calls),
h1 AS (SELECT 1 AS hop, 'part_1' AS via, caller, file, line FROM named WHERE callee_name = 'part_1' ORDER BY file, line, caller LIMIT 20),
h2 AS (SELECT 2 AS hop, callee_name AS via, caller, file, line FROM named WHERE callee_name IN (SELECT caller FROM h1) QUALIFY row_number() OVER (PARTITION BY callee_name ORDER BY file, line, caller) <= 5)
SELECT * FROM h1 UNION ALL SELECT * FROM h2"""
)
def callers_two_hop(spark, d):
    return graph.callers_within(calls(spark, d), "part_1", 2)


@query(f"WITH {CALLS_SQL} SELECT DISTINCT callee_name AS callee, line FROM calls WHERE caller_name = 'order_1'")
def callees(spark, d):
    return graph.callees(calls(spark, d), name="order_1")


@query("SELECT DISTINCT 'doc_' || (doc_id + k) AS callee, k::INT AS line FROM documents, (SELECT unnest([1, 2, 3]) AS k) WHERE doc_id = 7")
def callees_of_chunk(spark, d):
    return graph.callees(_document_calls(spark, d), chunk_id=7)


@query(
    """WITH links AS (SELECT DISTINCT url AS file_path, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS module_path FROM pages)
SELECT DISTINCT file_path AS file, ltrim(module_path, '/') AS imported_name, module_path AS module FROM links WHERE module_path ILIKE '%the%' OR ltrim(module_path, '/') = 'the' ORDER BY file, module, imported_name LIMIT 20"""
)
def importers(spark, d):
    links = table(spark, d, "pages").select(F.col("url").alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("module_path"))
    return graph.importers(links.withColumn("imported_name", F.regexp_replace("module_path", "^/+", "")), "the")


@query(
    f"""WITH {CHUNKS_SQL}, s AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS name, 'function' AS kind, source AS file_path, (doc_id % 10)::INT AS line FROM documents),
one AS (SELECT * FROM s WHERE name = 'odd' ORDER BY file_path, line, kind, chunk_id LIMIT 1)
SELECT one.name, kind, one.file_path AS file, line, start_line, end_line FROM one LEFT JOIN chunks c ON c.id = one.chunk_id"""
)
def symbol_lookup(spark, d):
    docs = table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("name"), F.lit("function").alias("kind"), F.col("source").alias("file_path"), (F.col("doc_id") % 10).cast("int").alias("line"))
    return graph.symbol(s, chunks(spark, d), "odd").drop("snippet")


HIERARCHY_SQL = f"""WITH {INHERITANCE_SQL} SELECT DISTINCT 'parent' AS direction, parent_name AS name, relation, file_path AS file FROM inheritance WHERE child_name = 'nation_1'
UNION SELECT 'child', child_name, relation, file_path FROM inheritance WHERE parent_name = 'nation_1'"""


@query(HIERARCHY_SQL)
def hierarchy(spark, d):
    return graph.hierarchy(inheritance(spark, d), "nation_1")


@query(
    f"""WITH RECURSIVE {INHERITANCE_SQL}, walk AS (SELECT child_name AS name, 1 AS depth FROM inheritance WHERE parent_name = 'region_1'
UNION SELECT i.child_name, w.depth + 1 FROM walk w JOIN inheritance i ON i.parent_name = w.name WHERE w.depth < 10) SELECT name, min(depth)::INT AS depth FROM walk GROUP BY name"""
)
def hierarchy_descendants(spark, d):
    return graph.descendants(inheritance(spark, d), "region_1")


DEAD_SQL = f"WITH {CALLS_SQL}, {SYMBOLS_SQL} SELECT name, kind, file_path AS file, line FROM symbols s WHERE kind IN ('function', 'method') AND NOT starts_with(name, '_') AND name NOT IN ('main', '__init__', 'setUp', 'tearDown', 'test_%') AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee_name = s.name)"


@query(f"{DEAD_SQL} ORDER BY file, line, name LIMIT 50")
def deadcode(spark, d):
    return graph.dead_code(symbols(spark, d), calls(spark, d))


@query(f"{DEAD_SQL} AND file_path ILIKE '%PAR%' ORDER BY file, line, name LIMIT 50")
def deadcode_path(spark, d):
    return graph.dead_code(symbols(spark, d), calls(spark, d), "PAR")


WALK_SQL = f"""{CALLS_SQL}, walk AS (SELECT 'part_1' AS name, 0 AS depth UNION SELECT c.caller_name, w.depth + 1 FROM walk w JOIN calls c ON c.callee_name = w.name WHERE c.caller_name IS NOT NULL AND w.depth < 10),
reached AS (SELECT name, min(depth)::INT AS depth FROM walk GROUP BY name)"""


@query(f"WITH RECURSIVE {WALK_SQL} SELECT name, depth FROM reached WHERE depth > 0")
def impact_closure(spark, d):
    c = calls(spark, d).select(F.col("callee_name").alias("to"), F.col("caller_name").alias("from"))
    return graph.closure(c, "part_1")


@query(
    f"""WITH RECURSIVE {WALK_SQL}, into_ AS (SELECT DISTINCT coalesce(c.caller_name, '(top-level)') AS caller, c.file_path FROM calls c JOIN reached r ON r.name = c.callee_name)
SELECT 'part_1' AS name, (SELECT count(DISTINCT coalesce(caller_name, '(top-level)')) FROM calls WHERE callee_name = 'part_1') AS direct_callers, (SELECT count(*) FROM reached WHERE depth > 0) AS transitive_callers,
  (SELECT array_to_string(list_sort(list(DISTINCT file_path)), ',') FROM into_) AS affected_files,
  (SELECT coalesce(array_to_string(list_sort(list(DISTINCT caller)), ','), '') FROM into_ WHERE starts_with(caller, 'test') OR contains(file_path, '/test')) AS affected_tests,
  CASE WHEN (SELECT count(*) FROM reached WHERE depth > 0) > 10 THEN 'high' WHEN (SELECT count(*) FROM reached WHERE depth > 0) > 3 THEN 'medium' ELSE 'low' END AS risk"""
)
def impact_summary(spark, d):
    out = graph.impact(calls(spark, d), "part_1")
    return out.withColumn("affected_files", F.array_join("affected_files", ",")).withColumn("affected_tests", F.array_join("affected_tests", ","))


@query(
    f"""WITH {CALLS_SQL}, {SYMBOLS_SQL}, {INHERITANCE_SQL} SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM calls) AS calls,
(SELECT sum(len(regexp_extract_all(html, 'href="([^"]+)"', 1)))::BIGINT FROM pages) AS imports, (SELECT count(*) FROM inheritance) AS inheritance"""
)
def graph_stats(spark, d):
    links = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return graph.graph_stats(symbols(spark, d), calls(spark, d), links, inheritance(spark, d))


@query(
    """SELECT (SELECT count(DISTINCT source) FROM documents) AS total_files, (SELECT count(*) FROM documents) AS total_chunks, (SELECT count(*) FROM embeddings) AS vector_count,
(SELECT max(ts) FROM events) AS last_indexed, (SELECT round(sum(strlen(text)) / 1048576.0, 2)::DOUBLE FROM documents) AS content_mb"""
)
def index_stats(spark, d):
    docs = table(spark, d, "documents").agg(F.count_distinct("source").alias("total_files"), F.count("*").alias("total_chunks"), F.round(F.sum(F.octet_length("text")) / 1048576.0, 2).alias("content_mb"))
    vectors = table(spark, d, "embeddings").agg(F.count("*").alias("vector_count"))
    return docs.crossJoin(vectors).crossJoin(table(spark, d, "events").agg(F.max("ts").alias("last_indexed")))


# ---------------------------------------------------------------- questions

ASKED = [
    "who calls handle_error?", 'what does "processData" call', "callers of UserService", "find dead code in src/auth", "who imports numpy", "class hierarchy of Animal",
    "blast radius of validate_email", "what changed in the last 3 days", "recent changes 2 weeks", "how does login work", "what breaks if I change it", "unused functions",
    "backend endpoint for users", "the modal button layout", "SQL migration and css widget", "who", "is the of", "depends on 'Config'", "git log 1 month", "x extends Base",
]
INTENT_CASES = " ".join(f"WHEN regexp_matches(q, '{p}', 'i'){'' if n in ('deadcode', 'git_changes') else ' AND name IS NOT NULL'} THEN '{n}'" for n, p in routing.INTENTS)
ASKED_SQL = f"""
asked AS (SELECT unnest([{quoted(ASKED)}]) AS q UNION ALL SELECT text FROM conversations WHERE turn = 0),
words AS (SELECT q, list_filter(list_transform(string_split_regex(q, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: x <> '' AND lower(x) NOT IN ({quoted(routing.STOP_WORDS)})) AS usable FROM asked),
named AS (SELECT q, coalesce(nullif(regexp_extract(q, '["'']([\\p{{L}}\\p{{N}}_]+)["'']', 1), ''), nullif(regexp_extract(q, '{routing.IDENTIFIER}', 1), ''), usable[-1]) AS name FROM words)
"""


def _asked(spark, d):
    return spark.createDataFrame([(q,) for q in ASKED], "query string").unionByName(table(spark, d, "conversations").where("turn = 0").select(F.col("text").alias("query")))


@query(f"WITH {ASKED_SQL} SELECT q AS query, CASE {INTENT_CASES} ELSE 'search' END AS intent FROM named")
def route_intent(spark, d):
    return routing.routed(_asked(spark, d)).select("query", "intent")


@query(f"WITH {ASKED_SQL} SELECT q AS query, name AS symbol FROM named")
def extract_symbol(spark, d):
    return routing.routed(_asked(spark, d)).select("query", "symbol")


@query(
    f"""WITH {ASKED_SQL}, t AS (SELECT q, regexp_matches(q, '{routing.BACKEND}', 'i') AS b, regexp_matches(q, '{routing.FRONTEND}', 'i') AS f FROM asked)
SELECT q AS query, CASE WHEN b AND NOT f THEN 'backend' WHEN f AND NOT b THEN 'frontend' END AS project_type FROM t"""
)
def project_type(spark, d):
    return _asked(spark, d).select("query", routing.project_type(F.col("query")).alias("project_type"))


# ---------------------------------------------------------------- workspaces


@query(
    f"""WITH {bm25_sql(WORD_LIST)}, {COSINE_SQL.strip()},
vec AS (SELECT c.file_path AS project, s.id, row_number() OVER (PARTITION BY c.file_path ORDER BY round(s.score, 9) DESC, s.id) AS r FROM scored s JOIN chunks c USING (id) QUALIFY r <= 15),
kw AS (SELECT c.file_path AS project, bm.id, row_number() OVER (PARTITION BY c.file_path ORDER BY round(bm.score, 9) DESC, bm.id) AS r FROM bm JOIN chunks c USING (id) QUALIFY r <= 15),
fused AS (SELECT project, id, round(coalesce(1.0 / (60 + vec.r), 0) + coalesce(1.0 / (60 + kw.r), 0), 6)::DOUBLE AS score FROM vec FULL JOIN kw USING (project, id)),
own AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, id) <= 10)
SELECT project, id, score FROM own ORDER BY score DESC, project, id LIMIT 10"""
)
def workspace_search(spark, d):
    v = _vectors(spark, d).withColumnRenamed("vec_id", "id")
    q = list(v.where("id = 0").select("embedding").first()[0])
    c = chunks(spark, d)
    project = c.select("id", F.col("file_path").alias("project"))
    from ..functions.vectors import cosine_arrow

    near = v.select("id", cosine_arrow(q)(F.col("embedding")).alias("score")).join(project, "id")
    words = search.bm25(c, BM_COLUMNS, WORDS, None).join(project, "id")
    return workspace.fused_by_project(near, words, 15, 10)


FILES_SQL = """
files AS (SELECT 'proj' || (doc_id % 9) || '/' || ['a.csproj', 'package.json', 'go.mod', 'Makefile', 'main.py', 'x.sln', 'setup.py', 'src/go.mod'][doc_id % 8 + 1] AS path,
  CASE WHEN doc_id % 8 = 1 THEN ['{"dependencies":{"react":"1"}}', '{"devDependencies":{"express":"1"}}', 'broken', '{"dependencies":{"electron":"1"}}'][doc_id % 9 % 4 + 1] END AS content FROM documents
  UNION ALL SELECT '.hidden/go.mod', NULL UNION ALL SELECT 'README', NULL)
"""
PLACE_CASES = " ".join(f"WHEN {f"ends_with(base, '{p[1:]}')" if p[0] == '*' else f"base = '{p}'"} THEN {k}" for k, (p, _, _) in enumerate(workspace.MARKERS))


def _files(spark, d):
    docs = table(spark, d, "documents")
    sql = """concat('proj', doc_id % 9, '/', element_at(array('a.csproj', 'package.json', 'go.mod', 'Makefile', 'main.py', 'x.sln', 'setup.py', 'src/go.mod'), cast(doc_id % 8 + 1 as int))) AS path"""
    content = """CASE WHEN doc_id % 8 = 1 THEN element_at(array('{"dependencies":{"react":"1"}}', '{"devDependencies":{"express":"1"}}', 'broken', '{"dependencies":{"electron":"1"}}'), cast(doc_id % 9 % 4 + 1 as int)) END AS content"""
    return docs.selectExpr(sql, content).unionByName(spark.createDataFrame([(".hidden/go.mod", None), ("README", None)], "path string, content string"))


DETECT_SQL = f"""{FILES_SQL}, near AS (SELECT string_split(path, '/')[1] AS name, string_split(path, '/')[2] AS base, content FROM files WHERE len(string_split(path, '/')) = 2 AND NOT starts_with(path, '.')),
placed AS (SELECT name, base, content, CASE {PLACE_CASES} END AS place FROM near),
best AS (SELECT name, min(place) AS place, arg_min(content, place) AS content FROM placed WHERE place IS NOT NULL GROUP BY name),
detected AS (SELECT name, name AS path, CASE WHEN place = 15 THEN CASE WHEN contains(content, 'react') THEN 'frontend' WHEN contains(content, 'express') THEN 'backend' WHEN contains(content, 'electron') THEN 'desktop' ELSE 'frontend' END
  ELSE [{quoted(m[1] for m in workspace.MARKERS)}][place + 1] END AS type, [{quoted(m[2] for m in workspace.MARKERS)}][place + 1] AS language FROM best)"""


@query(f"WITH {DETECT_SQL} SELECT * FROM detected")
def detect_projects(spark, d):
    return workspace.detect(_files(spark, d))


@query(f"WITH {DETECT_SQL} SELECT 0::BIGINT AS root_markers, (SELECT count(*) FROM detected) AS projects, true AS is_monorepo")
def monorepo_check(spark, d):
    return workspace.is_monorepo(_files(spark, d))


# ---------------------------------------------------------------- changes and events

CHANGES_SQL = "changes AS (SELECT CASE event_type WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'A' WHEN 'error' THEN 'D' ELSE 'R100' END AS status, 'file_' || (user_id % 200) AS path FROM events)"


def _changes(spark, d):
    status = F.expr("CASE event_type WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'A' WHEN 'error' THEN 'D' ELSE 'R100' END")
    return table(spark, d, "events").select(status.alias("status"), F.concat(F.lit("file_"), (F.col("user_id") % 200).cast("string")).alias("path"))


@query(f"WITH {CHANGES_SQL} SELECT status, count(DISTINCT path) AS files FROM changes WHERE status IN ('M', 'A', 'D') GROUP BY status")
def changes_by_status(spark, d):
    return changes.by_status(_changes(spark, d))


@query(
    f"""WITH {CHANGES_SQL}, f AS (SELECT path, bool_or(status = 'M') AS m FROM changes WHERE status IN ('M', 'A') GROUP BY path)
SELECT p_name AS name, 'function' AS kind, 'file_' || (p_partkey % 300) AS file, p_size AS line, CASE WHEN m THEN 'modified' ELSE 'added' END AS change FROM part JOIN f ON f.path = 'file_' || (p_partkey % 300)"""
)
def changes_symbols(spark, d):
    s = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("file_"), (F.col("p_partkey") % 300).cast("string")).alias("file_path"), F.col("p_size").alias("line"))
    return changes.changed_symbols(_changes(spark, d), s)


@query("SELECT sum(event_id % 10)::BIGINT AS insertions, sum(event_id % 3)::BIGINT AS deletions FROM events")
def changes_line_totals(spark, d):
    line = F.expr("concat(' 3 files changed, ', event_id % 10, ' insertions(+), ', event_id % 3, ' deletions(-)')")
    return changes.line_totals(table(spark, d, "events").select(line.alias("line")))


SESSIONS_SQL = """WITH e AS (SELECT user_id % 50 AS project, ts, event_type, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT project, min(ts) AS first_ts, max(ts) + INTERVAL 1 HOUR AS flush_ts, count(*) AS n_events, count(DISTINCT event_type) AS n_paths FROM s GROUP BY project, n"""


def _events(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("project"), F.col("ts"), F.col("event_type").alias("path"))


@query(SESSIONS_SQL)
def debounce_sessions(spark, d):
    out = sessions(_events(spark, d), quiet="1 hour")
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("flush_ts", F.col("flush_ts").cast("timestamp_ntz"))


@query(SESSIONS_SQL)
def streaming_debounce(spark, d):
    """The same as a stream in one micro-batch and complete output, written by the executors below the shared folder."""
    import uuid

    from ..operators.graph import shared_dir

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.select((F.col("user_id") % 50).alias("project"), "ts", F.col("event_type").alias("path"))
    out = f"{shared_dir(spark)}/debounce-{uuid.uuid4().hex}"
    flushed = sessions(stream, quiet="1 hour", late="1 hour")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")
    run = flushed.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("project", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("flush_ts").cast("timestamp_ntz").alias("flush_ts"), "n_events", "n_paths")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text ELSE decode(encode(text)[11:60]) END AS source FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents)")
def source_slice(spark, d):
    from ..sources.tree import byte_slice

    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "?").alias("text"))
    path = F.col("doc_id").cast("string")
    stored = docs.select(F.col("doc_id").alias("id"), path.alias("file_path"), F.lit(10).alias("byte_start"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(60).alias("byte_end"), F.col("text").alias("content"))
    return byte_slice(stored, docs.select(path.alias("path"), F.col("text").cast("binary").alias("content"))).select("id", "source")


@query(ORACLE["bm25_phrase"])
def bm25_indexed(spark, d):
    """The same through postings and document statistics."""
    c = chunks(spark, d)
    index, stats = search.postings(c, BM_COLUMNS), search.doc_stats(c, BM_COLUMNS)
    return search.bm25(c, BM_COLUMNS, "of_the that", 20, index=index, stats=stats).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- parsing: a small source file made of each document's number

PYTHON_SOURCE = "import m{7}\nfrom p{5} import q{3}\n\n\nclass C{d}(B{4}):\n    def run(self, x):\n        return g{10}(x)\n\n\ndef f{d}(x):\n    y = h{6}(x)\n    return y\n"
TYPESCRIPT_SOURCE = "import {{ q{3} }} from 'p{5}';\n\nclass C{d} extends B{4} {{\n  run(x: number): number {{\n    return g{10}(x);\n  }}\n}}\n\nfunction f{d}(x: number): number {{\n  const y = h{6}(x);\n  return y;\n}}\n"


def _source(template: str):
    """A template's {n} as doc_id % n and {d} as doc_id."""
    import re

    parts = []
    for text, key in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{(\d+|d)\})?", template):
        if text:
            parts.append(F.lit(text.replace("{{", "{").replace("}}", "}")))
        if key:
            parts.append((F.col("doc_id") if key == "d" else F.col("doc_id") % int(key)).cast("string"))
    return F.concat(*parts)


def _parsed(spark, d) -> DataFrame:
    from ..parse.files import parsed

    docs = table(spark, d, "documents").select("doc_id")
    python = F.col("doc_id") % 2 == 0
    path = F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.when(python, ".py").otherwise(".ts"))
    return parsed(docs.select(path.alias("path"), F.when(python, _source(PYTHON_SOURCE)).otherwise(_source(TYPESCRIPT_SOURCE)).alias("text")))


PARSED_SQL = "s AS (SELECT doc_id AS d, doc_id % 2 = 0 AS py, 's' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS file_path FROM documents)"


@query(
    f"""WITH {PARSED_SQL} SELECT file_path, 's' || d AS name, 'file_header' AS chunk_type, 1 AS start_line, CASE WHEN py THEN 2 ELSE 1 END AS end_line FROM s
UNION ALL SELECT file_path, 'C' || d, CASE WHEN py THEN 'class_definition' ELSE 'class_declaration' END, CASE WHEN py THEN 5 ELSE 3 END, 7 FROM s
UNION ALL SELECT file_path, 'f' || d, CASE WHEN py THEN 'function_definition' ELSE 'function_declaration' END, CASE WHEN py THEN 10 ELSE 9 END, 12 FROM s"""
)
def parse_chunks(spark, d):
    from ..parse.files import tables

    return tables(_parsed(spark, d))["chunks"].select("file_path", "name", "chunk_type", "start_line", "end_line")


@query(
    f"""WITH {PARSED_SQL} SELECT file_path, 'C' || d AS name, 'class' AS kind, CASE WHEN py THEN 5 ELSE 3 END AS line, true AS has_chunk FROM s
UNION ALL SELECT file_path, 'run', CASE WHEN py THEN 'function' ELSE 'method' END, CASE WHEN py THEN 6 ELSE 4 END, false FROM s
UNION ALL SELECT file_path, 'f' || d, 'function', CASE WHEN py THEN 10 ELSE 9 END, true FROM s"""
)
def parse_symbols(spark, d):
    from ..parse.files import tables

    return tables(_parsed(spark, d))["symbols"].select("file_path", "name", "kind", "line", F.col("chunk_id").isNotNull().alias("has_chunk"))


@query(
    f"""WITH {PARSED_SQL} SELECT file_path, 'run' AS caller_name, 'g' || d % 10 AS callee_name, CASE WHEN py THEN 7 ELSE 5 END AS line FROM s
UNION ALL SELECT file_path, 'f' || d, 'h' || d % 6, CASE WHEN py THEN 11 ELSE 10 END FROM s"""
)
def parse_calls(spark, d):
    from ..parse.files import tables

    return tables(_parsed(spark, d))["calls"].select("file_path", "caller_name", "callee_name", "line")


@query(f"WITH {PARSED_SQL} SELECT file_path, 'q' || d % 3 AS imported_name, 'p' || d % 5 AS module_path FROM s UNION ALL SELECT file_path, 'm' || d % 7, 'm' || d % 7 FROM s WHERE py")
def parse_imports(spark, d):
    from ..parse.files import tables

    return tables(_parsed(spark, d))["imports"]


@query(f"WITH {PARSED_SQL} SELECT file_path, 'C' || d AS child_name, 'B' || d % 4 AS parent_name, 'extends' AS relation, CASE WHEN py THEN 5 ELSE 3 END AS line FROM s")
def parse_inheritance(spark, d):
    from ..parse.files import tables

    return tables(_parsed(spark, d))["inheritance"].select("file_path", "child_name", "parent_name", "relation", "line")


# ---------------------------------------------------------------- filters and lists that need no file system

IGNORE_FILE = "# built\n*.log\n!f3.log\nbuild/\n/src1/docs/**\n"
IGNORED_PATHS_SQL = "paths AS (SELECT doc_id, source || '/' || ['build', 'docs', 'lib'][doc_id % 3 + 1] || '/f' || (doc_id % 10) || ['.py', '.log'][doc_id // 3 % 2 + 1] AS path FROM documents)"


@query(
    f"""WITH {IGNORED_PATHS_SQL} SELECT doc_id, path FROM paths
WHERE NOT CASE WHEN starts_with(path, 'src1/docs/') OR contains('/' || path, '/build/') THEN true WHEN ends_with(path, '/f3.log') THEN false ELSE ends_with(path, '.log') END"""
)
def gitignore_filter(spark, d):
    folder = "element_at(array('build', 'docs', 'lib'), cast(doc_id % 3 + 1 as int))"
    ending = "element_at(array('.py', '.log'), cast(doc_id div 3 % 2 + 1 as int))"
    paths = table(spark, d, "documents").selectExpr("doc_id", f"concat(source, '/', {folder}, '/f', doc_id % 10, {ending}) AS path")
    return paths.where(~ignored(F.col("path"), ignore_rules(IGNORE_FILE)))


@query(
    f"""WITH events AS (SELECT doc_id, '/w/' || source || '/' || ['src', 'node_modules', 'dist', 'lib'][doc_id % 4 + 1] || '/f' || doc_id || ['.py', '.pyc', '.png', '.ts'][doc_id // 4 % 4 + 1] AS path FROM documents)
SELECT doc_id FROM events WHERE starts_with(path, '/w/') AND split_part(path, '/', 4) NOT IN ({quoted(EXCLUDED_DIRS)}) AND regexp_extract(path, '[.][^.]+$') NOT IN ({quoted(EXCLUDED_EXTENSIONS)})"""
)
def watch_filter(spark, d):
    folder = "element_at(array('src', 'node_modules', 'dist', 'lib'), cast(doc_id % 4 + 1 as int))"
    ending = "element_at(array('.py', '.pyc', '.png', '.ts'), cast(doc_id div 4 % 4 + 1 as int))"
    events = table(spark, d, "documents").selectExpr("doc_id", f"concat('/w/', source, '/', {folder}, '/f', doc_id, {ending}) AS path")
    return watched(events, "/w").select("doc_id")


@query(f"WITH {DETECT_SQL} SELECT * FROM detected WHERE contains(name, 'proj') AND (type = 'frontend' OR NOT EXISTS (SELECT 1 FROM detected WHERE contains(name, 'proj') AND type = 'frontend'))")
def project_filter(spark, d):
    return workspace.chosen(workspace.detect(_files(spark, d)), "Proj", "frontend")


@query(f"WITH {DETECT_SQL} SELECT * FROM detected WHERE contains(name, 'proj')")
def project_filter_no_such_type(spark, d):
    return workspace.chosen(workspace.detect(_files(spark, d)), "proj", "spaceship")


@query(f"WITH {DETECT_SQL} SELECT * FROM detected WHERE name NOT IN ('proj1', 'proj2') UNION ALL SELECT 'proj1', '/elsewhere', 'backend', 'go' UNION ALL SELECT 'new', '/new', 'unknown', 'unknown'")
def project_edits(spark, d):
    listed = workspace.with_project(workspace.detect(_files(spark, d)), "proj1", "/elsewhere", "backend", "go")
    return workspace.without_project(workspace.with_project(listed, "new", "/new"), "proj2")
