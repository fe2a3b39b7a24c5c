"""Retrieval: vector top-k, BM25, reciprocal rank fusion, and what turns ranked ids into a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import truncate
from ..functions.text import query_phrases, stemmed, stemmed_column, tokens
from ..functions.vectors import cosine, cosine_arrow
from ..settings import LEAST_SNIPPET, MAX_PER_FILE, OVERFETCH, RESPONSE_CAP, RRF_K, SNIPPET_BUDGET


#: The largest number of rows that are taken as a top-k.
MOST_SORTED = 1_000_000


def like_path(column: Column, pattern: str) -> Column:
    """``LIKE %pattern%`` with only A-Z and a-z alike; ``%`` and ``_`` in the pattern are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(column, upper, lower).like("%" + pattern.translate(str.maketrans(upper, lower)) + "%")


def matching(chunks: DataFrame, path_filter: str | None = None, language: str | None = None) -> DataFrame:
    if path_filter:
        chunks = chunks.where(like_path(F.col("file_path"), path_filter))
    if language:
        chunks = chunks.where(F.col("language") == language)
    return chunks


def vector_topk(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "id", vector_col: str = "embedding", allowed: DataFrame | None = None, arrow: bool = True) -> DataFrame:
    """(id, score): the k vectors of the largest cosine, ties by id.  ``allowed`` ids filter before the ranking."""
    if allowed is not None:
        vectors = vectors.join(allowed.select(F.col("id").alias(id_col)), id_col, "left_semi")
    score = cosine_arrow(query)(F.col(vector_col)) if arrow else cosine(F.col(vector_col), query)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


# ---------------------------------------------------------------- BM25


def postings(chunks: DataFrame, columns: list[str], *, id_col: str = "id", stem: bool = False) -> DataFrame:
    """(term, id, col, pos) of every token."""
    cols = F.array(*(F.struct(F.lit(k).alias("col"), tokens(F.col(c), diacritics=stem).alias("terms")) for k, c in enumerate(columns)))
    out = chunks.select(F.col(id_col).alias("id"), F.explode(cols).alias("c")).select("id", "c.col", F.posexplode("c.terms").alias("pos", "term"))
    return stemmed(out) if stem else out


def doc_stats(chunks: DataFrame, columns: list[str], *, id_col: str = "id", diacritics: bool = False) -> DataFrame:
    """(id, dl): tokens over all columns."""
    return chunks.select(F.col(id_col).alias("id"), sum((F.size(tokens(F.col(c), diacritics)) for c in columns), F.lit(0)).alias("dl"))


def phrase_counts(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(phrase, id, f): how often each phrase's tokens stand side by side in one column."""
    terms = sorted({t for p in phrases for t in p})
    hits = index.where(F.col("term").isin(terms)) if terms else index.where("false")
    parts = []
    for k, phrase in enumerate(phrases):
        found = hits.where(F.col("term") == phrase[0]).select("id", "col", F.col("pos").alias("at"))
        for step, term in enumerate(phrase[1:], 1):
            found = found.join(hits.where(F.col("term") == term).select("id", "col", (F.col("pos") - step).alias("at")), ["id", "col", "at"])
        parts.append(found.groupBy("id").agg(F.count("*").alias("f")).select(F.lit(k).alias("phrase"), "id", "f"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_forms(chunks: DataFrame, columns: list[str], stems: set[str]) -> dict[str, list[str]]:
    """The corpus's words that have one of a query's stems, by stem.  Stems are taken of the distinct vocabulary only."""
    words = chunks.select(F.explode(F.array_distinct(F.flatten(F.array(*(tokens(F.col(c), diacritics=True) for c in columns))))).alias("word")).distinct()
    found = stemmed_column(words, "word").where(F.col("stem").isin(sorted(stems)))
    out: dict[str, list[str]] = {}
    for r in found.collect():  # the forms of a query's few stems
        out.setdefault(r["stem"], []).append(r["word"])
    return {k: sorted(v) for k, v in out.items()}


def phrase_frequency(terms: Column, phrase: list[list[str]]) -> Column:
    """How often a phrase occurs in a token list; each of its places gives the words that fit there."""
    if len(phrase) == 1:
        parts = [F.size(terms) - F.size(F.array_remove(terms, w)) for w in phrase[0]]
        return sum(parts[1:], parts[0])
    shifted = [terms if k == 0 else F.slice(terms, F.lit(k + 1), F.size(terms)) for k in range(len(phrase))]

    def here(x: Column) -> Column:
        out = x["w0"].isin(*phrase[0])
        for k in range(1, len(phrase)):
            out = out & x[f"w{k}"].isin(*phrase[k])
        return out

    return F.size(F.filter(F.arrays_zip(*(t.alias(f"w{k}") for k, t in enumerate(shifted))), here))


def bm25(chunks: DataFrame, columns: list[str], query: str | list[list[str]], k: int | None, *, id_col: str = "id", allowed: DataFrame | None = None, stem: bool = False, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(id, score) by BM25 over all columns together (k1 1.2, b 0.75; idf at least 1e-6), ties by id.

    Document frequencies and the mean length stay those of all chunks when ``allowed`` ids restrict the result.  A word of the
    query counts as often as it is written.

    Without an index, one pass counts phrases and tokens in each chunk and one aggregation of a single row weighs them; no token leaves
    its row.  ``index`` and ``stats`` take written ``postings`` and ``doc_stats``, and then only the query's terms are read.
    """
    phrases = query_phrases(query, stem) if isinstance(query, str) else query
    if not phrases:
        return chunks.sparkSession.createDataFrame([], "id long, score double")
    if index is not None:
        scored = _bm25_indexed(index, doc_stats(chunks, columns, id_col=id_col, diacritics=stem) if stats is None else stats, phrases, allowed)
    else:
        scored = _bm25_scanned(chunks, columns, phrases, id_col, allowed, stem)
    return scored if k is None else scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def _weight(f: Column, df_t: Column) -> Column:
    idf = F.greatest(F.log((F.col("n_docs") - df_t + 0.5) / (df_t + 0.5)), F.lit(1e-6))
    return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))


def _bm25_scanned(chunks: DataFrame, columns: list[str], phrases: list[list[str]], id_col: str, allowed: DataFrame | None, stem: bool) -> DataFrame:
    forms = word_forms(chunks, columns, {t for p in phrases for t in p}) if stem else {}
    fitting = [[forms.get(t, [t]) if stem else [t] for t in p] for p in phrases]
    of = {p: i for i, p in enumerate(dict.fromkeys(tuple(map(tuple, p)) for p in fitting))}
    # one list for all columns, with '' between: no phrase crosses it.  As a lambda's argument it is made once, and the
    # generator keeps filters above from making it again.
    lists = [part for c in columns for part in (F.array(F.lit("")), tokens(F.col(c), diacritics=stem))][1:]
    counted = F.transform(F.array(F.concat(*lists)), lambda t: F.struct((F.size(t) - (len(columns) - 1)).alias("dl"), *(phrase_frequency(t, [list(w) for w in p]).alias(f"__f{i}") for p, i in of.items())))
    rows = chunks.select(F.col(id_col).alias("id"), F.inline(counted))
    total = F.broadcast(rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"__n{i}") for i in of.values())))  # one row
    hits = rows.where(sum((F.col(f"__f{i}") for i in of.values()), F.lit(0)) > 0)
    if allowed is not None:
        hits = hits.join(allowed.select("id"), "id", "left_semi")
    parts = [_weight(F.col(f"__f{of[tuple(map(tuple, p))]}"), F.col(f"__n{of[tuple(map(tuple, p))]}")) for p in fitting]
    return hits.crossJoin(total).select("id", sum(parts[1:], parts[0]).alias("score"))


def _bm25_indexed(index: DataFrame, stats: DataFrame, phrases: list[list[str]], allowed: DataFrame | None) -> DataFrame:
    counts = phrase_counts(index, phrases)
    total = F.broadcast(stats.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))  # one row
    df_t = F.broadcast(counts.groupBy("phrase").agg(F.count("*").alias("df_t")))  # a row for each phrase of the query
    if allowed is not None:
        counts = counts.join(allowed.select("id"), "id", "left_semi")
    return counts.join(df_t, "phrase").join(stats, "id").crossJoin(total).groupBy("id").agg(F.sum(_weight(F.col("f"), F.col("df_t"))).alias("score"))


# ---------------------------------------------------------------- fusion and response


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """1-based ranks of a short list of hits."""
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias(name))


def fuse(vector: DataFrame, keyword: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of two lists, rounded to 6 places, ties by id."""
    both = ranked(vector, "vector_rank").join(ranked(keyword, "keyword_rank"), "id", "full")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    return both.select("id", F.round(part("vector_rank") + part("keyword_rank"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The response columns of ranked hits; content is fetched for these few ids only."""
    few = F.broadcast(hits.select("id", "score"))  # at most k rows
    return chunks.join(few, "id").select("id", "score", F.col("file_path").alias("file"), "name", "start_line", "end_line", "chunk_type", "language", F.col("content").alias("snippet"))


def per_file(results: DataFrame, most: int = MAX_PER_FILE) -> DataFrame:
    """At most so many results a file, the best ones."""
    own = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    return results.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most).drop("__n")


def capped(results: DataFrame, cap: int = RESPONSE_CAP, columns: list[str] | None = None) -> DataFrame:
    """The best results whose JSON (of ``columns``, all if not given) together has at most ``cap`` characters; all of them if the first alone has more.

    A result has at least the two characters of ``{}``, so the sum is taken over the best ``cap // 2`` rows only.
    """
    best = [F.desc("score"), F.asc("id")]
    order = Window.orderBy(*best).rowsBetween(Window.unboundedPreceding, 0)
    sized = results.withColumn("__size", F.length(F.to_json(F.struct(*(F.col(c) for c in columns or results.columns)))))
    most = cap // 2
    few = sized.orderBy(*best).limit(most) if most <= MOST_SORTED else sized  # a top-k of more would hold that many places in each task
    prefix = few.withColumn("__sum", F.sum("__size").over(order)).where(F.col("__sum") <= cap).drop("__size", "__sum")
    alone = sized.orderBy(*best).limit(1).where(F.col("__size") > cap).select(F.lit(True).alias("__alone"))  # one row or none
    return prefix.unionByName(results.crossJoin(F.broadcast(alone)).drop("__alone"))


def shaped(results: DataFrame, budget: int = SNIPPET_BUDGET, cap: int = RESPONSE_CAP) -> DataFrame:
    """Per-file limit, then - only if the snippets exceed the budget - an equal share for each and the cap."""
    results = per_file(results)
    every = Window.partitionBy(F.lit(1))  # a response: few rows
    total = F.sum(F.length(F.coalesce("snippet", F.lit("")))).over(every)
    share = F.greatest(F.floor(F.lit(budget) / F.count("*").over(every)).cast("int"), F.lit(LEAST_SNIPPET))
    out = results.withColumn("__total", total).withColumn("__share", share)
    out = out.withColumn("snippet", F.when(F.col("__total") > budget, truncate(F.col("snippet"), F.col("__share"))).otherwise(F.col("snippet")))
    over = out.where(F.col("__total") > budget).drop("__total", "__share")
    return out.where(F.col("__total") <= budget).drop("__total", "__share").unionByName(capped(over, cap))


def hybrid(chunks: DataFrame, vectors: DataFrame, text: str, query: list[float], k: int = 10, *, columns: list[str] | None = None, path_filter: str | None = None, language: str | None = None, stem: bool = True, index: DataFrame | None = None, stats: DataFrame | None = None, arrow: bool = True) -> DataFrame:
    """(id, score): both legs over-fetch OVERFETCH * k, filters come before both, then fusion."""
    allowed = matching(chunks, path_filter, language).select("id") if path_filter or language else None
    near = vector_topk(vectors, query, OVERFETCH * k, allowed=allowed, arrow=arrow)
    words = bm25(chunks, columns or ["name", "content", "file_path", "chunk_type"], text, OVERFETCH * k, allowed=allowed, stem=stem, index=index, stats=stats)
    return fuse(near, words, k)


def enriched(results: DataFrame, calls: DataFrame, first: int = 5, each: int = 3) -> DataFrame:
    """The results with ``callers`` (by name) and ``callees`` (by chunk id) of the first few; the others have none."""
    top = F.broadcast(results.orderBy(F.desc("score"), "id").limit(first).select("id", "name"))
    who = F.when(F.col("caller_name").isNull() | (F.col("caller_name") == ""), F.lit("(top-level)")).otherwise(F.col("caller_name"))
    near = calls.join(top.withColumnRenamed("name", "callee_name"), "callee_name").select("id", F.struct("file_path", "line", who.alias("caller")).alias("c")).distinct()
    below = calls.join(top.withColumnRenamed("id", "caller_chunk_id"), "caller_chunk_id").select(F.col("caller_chunk_id").alias("id"), F.struct("line", F.col("callee_name").alias("callee")).alias("c")).distinct()

    def short(edges: DataFrame, name: str, field: str) -> DataFrame:
        own = Window.partitionBy("id").orderBy("c")
        few = edges.withColumn("n", F.row_number().over(own)).where(F.col("n") <= each)
        return few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x[field]).alias(name))

    none = F.array().cast("array<string>")
    out = results.join(F.broadcast(short(near, "callers", "caller")), "id", "left").join(F.broadcast(short(below, "callees", "callee")), "id", "left")
    return out.withColumn("callers", F.coalesce("callers", none)).withColumn("callees", F.coalesce("callees", none))
