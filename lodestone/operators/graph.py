"""The code graph: lookups, dead code, impact."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import like_path

TOP_LEVEL = "(top-level)"
#: Names that are never dead; the last one is meant literally.
ALIVE = ("main", "__init__", "setUp", "tearDown", "test_%")

#: Walks of a hop that a search for chains goes on with, at first and when those were too few.
WALKS = (1000, 100_000)


def caller_label() -> Column:
    return F.when(F.col("caller_name").isNull() | (F.col("caller_name") == ""), F.lit(TOP_LEVEL)).otherwise(F.col("caller_name"))


def callers(calls: DataFrame, name: str, limit: int = 20, chunks: DataFrame | None = None) -> DataFrame:
    """(caller, file, line) of distinct calls, by file and line.  With ``chunks`` also where the calling chunk lies."""
    found = calls.where(F.col("callee_name") == name)
    extra = []
    if chunks is not None:
        found = found.join(chunks.select(F.col("id").alias("caller_chunk_id"), F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end")), "caller_chunk_id", "left")
        extra = ["chunk_start", "chunk_end"]
    return found.select(caller_label().alias("caller"), F.col("file_path").alias("file"), "line", *extra).distinct().orderBy("file", "line", "caller").limit(limit)


def callers_within(calls: DataFrame, name: str, depth: int = 2, each: int = 5, limit: int = 20) -> DataFrame:
    """(hop, via, caller, file, line): callers, then for each of them at most ``each`` of its own, ``depth`` hops in all."""
    hop = callers(calls, name, limit).select(F.lit(1).alias("hop"), F.lit(name).alias("via"), "caller", "file", "line")
    out = hop
    for k in range(2, depth + 1):
        names = hop.where(F.col("caller") != TOP_LEVEL).select(F.col("caller").alias("callee_name")).distinct()
        own = Window.partitionBy("via").orderBy("file", "line", "caller")
        near = calls.join(F.broadcast(names), "callee_name").select(F.col("callee_name").alias("via"), caller_label().alias("caller"), F.col("file_path").alias("file"), "line").distinct()
        hop = near.withColumn("n", F.row_number().over(own)).where(F.col("n") <= each).select(F.lit(k).alias("hop"), "via", "caller", "file", "line")
        out = out.unionByName(hop)
    return out


def callees(calls: DataFrame, *, chunk_id: int | None = None, name: str | None = None) -> DataFrame:
    """(callee, line) by the calling chunk's id or, also for methods inside a class chunk, by the caller's name."""
    found = calls.where(F.col("caller_chunk_id") == chunk_id) if chunk_id is not None else calls.where(F.col("caller_name") == name)
    return found.select(F.col("callee_name").alias("callee"), "line").distinct().orderBy("line", "callee")


def importers(imports: DataFrame, module: str, limit: int = 20) -> DataFrame:
    """(file, imported_name, module): the module path holds the name (letter case aside), or the imported name is it."""
    found = imports.where(like_path(F.col("module_path"), module) | (F.col("imported_name") == module))
    return found.select(F.col("file_path").alias("file"), "imported_name", F.col("module_path").alias("module")).distinct().orderBy("file", "module", "imported_name").limit(limit)


def symbol(symbols: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name, with its chunk's place and the first 1000 characters."""
    first = symbols.where(F.col("name") == name).orderBy("file_path", "line", "kind", "chunk_id").limit(1)
    place = chunks.select(F.col("id").alias("chunk_id"), "start_line", "end_line", F.substring("content", 1, 1000).alias("snippet"))
    return first.join(place, "chunk_id", "left").select("name", "kind", F.col("file_path").alias("file"), "line", "start_line", "end_line", "snippet")


def hierarchy(inheritance: DataFrame, name: str) -> DataFrame:
    """(direction, name, relation, file): direct parents and children."""
    up = inheritance.where(F.col("child_name") == name).select(F.lit("parent").alias("direction"), F.col("parent_name").alias("name"), "relation", F.col("file_path").alias("file"))
    down = inheritance.where(F.col("parent_name") == name).select(F.lit("child").alias("direction"), F.col("child_name").alias("name"), "relation", F.col("file_path").alias("file"))
    return up.unionByName(down).distinct().orderBy(F.desc("direction"), "relation", "name")


def descendants(inheritance: DataFrame, name: str, max_depth: int = 10) -> DataFrame:
    """(name, depth): all that derive from a class, by shortest distance."""
    return closure(inheritance.select(F.col("parent_name").alias("to"), F.col("child_name").alias("from")), name, max_depth)


def dead_code(symbols: DataFrame, calls: DataFrame, path_filter: str | None = None, limit: int | None = 50) -> DataFrame:
    """(name, kind, file, line) of functions and methods that nothing calls by name; private and entry names are alive."""
    found = symbols.where(F.col("kind").isin("function", "method") & ~F.col("name").startswith("_") & ~F.col("name").isin(*ALIVE))
    if path_filter:
        found = found.where(like_path(F.col("file_path"), path_filter))
    found = found.join(calls.select(F.col("callee_name").alias("name")), "name", "left_anti")
    found = found.select("name", "kind", F.col("file_path").alias("file"), "line").orderBy("file", "line", "name")
    return found if limit is None else found.limit(limit)


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below the one that driver and executors share; a temporary one only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-graph-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    out = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # with the session
    return out


def _written(df: DataFrame) -> DataFrame:
    """A durable copy, in the folder that driver and executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, name: str, max_depth: int = 10) -> DataFrame:
    """(name, depth) reachable over (to, from) edges from ``to = name``: breadth first, one join a hop.

    Each hop writes its frontier, so plans stay short and a lost executor costs one hop; the visited set is what was written.
    """
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(name, 0)], "name string, depth int")
    hops = [frontier]
    for depth in range(1, max_depth + 1):
        near = edges.join(frontier.select(F.col("name").alias("to")), "to").select(F.col("from").alias("name")).where("name is not null").distinct()
        for seen in hops:
            near = near.join(seen.select("name"), "name", "left_anti")
        frontier = _written(near.select("name", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        hops.append(frontier)
    out = hops[0]
    for h in hops[1:]:
        out = out.unionByName(h)
    return out.where(F.col("depth") > 0)


def _impacted(calls: DataFrame, name: str, max_depth: int) -> tuple[DataFrame, DataFrame]:
    edges = calls.select(F.col("callee_name").alias("to"), F.nullif(F.col("caller_name"), F.lit("")).alias("from")).distinct()
    reached = closure(edges, name, max_depth)
    # the calls into what is walked: the target and everything reached before the last hop
    walked = reached.select("name").union(calls.sparkSession.createDataFrame([(name,)], "name string"))
    into = calls.join(walked.withColumnRenamed("name", "callee_name"), "callee_name").select(F.coalesce("caller_name", F.lit(TOP_LEVEL)).alias("caller"), "file_path").distinct()
    return reached, into


def impact(calls: DataFrame, name: str, max_depth: int = 10) -> DataFrame:
    """One row: direct and transitive callers, affected files and tests, risk."""
    reached, into = _impacted(calls, name, max_depth)
    direct = calls.where(F.col("callee_name") == name).agg(F.count_distinct(F.coalesce("caller_name", F.lit(TOP_LEVEL))).alias("direct_callers"))
    is_test = F.col("caller").startswith("test") | F.col("file_path").contains("/test")
    files = into.agg(F.sort_array(F.collect_set("file_path")).alias("affected_files"), F.sort_array(F.collect_set(F.when(is_test, F.col("caller")))).alias("affected_tests"))
    total = reached.agg(F.count("*").alias("transitive_callers"))
    n = F.col("transitive_callers")
    risk = F.when(n > 10, "high").when(n > 3, "medium").otherwise("low")
    return direct.crossJoin(total).crossJoin(files).select(F.lit(name).alias("name"), "direct_callers", "transitive_callers", "affected_files", "affected_tests", risk.alias("risk"))


def sample_chains(calls: DataFrame, name: str, max_depth: int = 10, limit: int = 10) -> DataFrame:
    """(chain): at most ``limit`` call chains from the top level or the depth limit down to ``name``, shortest first, then by names.

    The search goes on with the alphabetically first walks of a hop, which are enough if ``limit`` chains come of them: chains that
    come of later walks sort behind.  If fewer come and some walks were left out, it starts again with more, in the end with all.
    """
    edges = calls.select(F.col("callee_name").alias("to"), F.coalesce(F.nullif(F.col("caller_name"), F.lit("")), F.lit(TOP_LEVEL)).alias("from")).distinct()
    for most in (*WALKS, None):
        chains, whole = _chains(edges, name, max_depth, limit, most)
        if whole:
            break
    return chains.orderBy(F.size("chain"), F.array_join("chain", "\x00")).limit(limit)


def _chains(edges: DataFrame, name: str, max_depth: int, limit: int, most: int | None) -> tuple[DataFrame, bool]:
    """Chains by the first ``most`` walks of each hop, and whether the first ``limit`` of all chains are among them."""
    walks = edges.sparkSession.createDataFrame([([name],)], "path array<string>")
    chains, found, whole = walks.where("false").select(F.col("path").alias("chain")), 0, True
    by_name = F.array_join("path", "\x00")
    for depth in range(1, max_depth + 1):
        near = edges.join(walks, F.col("to") == F.element_at("path", -1)).where(~F.array_contains("path", F.col("from"))).select(F.concat("path", F.array("from")).alias("path"))
        ends = near.where(F.element_at("path", -1) == TOP_LEVEL) if depth < max_depth else near
        ends = _written(ends.orderBy(by_name).limit(limit))
        chains, n = chains.unionByName(ends.select(F.col("path").alias("chain"))), ends.count()
        found += n
        if found >= limit:
            return chains, True
        if not whole:
            return chains, False
        if depth < max_depth:
            on = near.where(F.element_at("path", -1) != TOP_LEVEL)
            walks = _written(on if most is None else on.orderBy(by_name).limit(most))
            n = walks.count()
            if n == 0:
                break
            whole = whole and (most is None or n < most)
    return chains, whole


def graph_stats(symbols: DataFrame, calls: DataFrame, imports: DataFrame, inheritance: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(symbols, "symbols").crossJoin(one(calls, "calls")).crossJoin(one(imports, "imports")).crossJoin(one(inheritance, "inheritance"))
