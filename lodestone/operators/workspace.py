"""Projects of a workspace: detection, edits, and search over many of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import RRF_K

# Marker files in order, with type and language.
MARKERS = (
    ("*.csproj", "backend", "csharp"),
    ("*.fsproj", "backend", "fsharp"),
    ("*.sln", "backend", "csharp"),
    ("go.mod", "backend", "go"),
    ("Cargo.toml", "backend", "rust"),
    ("pyproject.toml", "backend", "python"),
    ("setup.py", "backend", "python"),
    ("Gemfile", "backend", "ruby"),
    ("build.gradle", "backend", "java"),
    ("build.gradle.kts", "backend", "kotlin"),
    ("pom.xml", "backend", "java"),
    ("composer.json", "backend", "php"),
    ("Package.swift", "backend", "swift"),
    ("CMakeLists.txt", "backend", "cpp"),
    ("Makefile", "backend", "unknown"),
    ("package.json", "frontend", "typescript"),
)
# Dependencies that tell what a package is, in order.
FRAMEWORKS = (("next", "frontend"), ("nuxt", "frontend"), ("react", "frontend"), ("react-dom", "frontend"), ("vue", "frontend"), ("svelte", "frontend"), ("express", "backend"), ("fastify", "backend"), ("koa", "backend"), ("electron", "desktop"))
PROJECT = "name string, path string, type string, language string"


def marker_place(file: Column) -> Column:
    """The place in MARKERS of a file name, null if it is none."""
    out = F.lit(None).cast("int")
    for k, (pattern, _, _) in reversed(list(enumerate(MARKERS))):
        out = F.when(file.endswith(pattern[1:]) if pattern[0] == "*" else file == pattern, F.lit(k)).otherwise(out)
    return out


def package_type(package_json: Column) -> Column:
    """The type of a package by its (dev) dependencies; frontend where they tell nothing."""
    spec = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = F.from_json(package_json, spec)
    has = lambda n: F.coalesce(F.map_contains_key(parsed["dependencies"], n), F.lit(False)) | F.coalesce(F.map_contains_key(parsed["devDependencies"], n), F.lit(False))
    out = F.lit("frontend")
    for name, kind in reversed(FRAMEWORKS):
        out = F.when(has(name), F.lit(kind)).otherwise(out)
    return out


def detect(files: DataFrame, root: str = "") -> DataFrame:
    """Projects among (path, content) of files right below the root's first-level directories: the first marker in order counts.

    ``path`` is relative to ``root``; hidden directories are no projects.
    """
    parts = F.split("path", "/")
    near = files.where((F.size(parts) == 2) & ~F.col("path").startswith(".")).select(parts[0].alias("name"), marker_place(parts[1]).alias("place"), F.when(parts[1] == "package.json", F.col("content")).alias("package"))
    best = near.where("place is not null").groupBy("name").agg(F.min_by(F.struct("place", "package"), "place").alias("m"))
    lists = [F.array(*(F.lit(m[k]) for m in MARKERS)) for k in (1, 2)]
    is_package = F.col("m.place") == len(MARKERS) - 1
    kind = F.when(is_package, package_type(F.col("m.package"))).otherwise(F.element_at(lists[0], F.col("m.place") + 1))
    return best.select("name", F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("name")).alias("path"), kind.alias("type"), F.element_at(lists[1], F.col("m.place") + 1).alias("language")).orderBy("name")


def is_monorepo(files: DataFrame) -> DataFrame:
    """One row: the root itself has no marker, and two first-level directories or more are projects."""
    parts = F.split("path", "/")
    root = files.where(F.size(parts) == 1).agg(F.count(marker_place(F.col("path"))).alias("root_markers"))
    return root.crossJoin(detect(files).agg(F.count("*").alias("projects"))).select("root_markers", "projects", ((F.col("root_markers") == 0) & (F.col("projects") >= 2)).alias("is_monorepo"))


def with_project(projects: DataFrame, name: str, path: str, kind: str = "unknown", language: str = "unknown") -> DataFrame:
    """The list with a project added, in place of one of the same name."""
    new = projects.sparkSession.createDataFrame([(name, path, kind, language)], PROJECT)
    return without_project(projects, name).unionByName(new)


def without_project(projects: DataFrame, name: str) -> DataFrame:
    return projects.where(F.col("name") != name)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECT).json(path)


def chosen(projects: DataFrame, name_part: str | None = None, kind: str | None = None) -> DataFrame:
    """Projects whose name holds a part; of a type, if there is any of it."""
    if name_part:
        projects = projects.where(F.lower("name").contains(name_part.lower()))
    if kind:
        match = F.coalesce((F.col("type") == kind).cast("int"), F.lit(0))
        projects = projects.withColumn("__any", F.max(match).over(Window.partitionBy(F.lit(1)))).where((F.col("__any") == 0) | (match == 1)).drop("__any")  # a short list
    return projects


def fused_by_project(vector: DataFrame, keyword: DataFrame, per_leg: int, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(project, id, score): fusion within each project in one plan, from (project, id, score) of both legs; the best k of all."""

    def ranks(leg: DataFrame, name: str) -> DataFrame:
        own = Window.partitionBy("project").orderBy(F.desc(F.round("score", 9)), "id")
        return leg.select("project", "id", F.row_number().over(own).alias(name)).where(F.col(name) <= per_leg)

    both = ranks(vector, "vector_rank").join(ranks(keyword, "keyword_rank"), ["project", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.select("project", "id", F.round(part("vector_rank") + part("keyword_rank"), 6).alias("score"))
    own = Window.partitionBy("project").orderBy(F.desc("score"), "id")
    return scored.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).drop("n").orderBy(F.desc("score"), "project", "id").limit(k)
