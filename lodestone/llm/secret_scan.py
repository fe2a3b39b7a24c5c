"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of the text).  The ledger holds a row for each pair of blob and rule
version that was scanned, with the spans found, none included.  A run scans only pairs that the ledger lacks - one
representative text per unseen blob, however many paths and versions share it - and joins the findings back to all
paths by content address.

Spans are code points, end exclusive.  Per rule, matches are leftmost and do not overlap; their positions follow from the lengths of
the matches and of the gaps between them, summed in runs of RUN matches, so that the work grows with the matches (to the power of
1.5 at most, whatever one text holds).  Null texts count as empty, and null paths are a path.  Repeated rows give repeated results; of
matches that start at the same place the first rule's comes first.  Columns other than path and text don't matter, and an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, shared_dir


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: matches whose group has fewer code points are dropped.  A new pattern needs a new version."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The first three rules' patterns and least lengths are given.  A least length is part of the pattern where a
# maximal run makes that the same.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


#: Matches whose positions are summed at a time; sums of runs are then added up.
RUN = 256


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start: int, end: int>> of a rule's matches."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), part.alias("part"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (F.concat(acc["out"], F.when(F.length(x["part"]) >= rule.least, one).otherwise(none))).alias("out"))

    def walked(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def joined(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def whole(r: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int")), lambda k: walked(F.slice(r, k * RUN + 1, RUN)))
        nested = F.array().cast("array<array<struct<start:int,end:int>>>")
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), nested.alias("out")), joined, lambda acc: acc["out"]))

    # one element, so that the matches are found once and named r
    return F.when(text.rlike(rule.pattern), F.transform(F.array(rows), whole)[0]).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """What earlier runs have appended at ``path``."""
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").parquet(path)


LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, *, path_col: str = "path", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, rule, version, spans) for every path and rule with findings, and the rows to append to the ledger.

    ``versions`` has a row for each version of a path; give earlier ledgers' rows (schema LEDGER) as ``ledger``.
    """
    spark = versions.sparkSession
    texts = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.sha2(F.col("text"), 256))
    known = cut(texts.select("path", "blob"), "versions")
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    every = F.array(*(F.lit(r.key) for r in rules))
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("done"))
    unseen = known.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left")
    unseen = unseen.select("blob", "path", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    unseen = unseen.select(F.col("blob").alias("u_blob"), F.col("path").alias("u_path"), "todo")
    work = texts.join(unseen, (F.col("blob") == F.col("u_blob")) & F.col("path").eqNullSafe(F.col("u_path")))
    scanned = work.select(
        "blob",
        F.explode(F.array_compact(F.array(*(F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules)))).alias("s"),
    )
    fresh = cut(scanned.select("blob", "s.*").dropDuplicates(["blob", "rule", "version"]), "ledger")
    wanted = reduce(lambda a, b: a | b, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules))
    found = ledger.where(wanted).unionByName(fresh).where(F.size("spans") > 0)
    return known.join(found, "blob").select("path", "blob", "rule", "version", "spans"), fresh


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs)


def digest(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The findings of each document as counts, a hash over the base spans, and all spans."""
    return digested(docs, ledger)[0].drop("blob")


def digested(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The digest with the content address, and what was scanned for it."""
    order = [r.name for r in RULES]
    found, fresh = scan_versions(docs, ledger, path_col="doc_id")
    blobs = fresh if ledger is None else found.select("blob", "rule", "version", "spans").dropDuplicates(["blob", "rule", "version"])
    place = F.create_map(*(F.lit(x) for k, n in enumerate(order) for x in (n, k)))
    each = blobs.where(F.size("spans") > 0).select("blob", "rule", place[F.col("rule")].alias("kind"), F.explode("spans").alias("s"))
    per = each.groupBy("blob").agg(
        *(F.count(F.when(F.col("rule") == n, 1)).alias(f"n_{n}") for n in order[:3]),
        F.array_sort(F.collect_list(F.struct("s.start", "kind", "s.end", "rule"))).alias("all"),
    )
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    per = per.select("blob", *(f"n_{n}" for n in order[:3]), text(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), text(F.col("all")).alias("spans"))
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    zero = [F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in order[:3]]
    out = keyed.join(per, "blob", "left").select("doc_id", "blob", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return out, fresh


#: What a later version of a text ends with, in the query that scans a second version set.
ROTATED = "\ntoken = 'rotated-0001'"


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents, appends to a ledger, then scans a second version of all (those of an even number of characters have a line
    more) against it: the second version's findings, and whether its text had to be scanned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
    append_ledger(scan_versions(docs, path_col="doc_id")[1], path)
    later = docs.withColumn("text", F.when(F.length("text") % 2 == 0, F.concat("text", F.lit(ROTATED))).otherwise(F.col("text")))
    out, fresh = digested(later, read_ledger(spark, path))
    scanned = fresh.select("blob").distinct().withColumn("rescanned", F.lit(True))
    return out.join(scanned, "blob", "left").select("doc_id", "n_assign", "base_sha256", "spans", F.coalesce("rescanned", F.lit(False)).alias("rescanned"))


def _sql_kind(place: int, rule: Rule) -> str:
    quoted = rule.pattern.replace("'", "''")
    part = f"regexp_extract_all(t, '{quoted}', {rule.group})"
    return f"""
  SELECT doc_id, {place} AS kind, '{rule.name}' AS rule, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{
    'ok': length(parts[i]) >= {rule.least},
    'start': length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')),
    'size': length(hits[i])}}), lambda x: x.ok)) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, {part} AS parts, string_split_regex(t, '{quoted}') AS gaps FROM texts)
  WHERE len(hits) > 0"""


OP2_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_kind(k, r) for k, r in enumerate(RULES))}),
named AS (SELECT doc_id, kind, s.start AS start, concat_ws(':', rule, s.start, s.start + s.size) AS span FROM found),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN per USING (doc_id)
"""

_LATER = f"CASE WHEN length(text) % 2 = 0 THEN text || '{ROTATED.replace("'", "''")}' ELSE text END"
SECRET_LEDGER_SQL = (
    OP2_SQL.replace("coalesce(text, '') AS t FROM documents", f"coalesce({_LATER}, '') AS t FROM documents")
    .replace("SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,", "SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign,")
    .replace("coalesce(spans, '') AS spans\n", "coalesce(spans, '') AS spans, t.t NOT IN (SELECT coalesce(text, '') FROM documents) AS rescanned\n")
)
