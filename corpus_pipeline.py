"""A corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one keeps is the next one's ``docs``.  All but the
last return the columns of ``documents``.  Null texts, empty tables, repeated rows and further columns behave as the operators
of ``lodestone.llm`` state; only the columns of ``documents`` go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import cut
from lodestone.llm.decontaminate import contaminated
from lodestone.llm.language_id import identify
from lodestone.llm.line_dedup import drop_common_lines
from lodestone.llm.minhash_dedup import near_duplicates
from lodestone.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a lower mean posterior than this is rejected.  Texts of two languages stay above.
LEAST_SCORE = 0.3
#: A line that so many documents have goes everywhere.
COMMON_LINE_DOCS = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those that are ``und`` (null, empty, no letter) or score too low go."""
    named = identify(docs, keep=COLUMNS)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of common keys but for the first document's; a document that loses all its text goes."""
    left = drop_common_lines(docs, keep=COLUMNS, min_docs=COMMON_LINE_DOCS, min_chars=1, keep_first=True)
    left = left.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8)."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five-word shingles, similarity 0.8)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark, text_col="text", keep=COLUMNS).where(F.size("hits") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their ids."""
    return pack(docs, window=1024)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages learn, sketch and tokenise: SQL has no form for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
