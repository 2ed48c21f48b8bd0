"""A training-data pipeline over ``documents``; part of the ``llm`` subpackage.

``STAGES`` lists (name, function) in order; every function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read back as the
next stage's docs. All but the last return the columns of ``documents``.

Every stage takes rows with null doc_ids, null, empty and very long texts, equal
rows, other columns of any name (which it keeps) and empty tables (which give
empty ones). A null text counts as empty: the quality model scores it like any
other, the line stage gives it back as empty, near duplicates keep one empty text
of all, the benchmark stage keeps it, and it has no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import decontaminate, line_dedup, near_dedup, pieces, quality, shared


def _row_key() -> Column:
    """Names a row by doc_id, null or not, and text: equal rows get one verdict."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows that are named in ``bad`` (row_key)."""
    (key,) = shared.free_names(docs, "row_key")
    return docs.withColumn(key, _row_key()).join(bad.select(F.col("row_key").alias(key)).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1; a row goes by its own verdict."""
    found = quality.scores_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, found.where(F.col("score") < quality.THRESHOLD))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates; n_chars follows the text."""
    cut = line_dedup.dedup(docs).drop("n_lines", "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of equal rows one."""
    return near_dedup.keep_of_class(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; a row goes by its own verdict."""
    named = docs.select(_row_key().alias("doc_id"), "text")
    found = decontaminate.decontaminate(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("row_key")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    model = pieces.PieceModel.read(spark, f"file://{pieces.MODEL}")
    coded = pieces.encode(docs, model, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.translate("text", pieces.SPACE, " ")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: SQL can't express the learned, sampled and iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
