"""A corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. ``run`` applies them to documents and cuts the lineage between stages by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import bpe, copies, decontaminate, lines, quality
from probity.llm.common import checkpointed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality model accepts; it learns from labelled documents that are not held out."""
    found = quality.classify(docs, table(spark, sf_dir, "labels"), score_col="__score", predicted_col="__predicted")
    return found.where("__predicted = 1").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs in an earlier one; ``n_chars`` follows the text."""
    clean = lines.drop_recurring_lines(docs, lines_col="__lines", dropped_col="__dropped")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word Jaccard of 0.8 or more, or SimHash): that of the smallest id, null ids last."""
    return copies.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or in reordered passages; decided by row, so null and repeated ids are no exception."""
    key = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    found = decontaminate.contamination(docs.withColumn("__key", key), table(spark, sf_dir, "benchmark"), id_col="__key").select("doc_id").distinct()
    found = found.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    return docs.join(found, same, "left_anti").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document that is left: its token ids, their number, and digests of ids and decoded text."""
    return bpe.encode(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
