"""From raw documents to token ids: rejected texts and repeated lines go, then near copies; sources are mixed, texts cut into pieces.

Each stage takes all its predecessor kept. A stage's result is written as Parquet and read again as the next one's documents.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from telltale.llm import linedup, mixing, nearcopies, pieces, quality
from telltale.llm.common import table
from telltale.session import tables_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior is under one half go. The classifier learns from the labelled documents of the input."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, F.col("source"), F.col("lang"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that have an earlier copy, or one within two edits, go. A document left without any text goes as well."""
    return _counted(linedup.dedup(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more in five-word shingles the document with the smallest id stays."""
    return nearcopies.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.epochs(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the sampled pieces of every text, with their number."""
    return pieces.encoded(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_copies", copies_stage), ("mixing", mixing_stage),
          ("pieces", pieces_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{tables_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier, the near copies and the sampled pieces have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None
