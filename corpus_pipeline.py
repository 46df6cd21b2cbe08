"""A training corpus from ``documents``: language, repeated lines, near copies, repeated passages, packing."""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from passagemill.llm import language_id, line_dedup, near_copies, packing, queries, substring_dedup, winnowing  # noqa: E402
from passagemill.session import scratch_dir  # noqa: E402


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go. Their label is a declaration, their source a host."""
    queries.prepare(spark)
    model = language_id.TextModel.fit(docs, "text", "lang", F.col("doc_id"))
    return language_id.accepted_documents(docs, model, "doc_id", "text", F.col("lang"), F.col("source"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three or more lines go; a document that loses all its lines goes with them."""
    queries.prepare(spark)
    return winnowing.with_kept_text(docs, "doc_id", "text", "n_chars", line_dedup.line_dedup)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (see ``near_copies``), the document with the smallest id stays."""
    queries.prepare(spark)
    return near_copies.first_of_each(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, together with the links of near copies: of each group, the document with the smallest id stays."""
    queries.prepare(spark)
    return near_copies.first_of_each(docs, fingerprints=True)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of twenty or more words go; a document that loses all its words goes with them."""
    queries.prepare(spark)
    return winnowing.with_kept_text(docs, "doc_id", "text", "n_chars", substring_dedup.substring_dedup)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a padded batch."""
    queries.prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_copies", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    queries.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprints and the trained text model have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
