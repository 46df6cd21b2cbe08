"""Fusion of ranked lists, passage attributes, request bounds and match explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text


def best_ranks(arm: DataFrame, name: str) -> DataFrame:
    return arm.groupBy("query_id", "chunk_id").agg(F.min("rank").alias(name))


def rrf_fusion(vector: DataFrame, keyword: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion with ``pos``, ties by vector rank, keyword rank, then id."""
    joined = best_ranks(vector, "vector_rank").join(
        best_ranks(keyword, "keyword_rank"), ["query_id", "chunk_id"], "full_outer"
    )
    part = lambda rank: F.coalesce(1.0 / (F.col(rank) + k), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), "chunk_id"
    )
    return joined.withColumn("score", part("vector_rank") + part("keyword_rank")).withColumn(
        "pos", F.row_number().over(order)
    )


def passage_join(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attributes of hit chunks; the vector column is never read."""
    attributes = chunks.select(
        "chunk_id", "document_id", "title", "source_path", "doc_type", "breadcrumb", "content", "ordinal"
    )
    return hits.join(attributes, "chunk_id")


def doc_type_filter(questions: DataFrame, doc_type: str | Column) -> DataFrame:
    """Limits a question to one kind of document; both arms apply it before ranking."""
    return questions.withColumn("doc_type", F.lit(doc_type) if isinstance(doc_type, str) else doc_type)


def request_problem() -> Column:
    """Why a request is out of bounds, or null."""
    length = F.length(text.trim_space(F.col("question")))
    return (
        F.when(F.coalesce(length, F.lit(0)) < K.MIN_QUERY_CHARS, "question is empty")
        .when(length > K.MAX_QUERY_CHARS, f"question is longer than {K.MAX_QUERY_CHARS} characters")
        .when(~F.col("top_k").between(K.MIN_TOP_K, K.MAX_TOP_K), f"top_k is not within {K.MIN_TOP_K}..{K.MAX_TOP_K}")
    )


def top_k_bounds(requests: DataFrame) -> DataFrame:
    """Trims questions, fills the default ``top_k`` and adds ``problem``, null for valid requests."""
    filled = requests.withColumn("top_k", F.coalesce("top_k", F.lit(K.DEFAULT_TOP_K)))
    return filled.withColumn("problem", request_problem()).withColumn("question", text.trim_space(F.col("question")))


def accepted(requests: DataFrame) -> DataFrame:
    return top_k_bounds(requests).where(F.col("problem").isNull()).drop("problem")


def rejected(requests: DataFrame) -> DataFrame:
    return top_k_bounds(requests).where(F.col("problem").isNotNull())


def explain_matches(passages: DataFrame) -> DataFrame:
    """Marks the question's terms in each passage; no mark means a purely semantic hit."""
    pattern = text.highlight_pattern(F.col("question"))
    marked = passages.withColumn("pattern", pattern)
    return (
        marked.withColumn("marks", F.coalesce(F.regexp_count("content", F.col("pattern")), F.lit(0)))
        .withColumn(
            "marked",
            F.coalesce(F.regexp_replace(F.col("content"), F.col("pattern"), F.lit("<mark>$1</mark>")), F.col("content")),
        )
        .withColumn("semantic_only", F.col("marks") == 0)
        .drop("pattern")
    )
