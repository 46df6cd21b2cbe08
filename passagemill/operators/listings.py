"""Paged listings and lookups, and account sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text


def page_of(df: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of an ordered table."""
    if not 1 <= page_size <= K.MAX_PAGE_SIZE or page < 1:
        raise ValueError(f"page must be at least 1 and page_size within 1..{K.MAX_PAGE_SIZE}")
    return df.offset((page - 1) * page_size).limit(page_size)


def matching_documents(
    documents: DataFrame, search: str | None = None, status: str | None = None, doc_type: str | None = None
) -> DataFrame:
    """Documents whose title or path contains ``search``; wildcards in it are literal."""
    found = documents
    if search:
        pattern = text.like_pattern(search)
        found = found.where(F.col("title").ilike(pattern) | F.col("source_path").ilike(pattern))
    if status is not None:
        found = found.where(F.col("status") == status)
    if doc_type is not None:
        found = found.where(F.col("doc_type") == doc_type)
    return found


def list_documents(
    documents: DataFrame, chunks: DataFrame, search: str | None = None, status: str | None = None,
    doc_type: str | None = None, page: int = 1, page_size: int = K.DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """A page of documents, latest indexed first, each with its chunk count and the total under the filter."""
    found = matching_documents(documents, search, status, doc_type)
    total = found.agg(F.count("*").alias("total")).scalar()
    shown = page_of(found.orderBy(F.desc_nulls_first("indexed_at"), "source_path"), page, page_size)
    counts = (
        chunks.select("document_id")
        .join(F.broadcast(shown.select("document_id")), "document_id", "left_semi")
        .groupBy("document_id")
        .agg(F.count("*").alias("chunk_count"))
    )
    return shown.join(counts, "document_id", "left").select(
        *shown.columns, F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"), total.alias("total")
    )


def get_document(documents: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents of a table of ids with their chunks in order and the reassembled text."""
    mine = chunks.join(wanted.select("document_id"), "document_id", "left_semi")
    entry = F.struct("ordinal", "chunk_id", "breadcrumb", "content", "token_count", F.col("embedding").isNotNull().alias("has_embedding"))
    grouped = mine.groupBy("document_id").agg(F.array_sort(F.collect_list(entry)).alias("chunks"))
    return (
        documents.join(wanted.select("document_id"), "document_id", "left_semi")
        .join(grouped, "document_id", "left")
        .withColumn("chunk_count", F.coalesce(F.size("chunks"), F.lit(0)))
        .withColumn(
            "full_text",
            F.coalesce(F.array_join(F.transform("chunks", lambda chunk: chunk["content"]), "\n\n"), F.lit("")),
        )
    )


def list_runs(runs: DataFrame, status: str | None = None, page: int = 1, page_size: int = K.DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page of runs, latest first, with the total under the filter."""
    found = runs if status is None else runs.where(F.col("status") == status)
    total = found.agg(F.count("*").alias("total")).scalar()
    shown = page_of(found.orderBy(F.desc("started_at"), "run_id"), page, page_size)
    return shown.withColumn("total", total)


def run_events(events: DataFrame, level: str | None = None, limit: int = K.MAX_RUN_EVENTS) -> DataFrame:
    """The first events of every run in time order, optionally of one level."""
    found = events if level is None else events.where(F.col("level") == level)
    order = Window.partitionBy("run_id").orderBy("created_at", "event_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def page_window(counted: DataFrame, page: int, page_size: int = K.DEFAULT_PAGE_SIZE) -> DataFrame:
    """``first``–``last`` of ``total`` and the number of the last page; no row for an empty listing."""
    total: Column = F.col("total")
    return counted.where(total > 0).select(
        "total",
        F.lit((page - 1) * page_size + 1).cast("bigint").alias("first"),
        F.least(F.lit(page * page_size), total).cast("bigint").alias("last"),
        F.greatest(F.lit(1), F.ceil(total / page_size)).cast("bigint").alias("last_page"),
    )


def active_sessions(
    users: DataFrame, tokens: DataFrame, as_of: Column, search: str | None = None, role: str | None = None
) -> DataFrame:
    """Each user once, with whether any of their tokens is neither revoked nor expired."""
    found = users
    if search:
        found = found.where(F.col("email").ilike(text.like_pattern(search)))
    if role is not None:
        found = found.where(F.col("role") == role)
    live = (
        tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of))
        .select("user_id", F.lit(True).alias("live"))
        .distinct()
    )
    return found.join(live, "user_id", "left").select(
        *found.columns, F.coalesce("live", F.lit(False)).alias("has_active_session")
    )
