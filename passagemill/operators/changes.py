"""Incremental change detection between a corpus and the stored document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K


def classify_changes(corpus: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``added``, ``updated``, ``unchanged`` or ``removed`` per path; ``force`` re-does unchanged ones."""
    now = corpus.select("source_path", F.col("content_hash").alias("new_hash"))
    before = stored.select("source_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was_stored"))
    same = F.lit(False) if force else F.col("new_hash").eqNullSafe(F.col("old_hash"))
    change = (
        F.when(F.col("was_stored").isNull(), "added")
        .when(~F.col("listed"), "removed")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return (
        now.withColumn("listed", F.lit(True))
        .join(before, "source_path", "full_outer")
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
        .select("source_path", "old_hash", "new_hash", change.alias("change"))
    )


def removed_documents(corpus: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored documents whose path is gone from the corpus."""
    return stored.join(corpus.select("source_path"), "source_path", "left_anti")


def surviving_chunks(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks left after the removal of documents."""
    return chunks.join(removed.select("source_path"), "source_path", "left_anti")


def quarantine(df: DataFrame, limit: int = K.MAX_INPUT_TOKENS, token_count: str = "largest_chunk") -> DataFrame:
    """Adds ``phase`` and ``error`` to chunked documents; both are null for good ones.

    A document without text fails in PARSE, one the kernel rejects in CHUNK, and one with a
    chunk over the embedding limit in EMBED; it is never truncated.
    """
    too_long = F.col(token_count) > limit
    phase = (
        F.when(F.col("content").isNull(), "PARSE").when(F.col("chunk_error").isNotNull(), "CHUNK").when(too_long, "EMBED")
    )
    error = (
        F.when(F.col("content").isNull(), "document has no readable text")
        .when(F.col("chunk_error").isNotNull(), F.col("chunk_error"))
        .when(
            too_long,
            F.concat(F.lit("input has "), F.col(token_count).cast("string"), F.lit(f" tokens, over the limit of {limit}")),
        )
    )
    return df.withColumn("phase", phase).withColumn("error", error)


def outcome(created: Column, chunks: Column) -> Column:
    """What became of a touched document: failed, without chunks, added or updated."""
    return (
        F.when(F.col("error").isNotNull(), "failed")
        .when(chunks == 0, "empty")
        .when(created, "added")
        .otherwise("updated")
    )


def ingestion_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of one run from ``(outcome, chunks)`` rows.

    Empty documents count as unchanged; removed ones were not discovered.
    """
    is_a = lambda *names: F.col("outcome").isin(*names)
    return outcomes.agg(
        F.count_if(is_a("added", "updated", "unchanged", "empty", "failed")).alias("documents_discovered"),
        F.count_if(is_a("added")).alias("documents_added"),
        F.count_if(is_a("updated")).alias("documents_updated"),
        F.count_if(is_a("unchanged", "empty")).alias("documents_unchanged"),
        F.count_if(is_a("removed")).alias("documents_removed"),
        F.count_if(is_a("failed")).alias("documents_failed"),
        F.coalesce(F.sum(F.when(is_a("added", "updated"), F.col("chunks"))), F.lit(0)).cast("bigint").alias("chunks_written"),
    )


def document_events(outcomes: DataFrame) -> DataFrame:
    """Event rows ``(source_path, phase, level, message)`` of touched documents."""
    chunks = F.col("chunks").cast("string")
    warned = F.when(
        F.col("unsupported") > 0,
        F.struct(
            F.lit("PARSE").alias("phase"),
            F.lit("WARN").alias("level"),
            F.concat(
                F.col("unsupported").cast("string"),
                F.lit(" front-matter lines were not flat key: value pairs and were skipped"),
            ).alias("message"),
        ),
    )
    finished = (
        F.when(F.col("outcome") == "failed", event(F.col("phase"), "ERROR", F.col("error")))
        .when(
            F.col("outcome") == "empty",
            event(F.lit("CHUNK"), "WARN", F.lit("document produced no chunks and was skipped")),
        )
        .when(
            F.col("outcome").isin("added", "updated"),
            event(F.lit("PERSIST"), "INFO", F.concat(F.col("outcome"), F.lit(" with "), chunks, F.lit(" chunks"))),
        )
    )
    events = F.filter(F.array(warned, finished), lambda entry: entry.isNotNull())
    return outcomes.select("source_path", F.explode(events).alias("event")).select("source_path", "event.*")


def event(phase: Column, level: str, message: Column) -> Column:
    return F.struct(phase.alias("phase"), F.lit(level).alias("level"), message.alias("message"))


def empty_document_events(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A warning for every document that has no chunk."""
    without = documents.select("source_path").join(chunks.select("source_path"), "source_path", "left_anti")
    return without.select(
        "source_path",
        F.lit("CHUNK").alias("phase"),
        F.lit("WARN").alias("level"),
        F.lit("document produced no chunks and was skipped").alias("message"),
    )
