"""Evaluation suites: from a JSON file, or derived from the benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text
from passagemill.session import persist_table

SHORT_ANCHOR = 3
SUITE_SCHEMA = "id string, type string, question string, expect array<string>"


def load_eval_suite(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their expected documents, one JSON object per line."""
    rows = spark.read.schema(SUITE_SCHEMA).json(path)
    return rows.select(
        F.col("id").alias("query_id"), "type", "question",
        F.coalesce("expect", F.array().cast("array<string>")).alias("expected"),
    )


def anchored_candidates(corpus: DataFrame, anchors: DataFrame, pieces: Column) -> DataFrame:
    """Documents and items that share the item's anchor, one of the ``pieces`` of the text."""
    by_piece = corpus.select("source_path", F.explode(F.array_distinct(pieces)).alias("anchor"))
    return by_piece.join(anchors, "anchor").drop("anchor")


def containing_documents(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(query_id, source_path)`` of the documents that contain an item word for word.

    An inner word of an item appears as a whole word in any text containing the item, so both sides
    meet on the item's longest inner word. Items of fewer than three words meet the texts on their first
    three characters (or on all they have); an empty item is in no text.
    """
    words = text.raw_words(F.col("question"))
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda word: word != "")
    longest = F.array_max(F.transform(inner, lambda word: F.struct(F.length(word).alias("size"), word.alias("word"))))
    anchored = items.select("query_id", "question", longest["word"].alias("anchor"))
    candidates = anchored_candidates(corpus, anchored.where(F.col("anchor").isNotNull()), text.raw_words(F.col("content")))
    short = anchored.where(F.col("anchor").isNull()).withColumn("anchor", F.substring("question", 1, SHORT_ANCHOR))
    sizes = [row[0] for row in short.select(F.length("anchor")).distinct().collect()]  # at most four numbers
    for size in sorted(size for size in sizes if size):
        every_run = F.regexp_extract_all(F.col("content"), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)
        candidates = candidates.unionByName(anchored_candidates(corpus, short.where(F.length("anchor") == size), every_run))
    candidates = persist_table(candidates, "containment-candidates")
    return candidates.join(corpus.select("source_path", "content"), "source_path").where(
        F.col("content").contains(F.col("question"))
    ).select("query_id", "source_path")


def benchmark_suite(benchmark: DataFrame, corpus: DataFrame) -> DataFrame:
    """Benchmark items as questions; the expected documents are those that contain the item."""
    items = benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    expected = containing_documents(items, corpus).groupBy("query_id").agg(
        F.array_sort(F.collect_set("source_path")).alias("expected")
    )
    joined = items.join(expected, "query_id", "left")
    return joined.select(
        "query_id", F.when(F.col("expected").isNull(), "unanswerable").otherwise("answerable").alias("type"), "question",
        F.coalesce("expected", F.array().cast("array<string>")).alias("expected"),
    )
