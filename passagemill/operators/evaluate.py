"""Retrieval and abstention metrics.

``hits`` are ``(mode, query_id, pos, source_path)`` rows; ``suite`` is ``(query_id, type, question,
expected)`` with an array of expected paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_rows(suite: DataFrame) -> DataFrame:
    return suite.select("query_id", F.explode("expected").alias("source_path"))


def query_outcomes(suite: DataFrame, hits: DataFrame, modes: tuple[str, ...] | None = None) -> DataFrame:
    """Expected and found documents and the first expected rank per mode and query.

    A path may repeat among the hits; it counts once, at its best position. Give ``modes`` to judge those that found
    nothing at all too; by default they are the ones among the hits.
    """
    best = hits.groupBy("mode", "query_id", "source_path").agg(F.min("pos").alias("pos"))
    found = best.join(expected_rows(suite).distinct(), ["query_id", "source_path"]).groupBy("mode", "query_id").agg(
        F.count("*").alias("found"), F.min("pos").alias("first_rank")
    )
    # A handful of modes times the suite: every query appears under each mode, hit or not.
    if modes is None:
        mode_list = hits.select("mode").distinct().agg(F.array_sort(F.collect_set("mode")).alias("modes")).scalar()
    else:
        mode_list = F.array(*map(F.lit, modes))
    every = suite.select("query_id", F.size("expected").alias("expected"), F.explode(mode_list).alias("mode"))
    return every.join(found, ["mode", "query_id"], "left").select(
        "mode", "query_id", "expected", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), "first_rank"
    )


def recall() -> Column:
    return F.round(F.try_divide(F.sum("found"), F.sum("expected")), 6).alias("recall")


def reciprocal_rank() -> Column:
    return F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")


def full_hits() -> Column:
    complete = F.when(F.col("found") == F.col("expected"), 1.0).otherwise(0.0)
    return F.round(F.avg(complete), 6).alias("full_hit_rate")


def recall_at_k(outcomes: DataFrame) -> DataFrame:
    """Found share of all expected documents, null when none is expected."""
    return outcomes.groupBy("mode").agg(recall())


def first_expected_rank(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("mode", "query_id", "first_rank")


def mean_reciprocal_rank(outcomes: DataFrame) -> DataFrame:
    """A query without an expected hit counts as zero."""
    return outcomes.groupBy("mode").agg(reciprocal_rank())


def full_hit_rate(outcomes: DataFrame) -> DataFrame:
    """Share of queries whose expected documents were all found."""
    return outcomes.groupBy("mode").agg(full_hits())


def compare_modes(outcomes: DataFrame) -> DataFrame:
    """All three measures side by side."""
    return outcomes.groupBy("mode").agg(recall(), reciprocal_rank(), full_hits(), F.count("*").alias("queries"))


def abstention_accuracy(suite: DataFrame, answers: DataFrame) -> DataFrame:
    """Refusals in both directions with their denominators."""
    judged = suite.select("query_id", (F.col("type") == "unanswerable").alias("should_abstain")).join(
        answers.select("query_id", (~F.col("answered")).alias("did_abstain")), "query_id"
    )
    should, did = F.col("should_abstain"), F.col("did_abstain")
    return judged.agg(
        F.count_if(should & did).alias("correct_refusals"),
        F.count_if(should).alias("unanswerable"),
        F.count_if(~should & did).alias("false_refusals"),
        F.count_if(~should).alias("answerable"),
        F.count_if(should & ~did).alias("answered_anyway"),
    )
