"""The query log: rows per search or answer, and an activity table read as such a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMINGS = ("embed_ms", "retrieve_ms", "generate_ms")


def timing_columns(timings: dict[str, Column] | None) -> list[Column]:
    """The stages' milliseconds, null where a stage was not measured or did not run, and their sum."""
    stages = {name: (timings or {}).get(name, F.lit(None)).cast("int") for name in TIMINGS}
    measured = F.coalesce(*stages.values()).isNotNull()
    total = sum((F.coalesce(stage, F.lit(0)) for stage in stages.values()), F.lit(0))
    return [*(stage.alias(name) for name, stage in stages.items()), F.when(measured, total).alias("total_ms")]


def user_column(rows: DataFrame) -> Column:
    return (F.col("user_id") if "user_id" in rows.columns else F.lit(None)).cast("string").alias("user_id")


def hit_summary(passages: DataFrame) -> DataFrame:
    """Result count, top score and chunk ids in rank order per question."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "chunk_id")))
    return passages.groupBy("query_id").agg(
        F.count("*").cast("int").alias("result_count"),
        F.max("score").cast("float").alias("top_score"),
        F.transform(ordered, lambda entry: entry["chunk_id"]).alias("chunk_ids"),
    )


def search_log(
    questions: DataFrame, passages: DataFrame, created_at: Column, top_k: int, timings: dict[str, Column] | None = None
) -> DataFrame:
    """Log rows of searches. A search never abstains, so ``answered`` is true.

    ``timings`` are columns over the questions, named as in ``TIMINGS``; a ``user_id`` of the questions is logged.
    """
    joined = questions.join(hit_summary(passages), "query_id", "left")
    return joined.select(
        "query_id", F.col("question").alias("query_text"), F.lit("search").alias("endpoint"), F.lit(top_k).alias("top_k"),
        F.coalesce("result_count", F.lit(0)).alias("result_count"), "top_score", F.lit(True).alias("answered"),
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        F.array().cast("array<int>").alias("dropped_markers"), created_at.alias("created_at"), user_column(questions),
        *timing_columns(timings),
    )


def answer_log(
    answers: DataFrame, created_at: Column, top_k: int, timings: dict[str, Column] | None = None
) -> DataFrame:
    """Log rows of answers, from the sources each answer reported, with ``timings`` and users as in ``search_log``."""
    ids = F.transform("sources", lambda source: source["chunk_id"])
    return answers.select(
        "query_id", F.col("question").alias("query_text"), F.lit("answer").alias("endpoint"), F.lit(top_k).alias("top_k"),
        F.coalesce(F.size("sources"), F.lit(0)).alias("result_count"), F.col("top_score").cast("float").alias("top_score"),
        "answered", F.coalesce(ids, F.array().cast("array<string>")).alias("chunk_ids"), "dropped_markers",
        created_at.alias("created_at"), user_column(answers), *timing_columns(timings),
    )


def append_query_log(rows: DataFrame, root: str, batch: str) -> None:
    """Appends one batch of log rows under its own key, so a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def activity_log(events: DataFrame) -> DataFrame:
    """An activity table in the shape of a query log."""
    answer = F.col("event_type").isin("purchase", "error")
    total = (F.col("value") * 10).cast("int")
    embed_ms = F.least(total, F.lit(200))
    retrieve_ms = F.least(total - embed_ms, F.lit(50))
    floored = answer & (F.col("event_id") % 5 == 0)
    generate_ms = F.when(answer & ~floored, total - embed_ms - retrieve_ms)
    dropped = F.when(
        F.col("event_type") == "error", F.array((F.col("event_id") % 9).cast("int"), (F.col("user_id") % 7).cast("int"))
    )
    return events.select(
        F.col("event_id").alias("query_id"), F.col("user_id"), F.col("props").alias("query_text"),
        F.when(answer, "answer").otherwise("search").alias("endpoint"),
        embed_ms.alias("embed_ms"), retrieve_ms.alias("retrieve_ms"), generate_ms.alias("generate_ms"),
        total.alias("total_ms"),
        F.when(F.col("event_id") % 17 == 0, 0).otherwise(6).alias("result_count"),
        F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") / 10000, 6)).alias("top_score"),
        (~floored).alias("answered"), dropped.alias("dropped_markers"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
