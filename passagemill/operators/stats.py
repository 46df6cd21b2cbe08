"""Statistics over the index, the query log and the run log. ``as_of`` stands for the current time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K


def within_window(log: DataFrame, as_of: Column, window_days: int = K.DEFAULT_WINDOW_DAYS) -> DataFrame:
    return log.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(window_days)))


def corpus_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over both tables."""
    by_document = documents.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "INDEXED").alias("documents_indexed"),
        F.count_if(F.col("status") == "FAILED").alias("documents_failed"),
        F.max("indexed_at").alias("last_indexed_at"),
    )
    by_chunk = chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("embedding").isNull()).alias("chunks_missing_embedding"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"),
    )
    both = by_document.unionByName(by_chunk, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def index_health(stats: DataFrame) -> DataFrame:
    healthy = (F.col("chunks_missing_embedding") == 0) & (F.col("documents_failed") == 0)
    return stats.select("documents_failed", "chunks_missing_embedding", healthy.alias("healthy"))


def query_stats(log: DataFrame, as_of: Column, window_days: int = K.DEFAULT_WINDOW_DAYS) -> DataFrame:
    """Volume, latency percentiles, abstentions and empty results of the window."""
    answer = F.col("endpoint") == "answer"
    counted = within_window(log, as_of, window_days).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("endpoint") == "search").alias("searches"),
        F.count_if(answer).alias("answers"),
        F.bround(F.percentile("total_ms", F.lit(0.5)), 0).cast("int").alias("p50_total_ms"),
        F.bround(F.percentile("total_ms", F.lit(0.95)), 0).cast("int").alias("p95_total_ms"),
        F.count_if(answer & ~F.col("answered")).alias("abstained"),
        F.count_if(F.col("result_count") == 0).alias("zero_result_count"),
    )
    return counted.withColumn("abstain_rate", F.round(F.try_divide("abstained", "answers"), 6)).drop("abstained")


def top_queries(
    log: DataFrame, as_of: Column, window_days: int = K.DEFAULT_WINDOW_DAYS, limit: int = K.TOP_QUERIES
) -> DataFrame:
    """Most frequent texts with their average top score."""
    grouped = within_window(log, as_of, window_days).groupBy("query_text").agg(
        F.count("*").alias("count"), F.round(F.avg("top_score"), 6).alias("average_top_score")
    )
    return grouped.orderBy(F.desc("count"), "query_text").limit(limit)


def zero_result_queries(
    log: DataFrame, as_of: Column, window_days: int = K.DEFAULT_WINDOW_DAYS, limit: int = K.TOP_QUERIES
) -> DataFrame:
    empty = within_window(log, as_of, window_days).where(F.col("result_count") == 0)
    grouped = empty.groupBy("query_text").agg(F.count("*").alias("count"))
    return grouped.orderBy(F.desc("count"), "query_text").limit(limit)


def volume_by_day(log: DataFrame, as_of: Column, window_days: int = K.DEFAULT_WINDOW_DAYS) -> DataFrame:
    """Requests per UTC day; days without requests are absent."""
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return within_window(log, as_of, window_days).groupBy(day).agg(F.count("*").alias("count"))


def volume_peak_share(volume: DataFrame) -> DataFrame:
    """Each day's height in percent of the busiest day, at least 2."""
    peak = volume.agg(F.max("count").alias("peak")).scalar()
    height = F.greatest(F.col("count") / peak * 100, F.lit(2.0))
    return volume.select("day", "count", F.round(height, 6).alias("height_percent"))


def last_run(runs: DataFrame) -> DataFrame:
    """The latest run by start time; no row without runs."""
    row = F.struct(
        "started_at", "run_id", "status", "finished_at", "documents_added", "documents_updated", "documents_failed"
    )
    latest = runs.agg(F.max(row).alias("run")).where(F.col("run").isNotNull())
    return latest.select("run.*").select(
        "run_id", "status", "started_at", "finished_at", "documents_added", "documents_updated", "documents_failed"
    )


def run_durations(runs: DataFrame) -> DataFrame:
    """Milliseconds from start to end; null while running or when the clock ran backwards."""
    elapsed = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return runs.select("run_id", "status", F.when(elapsed >= 0, elapsed).alias("duration_ms"))


def latency_split(log: DataFrame) -> DataFrame:
    """Median and 95th percentile of each stage per endpoint."""
    measures = [
        F.round(F.percentile(f"{stage}_ms", F.lit(share)), 6).alias(f"{stage}_p{int(share * 100)}")
        for stage in ("embed", "retrieve", "generate", "total")
        for share in (0.5, 0.95)
    ]
    return log.groupBy("endpoint").agg(*measures)


def latency_sketches(log: DataFrame, k: int = 400) -> DataFrame:
    """A KLL sketch of the total time per UTC day and endpoint: a few kilobytes a row, whatever the traffic.

    The rank of a quantile is off by about ``2.3 / k ** 0.9`` of all rows at most; that holds for merged sketches too.
    """
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return log.groupBy(day, "endpoint").agg(
        F.count("total_ms").alias("requests"), F.kll_sketch_agg_double(F.col("total_ms").cast("double"), k).alias("sketch")
    )


def sketched_latency(sketches: DataFrame, *by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles over any days and endpoints of ``latency_sketches``, without another look at the log."""
    merged = sketches.where("requests > 0").groupBy(*by).agg(
        F.sum("requests").cast("bigint").alias("requests"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    return merged.select(
        *by, "requests", *(F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(f"total_p{round(share * 100)}") for share in shares)
    )


def dropped_marker_rate(log: DataFrame) -> DataFrame:
    """Markers without a source per day: a rising count shows a regression."""
    dropped = F.coalesce(F.size("dropped_markers"), F.lit(0))
    return log.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("requests"), F.sum(dropped).cast("bigint").alias("dropped_markers")
    )
