"""Streaming forms of the daily volume and the limiter audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passagemill.functions import constants as K
from passagemill.operators.limiter import NO_WINDOW, WINDOW_FIELDS, decide, rate_limit_step


def daily_volume(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests per UTC day, kept incrementally; rows later than the watermark are dropped."""
    day = F.window("created_at", "1 day")
    return (
        log.withWatermark("created_at", delay)
        .groupBy(day)
        .agg(F.count("*").alias("count"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "count")
    )


def stream_volume_by_day(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each changed day under its own key, replacing its former count."""

    def replace_days(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return (
        daily_volume(log)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace_days)
        .trigger(availableNow=True)
        .start()
    )


def read_volume(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("count bigint, day string").parquet(target).select("day", "count")


OUTCOME_SCHEMA = "caller bigint, ts_ms bigint, event_id bigint, outcome string, retry_after_s int"
WINDOW_STATE = "opened bigint, count bigint, last_ts bigint"
OUTPUT_ROWS = 50_000


def stream_rate_limit(
    events: DataFrame, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS, delay: str = "1 hour"
) -> DataFrame:
    """Outcome of each ``(caller, ts_ms, event_id, created_at)`` event: ``allowed``, ``rejected`` or ``late``.

    A caller's events of one micro-batch are decided in time order; two numbers an event are held for that, so bound
    the micro-batches at the source (``maxFilesPerTrigger``). An event older than the last
    decided one is late. State lapses when the watermark has passed the end of the window.
    """

    def judge(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count, last = state.get if state.exists else (NO_WINDOW, 0, NO_WINDOW)
        held = [(piece["ts_ms"].to_numpy(), piece["event_id"].to_numpy()) for piece in pieces]
        times, ids = (np.concatenate(parts) for parts in zip(*held))
        order = np.lexsort((ids, times))
        for begin in range(0, len(order), OUTPUT_ROWS):
            part, rows = order[begin : begin + OUTPUT_ROWS], []
            for ts, event_id in zip(times[part].tolist(), ids[part].tolist()):
                if ts < last:
                    rows.append((key[0], ts, event_id, "late", 0))
                    continue
                opened, count, ok, wait = decide(ts, opened, count, limit, window_ms)
                last = ts
                rows.append((key[0], ts, event_id, "allowed" if ok else "rejected", wait))
            yield pd.DataFrame(rows, columns=["caller", "ts_ms", "event_id", "outcome", "retry_after_s"])
        state.update((opened, count, last))
        state.setTimeoutTimestamp(max(opened + window_ms, state.getCurrentWatermarkMs() + 1))

    watched = events.withWatermark("created_at", delay)
    return watched.groupBy("caller").applyInPandasWithState(
        judge, OUTCOME_SCHEMA, WINDOW_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_rate_limit_sliced(
    events: DataFrame, target: str, checkpoint: str, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS,
    delay_ms: int = 3_600_000, slice_windows: int = 240,
) -> StreamingQuery:
    """``stream_rate_limit`` for callers of any size: writes the outcomes of each batch to ``target/batch_id=n``.

    Each micro-batch is decided in slices of the time line, so a busy caller is many tasks (``rate_limit_step``). The open
    windows lie beside the checkpoint, one table a batch, which the next batch reads; a batch that is repeated after a failure
    starts from the same table and replaces its own output. Bound the micro-batches at the source.
    """
    windows = f"caller {events.schema['caller'].dataType.simpleString()}, {WINDOW_FIELDS}"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id:
            before = session.read.schema(windows).parquet(f"{checkpoint}/windows/batch_id={batch_id - 1}")
        else:
            before = session.createDataFrame([], windows)
        outcomes, after = rate_limit_step(batch, before, limit, window_ms, delay_ms, slice_windows)
        outcomes.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        after.write.mode("overwrite").parquet(f"{checkpoint}/windows/batch_id={batch_id}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
