"""Audit of a per-caller request limiter over an event table.

A window opens at a caller's first event and at the first event after the open one has ended; the
first ``limit`` events of a window are allowed. That is a chain over a caller's time line. To keep a
busy caller from being one task, the line is cut into slices:

1. every slice is summarised: for each event that could open its first window, the window that is
   open at the end of the slice and its event count;
2. the short summaries are chained per caller, which gives the window carried into each slice;
3. every slice is decided on its own, starting from its carried window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.session import persist_table

NO_WINDOW = -(2**62)
#: Slice numbers before and after all others: the window that a caller brings along, and the one that it leaves.
ENTRY, EXIT = -(2**62), 2**62
WINDOW_FIELDS = "opened bigint, count bigint, last bigint"


def runs_of(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of every stretch of equal rows."""
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    yield from zip([0, *edges], [*edges, len(keys)])


class OpenChains:
    """The windows open at a moment, one per group of possible first openers of a slice."""

    def __init__(self, first_ms: int, window_ms: int) -> None:
        self.window, self.fresh_until = window_ms, first_ms + window_ms
        self.events, self.last_opener = 0, None
        self.chains: deque[tuple[int, int, list[int]]] = deque()
        self.candidates_open = True

    def add(self, ts: int) -> None:
        ended: list[int] = []
        while self.chains and self.chains[0][0] + self.window <= ts:
            ended += self.chains.popleft()[2]
        # A window carried into the slice was opened no later than its first event, also where a batch cuts the slice. It
        # ends within one window length of that, so the first event after it is the last one that can be a first opener.
        candidate = self.candidates_open and ts != self.last_opener
        if candidate:
            ended.append(ts)
            self.last_opener = ts
            self.candidates_open = ts < self.fresh_until
        if ended:
            self.chains.append((ts, self.events, ended))
        self.events += 1

    def summary(self) -> list[dict]:
        """``(up to which first opener, open window, its events)`` by first opener, neighbours merged."""
        ends = sorted((origin, opened, self.events - place) for opened, place, origins in self.chains for origin in origins)
        return [
            {"first_opener": origin, "opened": opened, "events": count}
            for (origin, opened, count), following in zip(ends, [*ends[1:], None])
            if following is None or following[1:] != (opened, count)
        ]


def rate_limit_audit(
    events: DataFrame, limit: int = K.RATE_LIMIT, window_ms: int = K.RATE_WINDOW_MS, slice_windows: int = 240
) -> DataFrame:
    """Adds ``allowed`` and ``retry_after_s`` to ``(caller, ts_ms, event_id)`` rows."""
    slice_ms = window_ms * slice_windows
    sliced = events.select("caller", "ts_ms", "event_id").withColumn(
        "slice", F.floor(F.col("ts_ms") / slice_ms).cast("bigint")
    )
    summaries = slice_summaries(sliced, window_ms)
    carried = carried_windows(summaries, window_ms)
    return decided(sliced, carried, limit, window_ms)


def rate_limit_step(
    events: DataFrame, before: DataFrame, limit: int, window_ms: int, delay_ms: int, slice_windows: int = 240
) -> tuple[DataFrame, DataFrame]:
    """One batch of ``(caller, ts_ms, event_id)`` rows after the windows ``before`` (``caller``, ``opened``, ``count``, ``last``).

    Returns the rows with ``outcome`` (``allowed``, ``rejected`` or ``late``) and ``retry_after_s``, and the windows after them.
    An event is late if it is older than its caller's last decided one, or than the newest event of former batches by more than
    ``delay_ms``. A window is dropped once all that could meet it would be late. The batch is cut into the slices of
    ``rate_limit_audit``, so a caller with most of the rows is many tasks; a caller brings one row along.
    """
    oldest = before.agg(F.max("last") - delay_ms).scalar()
    known = before.select("caller", F.col("last").alias("known"))
    bound = F.greatest(F.coalesce("known", F.lit(NO_WINDOW)), F.coalesce(oldest, F.lit(NO_WINDOW)))
    seen = events.select("caller", "ts_ms", "event_id").join(known, "caller", "left")
    seen = persist_table(seen.withColumn("late", F.col("ts_ms") < bound).drop("known"), "limiter-batch")
    slice_ms = window_ms * slice_windows
    sliced = seen.where("not late").drop("late").withColumn("slice", F.floor(F.col("ts_ms") / slice_ms).cast("bigint"))
    brought = before.select(
        "caller", F.lit(ENTRY).alias("slice"), F.col("count").alias("n"),
        F.array(F.struct(F.lit(EXIT).alias("first_opener"), "opened", F.col("count").alias("events"))).alias("ends"),
    )
    carried = persist_table(carried_windows(slice_summaries(sliced, window_ms).unionByName(brought), window_ms, True), "limiter-windows")
    judged = decided(sliced, carried.where((F.col("slice") > ENTRY) & (F.col("slice") < EXIT)), limit, window_ms)
    outcomes = judged.select("caller", "ts_ms", "event_id", F.when(F.col("allowed"), "allowed").otherwise("rejected").alias("outcome"), "retry_after_s")
    late = seen.where("late").select("caller", "ts_ms", "event_id", F.lit("late").alias("outcome"), F.lit(0).alias("retry_after_s"))

    newest = seen.where("not late").groupBy("caller").agg(F.max("ts_ms").alias("newest"))
    left = carried.where(F.col("slice") == EXIT).select("caller", "opened", F.least("carried", F.lit(limit)).cast("bigint").alias("count"))
    # Neither side's last event is older than the other's: what is decided is not older than what was.
    after = left.join(newest, "caller", "left").join(known, "caller", "left").select(
        "caller", "opened", "count", F.coalesce("newest", "known").alias("last")
    )
    after = persist_table(after, "limiter-after")
    passed = F.coalesce(after.agg(F.max("last") - delay_ms).scalar(), F.lit(NO_WINDOW))
    return outcomes.unionByName(late), after.where((F.col("last") >= passed) | (F.col("opened") + window_ms > passed))


def slice_summaries(sliced: DataFrame, window_ms: int) -> DataFrame:
    schema = (
        f"caller {sliced.schema['caller'].dataType.simpleString()}, slice bigint, n bigint, "
        "ends array<struct<first_opener: bigint, opened: bigint, events: bigint>>"
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_chains = None, None
        for batch in batches:
            done = []
            keys = np.stack([batch["caller"].to_numpy(object), batch["slice"].to_numpy(object)], axis=1)
            times = batch["ts_ms"].to_numpy()
            for start, end in runs_of(keys):
                key = tuple(keys[start])
                if key != current:
                    if current is not None:
                        done.append((*current, open_chains.events, open_chains.summary()))
                    current, open_chains = key, OpenChains(int(times[start]), window_ms)
                for ts in times[start:end].tolist():
                    open_chains.add(ts)
            yield pd.DataFrame(done, columns=["caller", "slice", "n", "ends"])
        if current is not None:
            yield pd.DataFrame(
                [(*current, open_chains.events, open_chains.summary())], columns=["caller", "slice", "n", "ends"]
            )

    ordered = sliced.repartition("caller", "slice").sortWithinPartitions("caller", "slice", "ts_ms", "event_id")
    return ordered.mapInPandas(summarise, schema)


def carried_windows(summaries: DataFrame, window_ms: int, leaving: bool = False) -> DataFrame:
    """The window carried into each slice: ``(caller, slice, opened, carried)``; if ``leaving``, also into the slice ``EXIT``."""
    schema = f"caller {summaries.schema['caller'].dataType.simpleString()}, slice bigint, opened bigint, carried bigint"

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, opened, count = None, NO_WINDOW, 0
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.caller != caller:
                    if leaving and caller is not None:
                        rows.append((caller, EXIT, opened, count))
                    caller, opened, count = row.caller, NO_WINDOW, 0
                rows.append((row.caller, row.slice, opened, count))
                place = bisect_left([end["first_opener"] for end in row.ends], opened + window_ms)
                if place < len(row.ends):
                    opened, count = row.ends[place]["opened"], row.ends[place]["events"]
                else:
                    count += row.n
            yield pd.DataFrame(rows, columns=["caller", "slice", "opened", "carried"])
        if leaving and caller is not None:
            yield pd.DataFrame([(caller, EXIT, opened, count)], columns=["caller", "slice", "opened", "carried"])

    ordered = summaries.repartition("caller").sortWithinPartitions("caller", "slice")
    return ordered.mapInPandas(chain, schema)


def decide(ts: int, opened: int, count: int, limit: int, window_ms: int) -> tuple[int, int, bool, int]:
    """The window after an event, and the event's outcome."""
    if ts >= opened + window_ms:
        return ts, 1, True, 0
    if count >= limit:
        return opened, count, False, max(1, -((ts - opened - window_ms) // 1000))
    return opened, count + 1, True, 0


def decided(sliced: DataFrame, carried: DataFrame, limit: int, window_ms: int) -> DataFrame:
    caller, event_id = (sliced.schema[name].dataType.simpleString() for name in ("caller", "event_id"))
    tagged = carried.select(
        "caller", "slice", F.lit(0).alias("kind"), F.col("opened").alias("ts_ms"),
        F.lit(None).cast(event_id).alias("event_id"), "carried",
    ).unionByName(sliced.withColumn("kind", F.lit(1)).withColumn("carried", F.lit(0).cast("bigint")))
    # The carried window of a slice comes before its events.
    ordered = tagged.repartition("caller", "slice").sortWithinPartitions("caller", "slice", "kind", "ts_ms", "event_id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, count = NO_WINDOW, 0
        for batch in batches:
            allowed, waits = [], []
            for kind, ts, carried_count in zip(batch["kind"], batch["ts_ms"].tolist(), batch["carried"].tolist()):
                if kind == 0:
                    opened, count = ts, min(carried_count, limit)
                    allowed.append(False)
                    waits.append(0)
                    continue
                opened, count, ok, wait = decide(ts, opened, count, limit, window_ms)
                allowed.append(ok)
                waits.append(wait)
            judged = batch.assign(allowed=allowed, retry_after_s=waits)
            yield judged.loc[judged["kind"] == 1, ["caller", "ts_ms", "event_id", "allowed", "retry_after_s"]]

    return ordered.mapInPandas(
        judge, f"caller {caller}, ts_ms bigint, event_id {event_id}, allowed boolean, retry_after_s int"
    )
