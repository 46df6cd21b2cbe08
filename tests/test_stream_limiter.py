"""The streaming limiter in slices, and sketches of latencies."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators import limiter, stats
from passagemill.streaming import activity

EVENTS = "caller bigint, ts_ms bigint, event_id bigint"


def one_pass(rows, limit, window):
    """Outcomes of ``rows`` in order of caller, time and id."""
    out, states = {}, {}
    for caller, ts, event_id in sorted(rows):
        opened, count = states.get(caller, (limiter.NO_WINDOW, 0))
        opened, count, ok, wait = limiter.decide(ts, opened, count, limit, window)
        states[caller] = opened, count
        out[event_id] = ("allowed" if ok else "rejected", wait)
    return out


def drawn(seed, size, span):
    """A third of the events are of one caller; many share their time."""
    picker = random.Random(seed)
    return [(0 if n % 3 == 0 else 1 + n % 17, picker.randrange(span // 50) * 50, n) for n in range(size)]


@pytest.mark.parametrize("limit,window,slices", [(1, 60_000, 1), (3, 5_000, 2), (10, 3_000, 4)])
def test_batches_in_slices_match_one_pass(spark, tmp_path, limit, window, slices):
    span = 400_000
    rows = drawn(window, 1500, span)
    landing, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    events = spark.createDataFrame(rows, EVENTS)
    for part in range(3):
        events.where(F.floor(F.col("ts_ms") * 3 / span) == part).repartition(2).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
        activity.stream_rate_limit_sliced(stream, out, checkpoint, limit, window, 3_600_000, slices).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert len(found) == len(rows) and {r.batch_id for r in found} == {0, 1, 2}
    assert {r.event_id: (r.outcome, r.retry_after_s) for r in found} == one_pass(rows, limit, window)


def test_late_events_and_lapsed_windows(spark):
    def step(rows, before):
        outcomes, after = limiter.rate_limit_step(spark.createDataFrame(rows, EVENTS), before, 1, 1000, 5000)
        return {r.event_id: (r.outcome, r.retry_after_s) for r in outcomes.collect()}, after

    none = spark.createDataFrame([], f"caller bigint, {limiter.WINDOW_FIELDS}")
    got, after = step([(1, 0, 1), (1, 400, 2), (2, 100, 3)], none)
    assert got == {1: ("allowed", 0), 2: ("rejected", 1), 3: ("allowed", 0)}
    # Caller 1 goes on in its window; an event before its last one is late, one of caller 2 at its last one is not.
    got, after = step([(1, 300, 4), (1, 900, 5), (2, 100, 6), (3, 20_000, 7)], after)
    assert got == {4: ("late", 0), 5: ("rejected", 1), 6: ("rejected", 1), 7: ("allowed", 0)}
    # What is older than the newest event by more than the delay is late, so its windows need not be kept.
    assert [r.caller for r in after.collect()] == [3]
    got, after = step([(1, 14_999, 8), (1, 15_000, 9)], after)
    assert got == {8: ("late", 0), 9: ("allowed", 0)}
    got, after = step([], after)
    assert got == {} and sorted(r.caller for r in after.collect()) == [1, 3]


def test_a_repeated_batch_changes_nothing(spark):
    none = spark.createDataFrame([], f"caller bigint, {limiter.WINDOW_FIELDS}")
    rows = spark.createDataFrame(drawn(5, 300, 50_000), EVENTS)
    first, second = (limiter.rate_limit_step(rows, none, 2, 3000, 10_000, 3) for _ in range(2))
    for one, two in zip(first, second):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.repartition(7).collect()))


def test_merged_sketches_keep_the_rank(spark):
    picker = random.Random(3)
    rows = [(f"2024-01-{1 + n % 28:02d} 10:00:00", "search" if n % 3 else "answer", int(picker.expovariate(0.01))) for n in range(30_000)]
    log = spark.createDataFrame(rows, "at string, endpoint string, total_ms int").withColumn("created_at", F.col("at").cast("timestamp"))
    sketches = stats.latency_sketches(log).cache()
    assert sketches.count() == 56
    for endpoint, keep in ((None, lambda r: True), ("answer", lambda r: r[1] == "answer")):
        found = stats.sketched_latency(sketches if endpoint is None else sketches.where(F.col("endpoint") == endpoint)).first()
        values = sorted(r[2] for r in rows if keep(r))
        assert found.requests == len(values)
        for share, value in ((0.5, found.total_p50), (0.95, found.total_p95)):
            assert bisect.bisect_left(values, value) / len(values) <= share + 0.015
            assert bisect.bisect_right(values, value) / len(values) >= share - 0.015
    empty = stats.sketched_latency(stats.latency_sketches(log.withColumn("total_ms", F.lit(None).cast("int"))), "endpoint")
    assert empty.collect() == []
