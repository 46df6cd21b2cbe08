from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagemill.operators import changes, listings, stats
from passagemill.sources.eval_suite import benchmark_suite, containing_documents, load_eval_suite

LOG = "query_text string, endpoint string, total_ms int, result_count int, top_score double, answered boolean, created_at timestamp"


def log(spark):
    now = datetime(2024, 1, 31)
    old = datetime(2023, 12, 31)
    rows = [
        ("a", "search", 10, 6, 0.5, True, now), ("a", "answer", 21, 0, None, False, now), ("b", "answer", 30, 6, 0.1, True, now),
        ("b", "search", 41, 0, None, True, now), ("c", "search", 900, 0, None, True, old),
    ]
    return spark.createDataFrame(rows, LOG)


def test_query_statistics(spark):
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    row = stats.query_stats(log(spark), as_of).first()
    assert (row.total, row.searches, row.answers, row.p50_total_ms, row.abstain_rate, row.zero_result_count) == (4, 2, 2, 26, 0.5, 2)
    empty = stats.query_stats(log(spark).where("endpoint = 'search'").limit(0), as_of).first()
    assert empty.abstain_rate is None and empty.p95_total_ms is None and empty.total == 0
    top = stats.top_queries(log(spark), as_of).collect()
    assert [(r.query_text, r["count"], r.average_top_score) for r in top] == [("a", 2, 0.5), ("b", 2, 0.1)]
    zero = stats.zero_result_queries(log(spark), as_of).collect()
    assert [(r.query_text, r["count"]) for r in zero] == [("a", 1), ("b", 1)]


def test_volume_heights(spark):
    volume = spark.createDataFrame([("d1", 200), ("d2", 50), ("d3", 1)], "day string, count bigint")
    got = {r.day: r.height_percent for r in stats.volume_peak_share(volume).collect()}
    assert got == {"d1": 100.0, "d2": 25.0, "d3": 2.0}


def test_index_statistics(spark):
    documents = spark.createDataFrame([("INDEXED", datetime(2024, 1, 1)), ("FAILED", None)], "status string, indexed_at timestamp")
    chunks = spark.createDataFrame([([1.0], 3), (None, 4)], "embedding array<double>, token_count int")
    row = stats.corpus_stats(documents, chunks).first()
    assert (row.documents, row.documents_indexed, row.documents_failed, row.chunks, row.chunks_missing_embedding, row.total_tokens) == (2, 1, 1, 2, 1, 7)
    assert not stats.index_health(stats.corpus_stats(documents, chunks)).first().healthy
    assert stats.corpus_stats(documents.limit(0), chunks.limit(0)).first().total_tokens == 0


def test_runs(spark):
    rows = [
        ("r1", "COMPLETED", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 2), 1, 0, 0),
        ("r2", "RUNNING", datetime(2024, 1, 2), None, 0, 0, 0),
        ("r3", "FAILED", datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 4), 0, 0, 0),
    ]
    runs = spark.createDataFrame(
        rows, "run_id string, status string, started_at timestamp, finished_at timestamp, documents_added int, documents_updated int, documents_failed int"
    )
    assert {r.run_id: r.duration_ms for r in stats.run_durations(runs).collect()} == {"r1": 2000, "r2": None, "r3": None}
    assert stats.last_run(runs).first().run_id == "r2" and stats.last_run(runs.limit(0)).count() == 0
    page = listings.list_runs(runs, page=1, page_size=2).collect()
    assert [(r.run_id, r.total) for r in page] == [("r2", 3), ("r3", 3)]


def test_listing_treats_wildcards_literally(spark):
    documents = spark.createDataFrame(
        [("1", "50% off", "a.md", "INDEXED", None, "x"), ("2", "Plain_Name", "b.md", "FAILED", datetime(2024, 1, 1), None),
         ("3", "other", "c\\d.md", "INDEXED", datetime(2024, 1, 2), "x")],
        "document_id string, title string, source_path string, status string, indexed_at timestamp, doc_type string",
    )
    chunks = spark.createDataFrame([("1",), ("1",), ("3",)], "document_id string")

    def found(**filters):
        return [(r.document_id, r.chunk_count, r.total) for r in listings.list_documents(documents, chunks, **filters).collect()]

    assert found(search="%") == [("1", 2, 1)]
    assert found(search="_n") == [("2", 0, 1)] and found(search="\\") == [("3", 1, 1)]
    assert sorted(found(status="INDEXED", doc_type="x")) == [("1", 2, 2), ("3", 1, 2)]
    first = listings.page_of(documents.orderBy(F.desc_nulls_first("indexed_at"), "source_path"), 1, 2).collect()
    assert [r.document_id for r in first] == ["1", "3"]
    with pytest.raises(ValueError):
        listings.page_of(documents, 1, 101)


def test_page_window(spark):
    counted = spark.createDataFrame([(45,), (0,)], "total bigint")
    assert [tuple(r) for r in listings.page_window(counted, 3).collect()] == [(45, 41, 45, 3)]


def test_sessions(spark):
    users = spark.createDataFrame([(1, "Ann_a", "ADMIN"), (2, "bob", "USER"), (3, "cid", "USER")], "user_id int, email string, role string")
    later, earlier = datetime(2025, 1, 1), datetime(2023, 1, 1)
    tokens = spark.createDataFrame(
        [(1, None, later), (1, None, later), (2, earlier, later), (3, None, earlier)], "user_id int, revoked_at timestamp, expires_at timestamp"
    )
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.user_id: r.has_active_session for r in listings.active_sessions(users, tokens, as_of).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert [r.user_id for r in listings.active_sessions(users, tokens, as_of, search="N_", role="ADMIN").collect()] == [1]


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_path string, content_hash string")
    before = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "source_path string, content_hash string")
    got = {r.source_path: r.change for r in changes.classify_changes(now, before).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "updated", "d": "removed"}
    forced = {r.source_path: r.change for r in changes.classify_changes(now, before, force=True).collect()}
    assert forced["b"] == "updated"


def test_suites(spark, tmp_path):
    path = tmp_path / "suite.json"
    path.write_text('{"id": "q1", "type": "answerable", "question": "Q?", "expect": ["a.md"]}\n{"id": "q2", "type": "unanswerable", "question": "R?"}\n')
    got = {r.query_id: r.expected for r in load_eval_suite(spark, str(path)).collect()}
    assert got == {"q1": ["a.md"], "q2": []}
    corpus = spark.createDataFrame(
        [("a.md", "xx The quick brown fox. yy"), ("b.md", "quick brown"), ("c.md", "unquick browns")], "source_path string, content string"
    )
    items = spark.createDataFrame([(1, "The quick brown fox."), (2, "quick brown"), (3, "slow red bird flies"), (4, "quick")], "query_id int, question string")
    found = {(r.query_id, r.source_path) for r in containing_documents(items, corpus).collect()}
    assert found == {(1, "a.md"), (2, "a.md"), (2, "b.md"), (2, "c.md"), (4, "a.md"), (4, "b.md"), (4, "c.md")}
    benchmark = items.select(F.col("query_id").alias("item_id"), F.col("question").alias("text"))
    types = {r.query_id: r.type for r in benchmark_suite(benchmark, corpus).collect()}
    assert types == {1: "answerable", 2: "answerable", 3: "unanswerable", 4: "answerable"}
