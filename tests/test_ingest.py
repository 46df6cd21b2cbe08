import hashlib
import random
import time
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from passagemill.functions import stem
from passagemill.functions.markdown import ChunkLimits
from passagemill.operators import embed, limiter
from passagemill.plans import retrieval
from passagemill.plans.ingest import Options, open_index, run_ingest
from passagemill import session
from passagemill.sources import corpus as sources
from passagemill.sources.corpus import scan_corpus, with_hash, write_files
from passagemill.sources.index_store import IndexStore
from passagemill.streaming import activity, feed


def corpus(spark, files):
    return with_hash(spark.createDataFrame(list(files.items()), "source_path string, content string"))


def counts(store):
    manifest = store.manifest()
    names = ["documents_added", "documents_updated", "documents_unchanged", "documents_removed", "documents_failed", "chunks_written"]
    return [list(r) for r in store.runs(manifest).where(F.col("run_id") == manifest.run_id).select(*names).collect()][0]


def paths(store):
    return sorted(r.source_path for r in store.documents(store.manifest()).collect())


def test_runs_follow_the_corpus(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    options = Options(dimensions=16, max_input_tokens=50, limits=ChunkLimits(budget=40, minimum=0))
    files = {"a.md": "# A\n\nalpha text", "b/c.md": "beta text", "d.md": "delta", "empty.md": "\n \n"}
    run_ingest(store, corpus(spark, files), "r1", options=options)
    assert counts(store) == [3, 0, 1, 0, 0, 3] and paths(store) == ["a.md", "b/c.md", "d.md"]

    run_ingest(store, corpus(spark, files), "r2", options=options)
    assert counts(store) == [0, 0, 4, 0, 0, 0]

    files = {"a.md": "# A\n\nalpha changed", "b/c.md": "", "new.md": "word " * 60, "d.md": "delta", "empty.md": "\n \n"}
    files["a2.md"] = files.pop("empty.md")
    run_ingest(store, corpus(spark, files), "r3", options=options)
    # One update, two empty documents among the unchanged, one oversize failure.
    assert counts(store) == [0, 1, 3, 0, 1, 1]
    rows = {r.source_path: r for r in store.documents(store.manifest()).collect()}
    assert rows["new.md"].status == "FAILED" and rows["new.md"].content_hash == "" and rows["new.md"].title == "new.md"
    assert rows["a.md"].status == "INDEXED" and rows["a.md"].layer == "r3"
    live = {r.source_path: r.content for r in store.chunks(store.manifest()).collect()}
    assert live == {"a.md": "alpha changed", "b/c.md": "beta text", "d.md": "delta"}  # an emptied document keeps its chunks

    run_ingest(store, corpus(spark, {"a.md": "# A\n\nalpha changed", "d.md": "word " * 60}), "r4", options=options)
    assert counts(store) == [0, 0, 1, 2, 1, 0]
    rows = {r.source_path: r for r in store.documents(store.manifest()).collect()}
    assert set(rows) == {"a.md", "d.md"} and rows["d.md"].status == "FAILED" and rows["d.md"].title == "d"
    live = {r.source_path for r in store.chunks(store.manifest()).collect()}
    assert live == {"a.md", "d.md"}  # a failing document keeps its hash and chunks
    levels = {(r.phase, r.level) for r in store.events(store.manifest()).where("run_id = 'r4'").collect()}
    assert levels == {("DISCOVER", "INFO"), ("PERSIST", "INFO"), ("EMBED", "ERROR")}

    before = store.manifest()
    assert run_ingest(store, corpus(spark, {}), "r4", options=options) == before  # a replayed run changes nothing
    merged = store.compact("merged")
    assert {r.source_path for r in store.chunks(merged).collect()} == live and merged.layers == ["merged"]
    asked = spark.createDataFrame([(1, "alpha changed")], "query_id int, question string")
    hits = retrieval.hybrid_search(asked, open_index(store, options)).orderBy("pos").collect()
    assert hits[0].source_path == "a.md"


def test_force_redoes_everything(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    files = {"a.md": "alpha", "b.md": "beta"}
    run_ingest(store, corpus(spark, files), "r1")
    run_ingest(store, corpus(spark, files), "r2", force=True)
    assert counts(store) == [0, 2, 0, 0, 0, 2]
    assert store.chunks(store.manifest()).count() == 2


def test_folder_scan_sees_edits_and_removals(spark, tmp_path):
    root = tmp_path / "docs"
    for name in ("a.md", "sub/b.MARKDOWN", "node_modules/x.md", ".git/y.md", "note.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    found = {r.source_path: r.content for r in scan_corpus(spark, str(root)).collect()}
    assert found == {"a.md": "text of a.md", "sub/b.MARKDOWN": "text of sub/b.MARKDOWN"}
    store = IndexStore(spark, str(tmp_path / "index"))
    feed.rescan_folder(store, str(root), "p0")
    (root / "a.md").write_text("edited")
    (root / "sub/b.MARKDOWN").unlink()
    (root / "c.md").write_text("third")
    feed.rescan_folder(store, str(root), "p1")
    assert counts(store) == [1, 1, 0, 1, 0, 2] and paths(store) == ["a.md", "c.md"]


def test_change_feed_survives_late_rows_and_replays(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    store = IndexStore(spark, str(tmp_path / "index"))

    def land(*rows):
        spark.createDataFrame(rows, feed.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        feed.stream_ingest(store, landing, checkpoint).awaitTermination()

    land(("a.md", "one", "upsert", 1), ("a.md", "two", "upsert", 3), ("b.md", "bee", "upsert", 2))
    land(("b.md", None, "delete", 5), ("a.md", "late", "upsert", 2), ("c.md", "sea", "upsert", 4))
    land(("b.md", "back from the dead", "upsert", 4), ("c.md", "sea two", "upsert", 6))
    live = {r.source_path: r.content for r in store.chunks(store.manifest()).collect()}
    assert live == {"a.md": "two", "c.md": "sea two"} and paths(store) == ["a.md", "c.md"]
    before = store.manifest()
    again = spark.createDataFrame([("z.md", "z", "upsert", 9)], feed.CHANGE_SCHEMA)
    stream = feed.checkpoint_id(spark, checkpoint)
    assert feed.apply_changes(store, again, before.batch_id, stream=stream) == before
    # A new checkpoint counts from zero again, and its data is new; a row without an operation is reported, not lost.
    landing, checkpoint = str(tmp_path / "landing2"), str(tmp_path / "checkpoint2")
    land(("d.md", "dee", "upsert", 7), ("a.md", "odd", None, 8), ("e.md", "e", "move", 9))
    status = {r.source_path: r.status for r in store.documents(store.manifest()).collect()}
    assert status == {"a.md": "FAILED", "c.md": "INDEXED", "d.md": "INDEXED", "e.md": "FAILED"}
    assert {r.source_path: r.content for r in store.chunks(store.manifest()).collect()} == {"a.md": "two", "c.md": "sea two", "d.md": "dee"}


def test_a_file_that_is_no_utf8_is_read_with_replacements(spark, tmp_path):
    (tmp_path / "good.md").write_text("good", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes("caf\xe9 noir".encode("latin-1"))
    rows = {r.source_path: r for r in scan_corpus(spark, str(tmp_path)).collect()}
    assert rows["bad.md"].content == "caf\ufffd noir" and rows["good.md"].content == "good"
    assert rows["bad.md"].content_hash == hashlib.sha256("caf\xe9 noir".encode("latin-1")).hexdigest()


def test_scheduled_passes_pick_up_edits(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("first")
    store = IndexStore(spark, str(tmp_path / "index"))
    query = feed.scheduled_ingest(spark, store, str(root), str(tmp_path / "checkpoint"), "1 second")
    try:
        for content in ("first", "second"):
            (root / "a.md").write_text(content)
            wanted, deadline = with_hash(spark.createDataFrame([(content,)], "content string")).first().content_hash, time.time() + 90
            while time.time() < deadline:
                assert query.exception() is None
                if [r.content_hash for r in store.documents(store.manifest()).collect()] == [wanted]:
                    break
                time.sleep(0.5)
            else:
                pytest.fail("the pass did not see the file")
    finally:
        query.stop()


def by_hand(events, limit, window):
    opened, seen, out = {}, {}, {}
    for caller, ts, event_id in sorted(events):
        if caller not in opened or ts >= opened[caller] + window:
            opened[caller], seen[caller] = ts, 0
        seen[caller] += 1
        ok = seen[caller] <= limit
        left = opened[caller] + window - ts
        out[event_id] = (ok, 0 if ok else max(1, (left + 999) // 1000))
    return out


@pytest.mark.parametrize("limit,window,slices", [(1, 60_000, 1), (3, 5_000, 2), (10, 3_000, 4)])
def test_limiter_slices_match_one_pass(spark, limit, window, slices):
    picker = random.Random(window)
    events, event_id = [], 0
    for caller, size in ((1, 900), (2, 15), (3, 1), (4, 150)):
        ts = 0
        for _ in range(size):
            ts += picker.choice([0, 0, 7, 300, 999, 1000, 2500, 20_000, 90_000 if picker.random() < 0.05 else 5])
            events.append((caller, ts, event_id))
            event_id += 1
    df = spark.createDataFrame(events, "caller bigint, ts_ms bigint, event_id bigint")
    got = {r.event_id: (r.allowed, r.retry_after_s) for r in limiter.rate_limit_audit(df, limit, window, slices).collect()}
    assert got == by_hand(events, limit, window)


def test_limiter_waits():
    assert limiter.decide(0, limiter.NO_WINDOW, 0, 1, 60_000) == (0, 1, True, 0)
    assert limiter.decide(0, 0, 1, 1, 60_000) == (0, 1, False, 60)
    assert limiter.decide(59_900, 0, 1, 1, 60_000) == (0, 1, False, 1)
    assert limiter.decide(60_000, 0, 1, 1, 60_000) == (60_000, 1, True, 0)


def test_streams_match_batches(spark, tmp_path):
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    picker = random.Random(2)
    times = sorted(start + picker.randrange(3 * 86_400_000) for _ in range(300))
    rows = [(n % 4, ts, n) for n, ts in enumerate(times)]
    events = spark.createDataFrame(rows, "caller bigint, ts_ms bigint, event_id bigint").withColumn(
        "created_at", F.timestamp_millis("ts_ms")
    )
    for part in range(3):
        events.where(F.floor((F.col("ts_ms") - start) / 86_400_000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outcomes = activity.stream_rate_limit(stream, 2, 7_200_000, "4 days")
    outcomes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(
        str(tmp_path / "out")
    ).awaitTermination()
    got = {r.event_id: (r.outcome == "allowed", r.retry_after_s) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == by_hand(rows, 2, 7_200_000)
    activity.stream_volume_by_day(stream, str(tmp_path / "volume"), str(tmp_path / "c2")).awaitTermination()
    volume = {r.day: r["count"] for r in activity.read_volume(spark, str(tmp_path / "volume")).collect()}
    want = events.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).count().collect()
    assert volume == {r.day: r["count"] for r in want}


def test_a_run_that_breaks_off_is_logged_and_can_be_repeated(spark, tmp_path):
    from passagemill.operators import listings

    store = IndexStore(spark, str(tmp_path / "index"))
    good = corpus(spark, {"a.md": "alpha beta", "b.md": "beta gamma"})
    run_ingest(store, good, "r1")

    def fails(texts):
        raise RuntimeError("no vectors today")

    edited = corpus(spark, {"a.md": "alpha beta delta"})
    with pytest.raises(Exception, match="no vectors today"):
        run_ingest(store, edited, "r2", options=Options(provider=embed.Provider(fails, 64, name=embed.HASHED_WORDS)))
    runs = listings.list_runs(store.runs(store.manifest()), "FAILED").collect()
    assert [(r.run_id, r.total) for r in runs] == [("r2", 1)] and runs[0].error_message
    assert paths(store) == ["a.md", "b.md"]
    run_ingest(store, edited, "r2")
    assert paths(store) == ["a.md"]


def test_events_are_listed_by_phase(spark, tmp_path):
    from passagemill.operators import listings

    store = IndexStore(spark, str(tmp_path / "index"))
    run_ingest(store, corpus(spark, {f"{n}.md": "text" if n % 2 else None for n in range(8)}), "r1")
    shown = listings.run_events(store.events(store.manifest())).orderBy("position").collect()
    assert [r.phase for r in shown] == ["DISCOVER"] + ["PARSE"] * 4 + ["PERSIST"] * 4


def test_stored_frequencies_follow_the_documents(spark, tmp_path):
    from passagemill.operators import keyword

    store = IndexStore(spark, str(tmp_path / "index"))
    for run, files in enumerate([
        {"a.md": "alpha beta", "b.md": "beta gamma"}, {"a.md": "alpha alpha delta", "b.md": "beta gamma", "c.md": "beta"}, {"c.md": "beta"}, {"c.md": "beta"},
    ]):
        run_ingest(store, corpus(spark, files), f"r{run}")
        index = open_index(store)
        stored = {r.lexeme: r.documents for r in index.frequencies.collect()}
        assert stored == {r.lexeme: r.documents for r in keyword.lexeme_frequencies(index.terms).collect()}


def test_a_version_is_published_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    manifest = run_ingest(store, corpus(spark, {"a.md": "alpha"}), "r1")
    with pytest.raises(Exception):
        store.publish(manifest)


def characters(value):
    return len(value)


def test_an_index_is_opened_with_what_it_was_made_with(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    options = Options(dimensions=16, counter=characters, limits=ChunkLimits(budget=400, minimum=0))
    run_ingest(store, corpus(spark, {"a.md": "alpha reports", "b.md": "x" * 9000}), "r1", options=options)
    rows = store.chunks(store.manifest()).collect()
    assert rows and all(r.token_count == len(r.embedded_text) for r in rows)
    total = {r.source_path: r.token_count for r in store.documents(store.manifest()).collect()}
    assert total["a.md"] == len(next(r.embedded_text for r in rows if r.source_path == "a.md"))
    index = open_index(store, options)
    asked = spark.createDataFrame([(1, "report")], "query_id int, question string")
    assert retrieval.keyword_arm(asked, index).count() == 1  # English stems are the default
    for other in (Options(dimensions=16), replace(options, dimensions=32), replace(options, stemmer=stem.identity)):
        with pytest.raises(ValueError, match="was made with"):
            open_index(store, other)
    with pytest.raises(ValueError, match="was made with"):
        run_ingest(store, corpus(spark, {"a.md": "beta"}), "r2", options=Options(dimensions=16))


def test_files_are_written_by_the_tasks(spark, tmp_path):
    rows = [(n, f"s{n % 3}" if n % 10 else None, None if n == 4 else f"text {n}\nmore é") for n in range(40)]
    docs = spark.createDataFrame([*rows, (7, "s1", "again")], "doc_id bigint, source string, text string")
    for most in (40, 8):  # the second time fewer rows: the old files are gone
        write_files(docs.where(F.col("doc_id") < most), str(tmp_path / "files"), "text", "source", "doc_id")
        found = {r.source_path: r.content for r in scan_corpus(spark, str(tmp_path / "files"), ("txt",)).collect()}
        twice = found.pop("source=s1/doc_id=7/part.txt")
        assert twice in ("text 7\nmore é\nagain\n", "again\ntext 7\nmore é\n")
        assert found == {
            f"source={source or '__HIVE_DEFAULT_PARTITION__'}/doc_id={n}/part.txt": (text or "") + "\n" for n, source, text in rows[:most] if n != 7
        }


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """The tasks list folders, in rounds, and read the files; what Spark's listing hides or the reader misses is left out."""
    root = tmp_path / "docs"
    monkeypatch.setattr(sources, "DESCENDED", 2)
    shown = ["a.md", "b/c d.md", "b/é.md", "day=1/_x=2/e.md", "b/deep/er/f.md", "m%20n.md", *(f"many/d{n}/g.md" for n in range(12))]
    for name in (*shown, "_x.md", ".h.md", "_tmp/i.md", ".git/j.md", "k.md._COPYING_", "node_modules/l.md", "a.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "nowhere.md").symlink_to(root / "missing")
    (root / "linked.md").symlink_to(root / "a.md")
    gone = scan_corpus(spark, str(root))
    assert gone.inputFiles() and not any(name.endswith(".md") for name in gone.inputFiles())
    for place in (str(root), f"{root}/", f"file://{root}"):
        found = {r.source_path: r.content for r in scan_corpus(spark, place).collect()}
        assert found == {name: name for name in shown} | {"linked.md": "a.md"}
    (root / "b/c d.md").unlink()
    assert {r.source_path for r in gone.collect()} == {*shown, "linked.md"} - {"b/c d.md"}
    kinds = {r.source_path: r.content for r in sources.spark_files(spark, str(root)).collect()}
    assert {name for name in kinds if name.endswith(".md") and "node_modules" not in name} == {*shown, "linked.md"} - {"b/c d.md"}
    (root / "empty").mkdir()
    assert scan_corpus(spark, str(root / "empty")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_corpus(spark, str(root / "none"))


def test_a_run_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    """What a run or a batch wrote for itself goes once it is published; a blank in the path does not matter."""
    scratch = tmp_path / "own scratch"
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(scratch))
    left = lambda: {path.name.rsplit("-", 5)[0] for path in scratch.iterdir()} - {"summary"}
    store = IndexStore(spark, str(tmp_path / "index"))
    run_ingest(store, corpus(spark, {"a.md": "alpha", "b.md": "beta"}), "r1")
    run_ingest(store, corpus(spark, {"a.md": "alpha", "b.md": "beta"}), "r2")
    assert left() == set() and paths(store) == ["a.md", "b.md"]
    batch = spark.createDataFrame([("c.md", "gamma", "upsert", 1), ("a.md", None, "delete", 2)], feed.CHANGE_SCHEMA)
    feed.apply_changes(store, batch, 0)
    assert left() == set() and paths(store) == ["b.md", "c.md"]
    assert {r.content for r in store.chunks(store.manifest()).collect()} == {"beta", "gamma"}
    files = [path.name for path in (tmp_path / "index").rglob("chunks/**/*.parquet")]
    assert files and all(".zstd." in name for name in files)
