"""One ingestion run: detect changes, prepare, embed, write a new index version."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import markdown, stem, text
from passagemill.operators import changes as C
from passagemill.operators import embed, keyword, postings, prepare
from passagemill.plans.retrieval import Index
from passagemill.session import forget, persist_table
from passagemill.sources.index_store import CHUNK_SCHEMA, POSTING_SCHEMA, TERM_SCHEMA, IndexStore, Manifest

PHASES = ("DISCOVER", "PARSE", "CHUNK", "EMBED", "PERSIST", "RUN")
QUIET_WORK = "source_path string, outcome string, chunk_count int, unsupported int, phase string, error string"


@dataclass(frozen=True)
class Options:
    dimensions: int = 64
    stemmer: keyword.Stemmer = stem.english
    limits: markdown.ChunkLimits = markdown.ChunkLimits()
    counter: markdown.Counter = markdown.whitespace_tokens
    provider: embed.Provider | None = None
    max_input_tokens: int = K.MAX_INPUT_TOKENS

    def vectors(self) -> embed.Provider:
        return self.provider or embed.hash_provider(self.dimensions)

    def settings(self) -> dict[str, str]:
        """What vectors, terms and token counts of one index must agree in."""
        vectors = self.vectors()

        def name(function) -> str:
            return f"{function.__module__}.{function.__qualname__}"

        return {
            "provider": vectors.name, "dimensions": str(vectors.dimensions), "stemmer": name(self.stemmer),
            "counter": name(self.counter),
        }


def check_settings(manifest: Manifest, options: Options) -> None:
    """Vectors of two providers, or terms of two stemmers, are not comparable."""
    given = options.settings()
    other = [f"{key} {value}, not {given[key]}" for key, value in manifest.settings.items() if given[key] != value]
    if other:
        raise ValueError("the index was made with " + "; ".join(other))


def prepared_documents(corpus: DataFrame, options: Options = Options()) -> DataFrame:
    """Attributes, chunks and failures of raw documents. Narrow: no shuffle, no Python but the kernel."""
    described = prepare.document_attributes(
        prepare.doc_date(prepare.front_matter(prepare.path_metadata(corpus))), body="body"
    )
    chunked = prepare.chunked_documents(described, options.limits, options.counter)
    texts = F.transform(
        "chunks",
        lambda chunk: prepare.embedded_text(prepare.breadcrumb(F.col("title"), chunk["heading_path"]), chunk["content"]),
    )
    sizes = markdown.counted(texts, options.counter)
    measured = chunked.withColumn("largest_chunk", F.coalesce(F.array_max(sizes), F.lit(0))).withColumn(
        "token_count", F.aggregate(sizes, F.lit(0), lambda total, size: total + size).cast("bigint")
    )
    return C.quarantine(measured, options.max_input_tokens)


def with_outcomes(prepared: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``chunk_count`` and ``unsupported`` to prepared rows that carry ``change``."""
    counted = prepared.withColumn(
        "chunk_count", F.when(F.col("error").isNull(), F.size("chunks")).otherwise(F.lit(0))
    ).withColumn("unsupported", F.coalesce(F.size("unsupported_lines"), F.lit(0)))
    return counted.withColumn("outcome", C.outcome(F.col("change") == "added", F.col("chunk_count")))


def indexed_rows(work: DataFrame, run_id: str, now: datetime) -> DataFrame:
    return work.select(
        prepare.document_id(F.col("source_path")).alias("document_id"), "source_path", "title", "content_hash",
        "doc_type", "doc_date", "subject", "version", "lifecycle", "metadata", F.lit("INDEXED").alias("status"),
        F.lit(None).cast("string").alias("error_message"), "token_count", F.lit(now).cast("timestamp").alias("indexed_at"),
        F.lit(run_id).alias("layer"),
    )


def failed_rows(failed: DataFrame, stored: DataFrame) -> DataFrame:
    """Failed documents: a known one keeps its row, hash and chunks; a new one gets a bare row."""
    before = stored.drop("status", "error_message").withColumn("was_stored", F.lit(True))
    joined = failed.select("source_path", F.col("error").alias("error_message")).join(before, "source_path", "left")
    known = F.col("was_stored").isNotNull()
    return joined.withColumn("status", F.lit("FAILED")).withColumn(
        "title", F.when(known, F.col("title")).otherwise(F.col("source_path"))
    ).withColumn("content_hash", F.when(known, F.col("content_hash")).otherwise("")).withColumn(
        "document_id", prepare.document_id(F.col("source_path"))
    )


def snapshot(stored: DataFrame, indexed: DataFrame, failed: DataFrame, gone: DataFrame) -> DataFrame:
    """The document table after a run: untouched rows, new rows, failures."""
    replaced = indexed.select("source_path").unionByName(failed.select("source_path")).unionByName(
        gone.select("source_path")
    )
    columns = [name for name in stored.columns]
    untouched = stored.join(replaced, "source_path", "left_anti").select(*columns)
    return untouched.unionByName(indexed.select(*columns)).unionByName(failed.select(*columns))


def run_ingest(
    store: IndexStore, corpus: DataFrame, run_id: str, trigger: str = "CLI", corpus_dir: str = "", force: bool = False,
    options: Options = Options(), changes: DataFrame | None = None, batch_id: int | None = None, feed: DataFrame | None = None,
    now: datetime | None = None,
) -> Manifest:
    """Brings the index up to date with ``(source_path, content, content_hash)`` rows.

    ``corpus`` is the full listing unless ``changes`` gives the classified paths itself. Only added
    and updated documents are prepared, and only their chunks and terms are written. A run that breaks off
    leaves the tables as they were and a row with the status FAILED; it can be repeated under the same id.
    """
    started = now or datetime.now(timezone.utc)
    current = store.manifest()
    if run_id in current.run_logs:
        return current  # already published; a repeated trigger changes nothing
    try:
        return apply_run(store, current, corpus, run_id, trigger, corpus_dir, force, options, changes, batch_id, feed, started)
    except Exception as error:
        log_failed_run(store, run_id, trigger, corpus_dir, started, error)
        raise


def log_failed_run(store: IndexStore, run_id: str, trigger: str, corpus_dir: str, started: datetime, error: Exception) -> None:
    current, name = store.manifest(), f"{run_id}-failed-{uuid.uuid4().hex}"
    reason = text.redact(F.lit((str(error).strip().splitlines() or [type(error).__name__])[0][:500]))
    once, stamp = store.spark.range(1), F.lit(started).cast("timestamp")
    nothing = C.ingestion_summary(store.spark.createDataFrame([], "outcome string, chunks int"))
    store.write(
        nothing.select(
            F.lit(run_id).alias("run_id"), F.lit(corpus_dir).alias("corpus_dir"), F.lit(trigger).alias("trigger"),
            F.lit("FAILED").alias("status"), stamp.alias("started_at"), F.current_timestamp().alias("finished_at"), "*",
            reason.alias("error_message"),
        ),
        "runs", name,
    )
    failure = once.select(F.lit(None).cast("string").alias("source_path"), C.event(F.lit("RUN"), "ERROR", reason).alias("event"))
    store.write(logged_events(failure.select("source_path", "event.*"), run_id, stamp), "events", name)
    store.publish(replace(current, version=current.version + 1, run_logs=[*current.run_logs, name]))


def apply_run(
    store: IndexStore, current: Manifest, corpus: DataFrame, run_id: str, trigger: str, corpus_dir: str, force: bool,
    options: Options, changes: DataFrame | None, batch_id: int | None, feed: DataFrame | None, started: datetime,
) -> Manifest:
    check_settings(current, options)
    stored = store.documents(current)
    # Paths and hashes only; the texts of unchanged documents are not moved.
    changes = persist_table(changes if changes is not None else C.classify_changes(corpus, stored, force), "changes")
    kinds = {row["change"] for row in changes.select("change").distinct().collect()}
    if kinds <= {"unchanged"}:
        published = publish_quiet_run(store, current, run_id, trigger, corpus_dir, changes, started, batch_id, feed)
        forget(changes)
        return published
    if kinds == {"added"}:
        entering = corpus.withColumn("change", F.lit("added"))
    else:
        touched = changes.where(F.col("change").isin("added", "updated")).select("source_path", "change")
        entering = corpus.join(touched, "source_path")
    work = persist_table(with_outcomes(prepared_documents(entering, options)).drop("content", "body"), "work")
    good = work.where(F.col("outcome").isin("added", "updated"))
    indexed = indexed_rows(good, run_id, started)
    failed = failed_rows(work.where(F.col("outcome") == "failed"), stored)
    gone = changes.where(F.col("change") == "removed").select("source_path")

    layers = current.layers
    if kinds & {"added", "updated"}:
        rows = prepare.chunk_rows(good, options.counter)
        embedded = embed.embed_with_provider(rows, "embedded_text", options.vectors()).withColumn("layer", F.lit(run_id))
        # Sorted, so that a lookup of a few chunks reads the pages that hold them.
        written = store.read(CHUNK_SCHEMA, store.write(embedded.sortWithinPartitions("chunk_id"), "chunks", run_id))
        terms = store.read(
            TERM_SCHEMA, store.write(keyword.chunk_terms(written, options.stemmer).withColumn("layer", F.lit(run_id)), "terms", run_id)
        )
        store.write(postings.posting_blocks(terms).withColumn("layer", F.lit(run_id)), "postings", run_id, **postings.STORED)
        layers = [*layers, run_id]
    frequencies = write_frequencies(store, current, run_id, run_id in layers, indexed.select("source_path").unionByName(gone))

    documents = store.write(snapshot(stored, indexed, failed, gone), "documents", run_id)
    superseded = current.superseded
    if current.documents:
        left = indexed.select("source_path").unionByName(gone)
        dead = stored.where(F.col("layer").isNotNull()).join(left, "source_path", "left_semi").select("document_id", "layer")
        superseded = store.write(store.superseded(current).unionByName(dead), "superseded", run_id)
    write_run_log(store, run_id, trigger, corpus_dir, changes, work, started)
    published = store.publish(
        replace(
            current, version=current.version + 1, run_id=run_id, batch_id=batch_id, documents=documents,
            superseded=superseded, feed=feed_path(store, current, run_id, feed), layers=layers,
            run_logs=[*current.run_logs, run_id], frequencies=frequencies, settings=options.settings(),
        )
    )
    forget(changes, work)
    return published


def write_frequencies(store: IndexStore, current: Manifest, run_id: str, has_layer: bool, left: DataFrame) -> list[str]:
    """Documents per lexeme that a run adds, less those of the documents that leave; a search sums these small tables."""
    if current.layers and not current.frequencies:
        return []
    parts = []
    if has_layer:
        parts.append(postings.lexeme_documents(store.read(POSTING_SCHEMA, store.path("postings", run_id))))
    if current.layers:
        dead = store.documents(current).join(left, "source_path", "left_semi").select("document_id")
        lost = keyword.lexeme_frequencies(store.terms(current).join(dead, "document_id", "left_semi"))
        parts.append(lost.withColumn("documents", -F.col("documents")))
    if not parts:
        return current.frequencies
    changes = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    counted = changes.groupBy("lexeme").agg(F.sum("documents").alias("documents")).where(F.col("documents") != 0)
    store.write(counted.sortWithinPartitions("lexeme"), "frequencies", run_id)
    return [*current.frequencies, run_id]


def feed_path(store: IndexStore, current: Manifest, run_id: str, feed: DataFrame | None) -> str | None:
    return current.feed if feed is None else store.write(feed, "feed", run_id)


def publish_quiet_run(
    store: IndexStore, current: Manifest, run_id: str, trigger: str, corpus_dir: str, changes: DataFrame,
    started: datetime, batch_id: int | None, feed: DataFrame | None,
) -> Manifest:
    """A run that found nothing to do is logged and keeps every table."""
    nothing = store.spark.createDataFrame([], QUIET_WORK)
    write_run_log(store, run_id, trigger, corpus_dir, changes, nothing, started)
    return store.publish(
        replace(
            current, version=current.version + 1, run_id=run_id, batch_id=batch_id,
            feed=feed_path(store, current, run_id, feed), run_logs=[*current.run_logs, run_id],
        )
    )


def run_outcomes(changes: DataFrame, work: DataFrame) -> DataFrame:
    """``(outcome, chunks)`` of every path of a run."""
    quiet = changes.where(F.col("change").isin("unchanged", "removed")).select(
        F.col("change").alias("outcome"), F.lit(0).alias("chunks")
    )
    return quiet.unionByName(work.select("outcome", F.col("chunk_count").alias("chunks")))


def write_run_log(
    store: IndexStore, run_id: str, trigger: str, corpus_dir: str, changes: DataFrame, work: DataFrame, started: datetime
) -> None:
    """The run's row and its events, replaced as a whole when the run is repeated."""
    counts = persist_table(C.ingestion_summary(run_outcomes(changes, work)), "summary")
    stamp = F.lit(started).cast("timestamp")
    run = counts.select(
        F.lit(run_id).alias("run_id"), F.lit(corpus_dir).alias("corpus_dir"), F.lit(trigger).alias("trigger"),
        F.lit("COMPLETED").alias("status"), stamp.alias("started_at"), F.current_timestamp().alias("finished_at"), "*",
        F.lit(None).cast("string").alias("error_message"),
    )
    store.write(run, "runs", run_id)
    whole_run = counts.select(
        F.explode(
            F.array(
                C.event(
                    F.lit("DISCOVER"), "INFO",
                    F.concat(F.lit("discovered "), F.col("documents_discovered").cast("string"), F.lit(f" documents in {corpus_dir}")),
                ),
                C.event(
                    F.lit("PERSIST"), "INFO",
                    F.concat(F.lit("removed "), F.col("documents_removed").cast("string"), F.lit(" documents no longer in the corpus")),
                ),
            )
        ).alias("event"),
        "documents_removed",
    ).where((F.col("event.phase") == "DISCOVER") | (F.col("documents_removed") > 0))
    general = whole_run.select(F.lit(None).cast("string").alias("source_path"), "event.*")
    single = C.document_events(work.withColumn("chunks", F.col("chunk_count")))
    store.write(logged_events(general.unionByName(single), run_id, stamp), "events", run_id)


def logged_events(events: DataFrame, run_id: str, stamp: Column) -> DataFrame:
    """Events of one run share their time; their ids rise with the phase."""
    phase = F.coalesce(F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")), F.lit(0)).cast("bigint")
    number = F.shiftrightunsigned(F.xxhash64("source_path", "phase", "message"), 8)
    return events.select(
        F.lit(run_id).alias("run_id"), F.shiftleft(phase, 56).bitwiseOR(number).alias("event_id"), "source_path",
        "phase", "level", text.redact(F.col("message")).alias("message"), stamp.alias("created_at"),
    )


def open_index(store: IndexStore, options: Options = Options()) -> Index:
    """The published index for retrieval plans, with the provider and the stemmer that it was made with."""
    manifest = store.manifest()
    check_settings(manifest, options)
    terms = store.terms(manifest)
    frequencies = store.frequencies(manifest)
    if frequencies is None:
        frequencies = keyword.lexeme_frequencies(terms)
    return Index(
        store.documents(manifest), store.chunks(manifest), terms, frequencies, options.vectors().dimensions, options.stemmer,
        options.provider, store.postings(manifest), store.superseded(manifest) if len(manifest.layers) > 1 else None,
    )


