"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import catalog_queries as catalog
from passagemill.operators import duplicates, embed, keyword, limiter, prepare, stats, vector
from passagemill.plans import evaluation, retrieval
from passagemill.plans.answering import answer_batch
from passagemill.plans.ingest import run_ingest
from passagemill.operators import evaluate
from passagemill.session import local_session, persist_table
from passagemill.sources import corpus as S
from passagemill.sources.index_store import IndexStore


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object]) -> object:
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
        return result

    # Start the Python workers and compile the common stages outside the measurements.
    run(retrieval.hybrid_search(catalog.questions(spark, catalog_smoke()), catalog.library_index(spark, catalog_smoke())))

    library, asked = S.library_corpus(spark, sf_dir), catalog.questions(spark, sf_dir)
    documents, n_questions = library.count(), asked.count()
    timed("chunk_corpus", lambda: run(prepare.chunk_corpus(S.markdown_corpus(spark, sf_dir))))
    timed("hash_embedding", lambda: run(embed.hash_embedding(library, "doc_id", "content", catalog.DIMENSIONS)))
    timed("build_postings", lambda: run(keyword.build_postings(prepare.whole_text_chunks(library))))
    index = timed("build_index", lambda: retrieval.build_index(library, catalog.DIMENSIONS))
    timed("keyword_topk", lambda: run(retrieval.keyword_arm(asked, index)))
    timed("hybrid_search", lambda: run(retrieval.hybrid_search(asked, index)))
    timed("answer_batch", lambda: run(answer_batch(asked, index)))
    suite = timed("benchmark_suite", lambda: catalog.library_suite(spark, sf_dir))
    hits = timed("mode_hits", lambda: persist_table(evaluation.mode_hits(suite, index), "bench-hits"))
    answerable = suite.where(F.col("type") == "answerable")
    quality = timed("compare_modes", lambda: evaluate.compare_modes(evaluate.query_outcomes(answerable, hits)).collect())

    vectors, points = catalog.vector_questions(spark, sf_dir), catalog.vector_chunks(spark, sf_dir)
    timed("vector_topk", lambda: run(vector.vector_topk(vectors, points, catalog.DIMENSIONS)))
    timed("vector_topk_ann", lambda: run(vector.vector_topk_ann(vectors, points, catalog.DIMENSIONS, cells=32, probes=24)))

    store = IndexStore(spark, catalog.run_folder(spark, "bench-index"))
    present = S.table_corpus(spark, sf_dir)
    changed = present.withColumn(
        "content", F.when(F.col("source_path").startswith("src1/") | F.col("source_path").startswith("src2/"),
                          F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    )
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    timed("ingest_all", lambda: run_ingest(store, present, "r1", now=now))
    timed("ingest_unchanged", lambda: run_ingest(store, present, "r2", now=now))
    timed("ingest_tenth_changed", lambda: run_ingest(store, S.with_hash(changed.drop("content_hash")), "r3", now=now))

    stored = timed("stored_index", lambda: catalog.stored_library(spark, sf_dir))
    timed("keyword_topk_stored", lambda: run(retrieval.keyword_arm(asked, stored)))
    timed("hybrid_search_stored", lambda: run(retrieval.hybrid_search(asked, stored)))

    ids = library.select(prepare.document_id(F.col("source_path")).alias("document_id"), "content")
    timed("corpus_near_duplicates", lambda: run(duplicates.corpus_near_duplicates(ids)))
    timed("line_duplication", lambda: run(prepare.line_duplication(catalog.raw_texts(spark, sf_dir))))
    log = catalog.log(spark, sf_dir)
    timed("query_stats", lambda: run(stats.query_stats(log, catalog.as_of())))
    timed("top_queries", lambda: run(stats.top_queries(log, catalog.as_of())))
    timed("volume_by_day", lambda: run(stats.volume_by_day(log, catalog.as_of())))
    calls = catalog.caller_events(spark, sf_dir)
    timed("rate_limit_audit", lambda: run(limiter.rate_limit_audit(calls, 2, 86_400_000, 3)))

    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "documents": documents,
        "questions": n_questions,
        "documents_per_second": {
            name: round(documents / seconds[name], 1) for name in ("chunk_corpus", "build_postings", "build_index", "ingest_all")
        },
        "questions_per_second": {name: round(n_questions / seconds[name], 1) for name in ("hybrid_search", "answer_batch")},
        "quality": {row["mode"]: {"recall": row.recall, "mrr": row.mrr, "full": row.full_hit_rate} for row in quality},
    }
    print(json.dumps(result), flush=True)
    spark.stop()


def catalog_smoke() -> str:
    return "/root/testdata/sf0.001"


if __name__ == "__main__":
    main()
