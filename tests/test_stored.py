"""The stored search: blocks by lexeme, what the scan is asked for, blocks left out, and equality with the whole scan."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from passagemill.functions import markdown
from passagemill.operators import keyword, postings
from passagemill.plans import retrieval
from passagemill.plans.ingest import Options, open_index, run_ingest
from passagemill.sources.corpus import with_hash
from passagemill.sources.index_store import IndexStore

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def corpus(spark, count, seed=1, first=0):
    pick, rows = random.Random(seed), []
    for i in range(first, first + count):
        words = [f"w{min(int(pick.paretovariate(0.7)), 400)}" for _ in range(pick.randrange(5, 60))] + ["everywhere"] * pick.randrange(1, 4)
        pick.shuffle(words)
        rows.append((f"{'memo' if i % 3 else 'note'}s/2025-01-{1 + i % 28:02d}-x{i}.md", " ".join(words)))
    return with_hash(spark.createDataFrame(rows, "source_path string, content string"))


def rows_of(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.raw_score, 8)) for r in hits.collect())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two layers: some documents are replaced, some are gone."""
    store = IndexStore(spark, str(tmp_path_factory.mktemp("store") / "index"))
    options = Options(dimensions=8, limits=markdown.ChunkLimits(budget=25, overlap=0, minimum=1))
    run_ingest(store, corpus(spark, 300), "r1", options=options, now=NOW)
    later = corpus(spark, 200).unionByName(corpus(spark, 60, 2, 400)).withColumn(
        "content", F.when(F.col("source_path").contains("x7"), F.concat("content", F.lit(" w3 renewed"))).otherwise(F.col("content"))
    )
    run_ingest(store, with_hash(later.drop("content_hash")), "r2", options=options, now=NOW)
    return store, options


def asked(spark, count=25):
    pick = random.Random(8)
    rows = [(i, " ".join(["everywhere", *(f"w{pick.randrange(1, 40)}" for _ in range(pick.randrange(1, 6)))])) for i in range(count)]
    return spark.createDataFrame([*rows, (900, "renewed"), (901, "unheard of"), (902, "")], "query_id long, question string")


def test_stored_search_equals_the_scan(spark, store):
    store, options = store
    index, manifest = open_index(store, options), store.manifest()
    want = rows_of(keyword.keyword_topk(asked(spark), store.terms(manifest), stemmer=options.stemmer))
    assert want and rows_of(retrieval.keyword_arm(asked(spark), index)) == want
    for settings in ({"pruned_from": 0}, {"broadcast_rows": 0}):
        assert rows_of(postings.stored_topk(asked(spark), index.postings, stemmer=options.stemmer, gone=index.gone, **settings)) == want
    typed = asked(spark).withColumn("doc_type", F.when(F.col("query_id") % 2 == 0, "memo").otherwise("note"))
    want = rows_of(keyword.keyword_topk(typed, store.terms(manifest), stemmer=options.stemmer))
    assert rows_of(postings.stored_topk(typed, index.postings, stemmer=options.stemmer, gone=index.gone, pruned_from=0)) == want
    fewer = {r.lexeme: r.documents for r in index.frequencies.collect()}
    assert fewer == {r.lexeme: r.documents for r in keyword.lexeme_frequencies(store.terms(manifest)).collect()}


@pytest.mark.parametrize("batch, size", [(3, 4), (50, 7), (10_000, 512)])
def test_blocks_hold_every_posting_once(spark, batch, size):
    chunks = corpus(spark, 80).select(
        F.concat("source_path", F.lit("#"), F.lit("0")).alias("chunk_id"), F.substring("source_path", 1, 17).alias("document_id"),
        F.lit("memo").alias("doc_type"), F.lit("").alias("breadcrumb"), "content",
    )
    terms = keyword.chunk_terms(chunks)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        blocks = postings.posting_blocks(terms, size).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    found = sorted((b.lexeme, e.chunk_id, round(e.weight, 9)) for b in blocks for e in b.entries)
    assert found == sorted((r.lexeme, r.chunk_id, round(r.weight, 9)) for r in keyword.postings_of(terms).collect())
    assert all(len(b.entries) == b.postings <= size and b.most == max(e.weight for e in b.entries) for b in blocks)
    counts: dict[str, int] = {}
    for b in blocks:
        counts[b.lexeme] = counts.get(b.lexeme, 0) + b.documents
    assert counts == {r.lexeme: r.documents for r in keyword.lexeme_frequencies(terms).collect()}


def test_lexemes_reach_the_scan(spark, store):
    store, options = store
    index = open_index(store, options)
    plan = postings.having(index.postings, "lexeme", ["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme, [w1,w2])]" in plan.replace("\n", "")


def test_blocks_that_cannot_matter_stay_closed(spark):
    """Only the blocks with strong postings of a common word are left once twenty passages have them."""
    entry = lambda i, w: (f"c{i}", f"d{i}", None, w)
    strong = ("word", 30, 30, 0.09, [entry(i, 0.09) for i in range(30)], "r")
    weak = [("word", 10, 10, 0.06, [entry(100 + 10 * b + i, 0.06) for i in range(10)], "r") for b in range(20)]
    blocks = spark.createDataFrame([strong, *weak], postings.BLOCK_SCHEMA + ", layer string")
    questions = spark.createDataFrame([(1, "word")], "query_id long, question string")
    lexemes = keyword.question_lexemes(questions).toArrow()
    result = postings.T.StructType([
        postings.T.StructField("query_id", postings.T.LongType()), postings.T.StructField("chunk_id", postings.T.StringType()),
        postings.T.StructField("raw_score", postings.T.DoubleType()),
    ])
    need = postings.needed_weights(lexemes, blocks, None, result, 20).first()
    assert 0.06 < need.need < 0.09
    found = postings.stored_topk(questions, blocks, pruned_from=0).collect()
    assert {r.chunk_id for r in found} <= {f"c{i}" for i in range(30)} and len(found) == 20


def test_blocks_of_pieces_hold_every_posting_once(spark):
    """Chunks of one document in several partitions, pieces smaller than a document, chunks without a document."""
    rows = [(f"c{i:03d}", None if i % 9 == 0 else f"d{i % 13}", None, [("everywhere", 1, 0.06), (f"w{i % 5}", 1, 0.06 + i / 1e4)]) for i in range(90)]
    terms = spark.createDataFrame(rows, f"chunk_id string, document_id string, doc_type string, terms {keyword.TERMS_TYPE}").repartition(7)
    blocks = postings.posting_blocks(terms, 4, piece=10).collect()
    found = sorted((b.lexeme, e.chunk_id, e.document_id or "", e.weight) for b in blocks for e in b.entries)
    assert found == sorted((t[0], c, d or "", t[2]) for c, d, _, held in rows for t in held)
    counts: dict[str, int] = {}
    for b in blocks:
        counts[b.lexeme] = counts.get(b.lexeme, 0) + b.documents
    known = {d for _, d, _, _ in rows if d}
    assert counts["everywhere"] == len(known) + 10


def test_postings_are_not_moved(spark):
    """Whole chunks are shuffled, and blocks meet any number of lexemes where they lie."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    blocks = spark.createDataFrame([("w1", 1, 1, 0.06, [("c", "d", None, 0.06)], "r")], postings.BLOCK_SCHEMA + ", layer string")
    many = postings.having(blocks, "lexeme", [f"w{i}" for i in range(postings.PUSHED_VALUES + 1)])
    assert "BroadcastHashJoin" in plan(many) and "SortMergeJoin" not in plan(many) and many.count() == 1
    terms = spark.createDataFrame([("c", "d", None, [("w1", 1, 0.06)])], f"chunk_id string, document_id string, doc_type string, terms {keyword.TERMS_TYPE}")
    assert "Generate" not in plan(postings.posting_blocks(terms))


def test_frequencies_count_documents_once(spark):
    rows = [("a", "d1", ["x", "y"]), ("b", "d1", ["x"]), ("c", "d2", ["x"]), ("d", None, ["x", "z"]), ("e", None, ["x"]), ("f", "d3", [])]
    terms = spark.createDataFrame(
        [(c, d, [(w, 1, 0.06) for w in words]) for c, d, words in rows], f"chunk_id string, document_id string, terms {keyword.TERMS_TYPE}"
    )
    frequencies = keyword.lexeme_frequencies(terms)
    assert {r.lexeme: r.documents for r in frequencies.collect()} == {"x": 3, "y": 1, "z": 1}
    # No aggregate is keyed by document and lexeme.
    plan = frequencies._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [document_id" in line and "lexeme" in line.split("]")[0]]


@pytest.mark.parametrize("wanted", [0, 1, 51, postings.PUSHED_VALUES])
def test_long_lists_of_values_reach_the_scan(spark, tmp_path, wanted):
    """As many values as are ever pushed, whatever the stack of the reading thread."""
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), "id")
    rows.unionByName(spark.createDataFrame([(None, -1)], rows.schema)).coalesce(1).sortWithinPartitions("chunk_id").write.parquet(str(tmp_path / "rows"))
    written = spark.read.parquet(str(tmp_path / "rows"))
    values = [row.chunk_id for row in written.where(F.col("id") >= 0).orderBy("id").limit(wanted).collect()]
    found = postings.having(written, "chunk_id", values)
    assert sorted(row.id for row in found.collect()) == list(range(wanted))
    assert postings.having(written, "chunk_id", [*values, None]).count() == wanted
    if wanted:
        assert "PushedFilters: []" not in found._jdf.queryExecution().executedPlan().toString()
