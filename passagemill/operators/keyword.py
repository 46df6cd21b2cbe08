"""Keyword arm: postings, rank, term frequencies and the vector-arm rewrite."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import constants as K
from passagemill.functions import stem, text
from passagemill.operators.vector import GRID_TASKS, SCORE_DIGITS, RunningTopK, arrow_schema, as_objects, ranked

Stemmer = Callable[[Column], Column]
# Question lexemes that may be sent to every task, and that a task of the grid holds beyond that.
BROADCAST_ROWS = ROW_LEXEMES = 500_000
# Buckets of 32,768 bits that mark the lexemes of all questions: one megabyte, however many there are.
MARK_BUCKETS, BUCKET_BITS = 256, 32_768


TERMS_TYPE = "array<struct<lexeme: string, tf: int, weight: double>>"


def counted_terms(lexemes: Column) -> Column:
    """Distinct lexemes of each list with their count and rank part.

    One vectorised count per Arrow batch instead of exploding, shuffling and regrouping every token.
    """

    def count(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        keys, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
        inverse_squares = np.cumsum(1.0 / np.arange(1, tf.max(initial=1) + 1.0) ** 2)
        weight = K.LEXEME_WEIGHT * inverse_squares[tf - 1] / K.INVERSE_SQUARE_LIMIT
        entries = pa.StructArray.from_arrays(
            [words.dictionary.take(pa.array(keys % size)), pa.array(tf, pa.int32()), pa.array(weight)],
            ["lexeme", "tf", "weight"],
        )
        starts = np.searchsorted(keys // size, np.arange(len(lists) + 1))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries)

    return F.arrow_udf(count, TERMS_TYPE).asNondeterministic()(lexemes)


def chunk_terms(chunks: DataFrame, stemmer: Stemmer = stem.identity) -> DataFrame:
    """Postings per chunk: ``terms`` of lexeme, ``tf`` and ``weight`` from breadcrumb and content. No shuffle.

    ``weight`` is the lexeme's part of the rank: 0.1 times the sum of 1/j^2 over its occurrences.
    """
    searched = F.concat_ws(" ", "breadcrumb", "content")
    return chunks.select(
        "chunk_id", "document_id", "doc_type", counted_terms(stemmer(text.lexemes(searched))).alias("terms")
    )


def build_postings(chunks: DataFrame, stemmer: Stemmer = stem.identity) -> DataFrame:
    """Inverted index ``(lexeme, chunk_id, document_id, doc_type, tf, weight)``, one row per chunk and lexeme."""
    return postings_of(chunk_terms(chunks, stemmer))


def postings_of(terms: DataFrame) -> DataFrame:
    return terms.select(
        *[name for name in terms.columns if name != "terms"], F.explode("terms").alias("term")
    ).select("*", "term.*").drop("term")


def lexeme_frequencies(terms: DataFrame) -> DataFrame:
    """Documents per lexeme. A document's lexemes meet as lists, so no row per document and lexeme is moved or spilled."""
    lists = terms.select("document_id", F.col("terms.lexeme").alias("lexemes"))
    known = lists.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.flatten(F.collect_list("lexemes")).alias("lexemes"))
    words = known.select(F.explode(F.array_distinct("lexemes")).alias("lexeme"))
    # Chunks without a document count as one document, which may be large.
    unknown = lists.where(F.col("document_id").isNull()).select(F.explode("lexemes").alias("lexeme")).distinct()
    return words.unionAll(unknown).groupBy("lexeme").agg(F.count("*").alias("documents"))


def split_questions(questions: DataFrame) -> DataFrame:
    """Search terms and the keyword form of each question."""
    return questions.select(
        "query_id",
        text.split_terms(F.col("question")).alias("terms"),
        text.keyword_query(F.col("question")).alias("keyword_query"),
    )


def question_lexemes(questions: DataFrame, stemmer: Stemmer = stem.identity) -> DataFrame:
    kind = F.col("doc_type") if "doc_type" in questions.columns else F.lit(None).cast("string")
    distinct = questions.select(
        "query_id", kind.alias("wanted_type"),
        F.array_distinct(stemmer(text.lexemes(F.col("question")))).alias("lexemes"),
    )
    return distinct.select("query_id", "wanted_type", F.size("lexemes").alias("n"), F.explode("lexemes").alias("lexeme"))


def keyword_topk(
    questions: DataFrame, terms: DataFrame, k: int = K.CANDIDATES, stemmer: Stemmer = stem.identity,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(query_id, chunk_id, raw_score, rank)``: chunks with any lexeme of the question, best ``k``.

    Question lexemes of checked number go to every task, which scores each chunk in place and keeps
    a running top-k. Beyond the bound both sides are dealt to a grid (see ``grid_scores``).
    """
    wanted = question_lexemes(questions, stemmer)
    block = wanted.limit(broadcast_rows + 1).toArrow()
    if block.num_rows > broadcast_rows:
        return ranked(grid_scores(wanted, terms, k), k)
    result = score_type(wanted, terms)
    return ranked(scanned_scores(block, terms, result, k), k)


def score_type(wanted: DataFrame, terms: DataFrame) -> T.StructType:
    return T.StructType([wanted.schema["query_id"], terms.schema["chunk_id"], T.StructField("raw_score", T.DoubleType())])


def asked_marks(wanted: DataFrame) -> np.ndarray:
    """One bit for each place that a lexeme of ``wanted`` may have (see ``only_asked``), of a number of bits that is fixed."""
    place = wanted.select(F.pmod(F.xxhash64("lexeme"), F.lit(MARK_BUCKETS * BUCKET_BITS)).alias("place"))
    bucket, bit = F.floor(F.col("place") / BUCKET_BITS).cast("int"), F.pmod("place", F.lit(BUCKET_BITS))
    marks = np.zeros((MARK_BUCKETS, BUCKET_BITS // 8), dtype=np.uint8)
    for row in place.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        marks[row.bucket] = np.frombuffer(row.bits, dtype=np.uint8)
    return marks.ravel()


def only_asked(terms: DataFrame, marks: np.ndarray) -> DataFrame:
    """``chunk_id``, ``doc_type``, ``lexemes`` and ``weights`` of each chunk, without most lexemes that no question asks for."""
    shared = terms.sparkSession.sparkContext.broadcast(marks)
    places = F.transform("terms", lambda term: F.pmod(F.xxhash64(term["lexeme"]), F.lit(MARK_BUCKETS * BUCKET_BITS)))
    arrays = terms.select("chunk_id", "doc_type", F.col("terms.lexeme").alias("lexemes"), F.col("terms.weight").alias("weights"), places.alias("places"))
    kept = T.StructType([*arrays.schema.fields[:2], T.StructField("lexemes", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch["places"]), 0).to_numpy(zero_copy_only=False)
            place = batch["places"].flatten().to_numpy(zero_copy_only=False)
            asked = (shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            row = np.repeat(np.arange(len(counts)), counts)[asked]
            starts = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, batch[name].flatten().filter(pa.array(asked))) for name in ("lexemes", "weights")]
            full = pa.RecordBatch.from_arrays([batch["chunk_id"], batch["doc_type"], *lists], schema=arrow_schema(kept))
            yield full.filter(pc.greater(pc.list_value_length(full["lexemes"]), 0))

    return arrays.mapInArrow(prune, kept)


def grid_rows(wanted: DataFrame, offered: DataFrame, row_lexemes: int) -> DataFrame:
    """Question lexemes (``kind`` 0) and chunks (1) dealt to the cells ``(row, slice)`` of the grid, one partition each.

    A chunk is copied once a row, and there are no more rows than the memory of a task asks for; a question once a slice. Each cell
    has its questions first, then its chunks by id.
    """
    rows = max(1, -(-wanted.count() // row_lexemes))
    slices = max(1, -(-GRID_TASKS * wanted.sparkSession.sparkContext.defaultParallelism // rows))
    nulls = lambda frame, name: F.lit(None).cast(frame.schema[name].dataType).alias(name)
    left = wanted.select(
        F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("kind"), "query_id", "wanted_type", "n", "lexeme", *(nulls(offered, name) for name in offered.columns),
    )
    right = offered.select(
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(1).alias("kind"), *(nulls(wanted, name) for name in ("query_id", "wanted_type", "n", "lexeme")), *offered.columns,
    )
    dealt = left.unionByName(right).repartitionById(rows * slices, (F.col("row") * slices + F.col("slice")).cast("int"))
    return dealt.sortWithinPartitions("row", "slice", "kind", "chunk_id")


def grid_scores(wanted: DataFrame, terms: DataFrame, k: int, row_lexemes: int = ROW_LEXEMES) -> DataFrame:
    """Best ``k`` chunks of each question in each cell of a grid of questions and chunks.

    A chunk moves once for each row of the grid, with the lexemes that are asked for; no row is made for a question and a chunk
    but the best. Rows of one chunk count as one.
    """
    result = score_type(wanted, terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, waiting, scorer = None, [], None, None
        for batch in batches:
            marks = np.stack([batch[name].to_numpy() for name in ("row", "slice", "kind")], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges], [*edges, len(marks)]):
                if start == end:
                    continue
                cell, part = tuple(marks[start, :2]), batch.slice(start, end - start)
                if cell != current:
                    if scorer is not None:
                        yield scorer.finished(waiting, result)
                    current, asked, waiting, scorer = cell, [], None, None
                if marks[start, 2] == 0:
                    asked.append(part)
                elif asked:
                    scorer = scorer or LexemeScorer(pa.Table.from_batches(asked), k)
                    waiting = scorer.add_whole(part, waiting)
        if scorer is not None:
            yield scorer.finished(waiting, result)

    return grid_rows(wanted, only_asked(terms, asked_marks(wanted)), row_lexemes).mapInArrow(scan, result)


def by_chunk(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of equal ``chunk_id`` that follow each other as one, and where each began."""
    ids = batch["chunk_id"].dictionary_encode(null_encoding="encode").indices.to_numpy()
    firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["lexemes"]).to_numpy())])
    offsets = pa.array(np.append(ends[firsts], ends[-1]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, batch[name].flatten()) for name in ("lexemes", "weights")]
    scalars = [batch[name].take(pa.array(firsts)) for name in ("chunk_id", "doc_type")]
    return pa.RecordBatch.from_arrays([*scalars, *lists], ["chunk_id", "doc_type", "lexemes", "weights"]), firsts


def scanned_scores(block: pa.Table, terms: DataFrame, result: T.StructType, k: int) -> DataFrame:
    """Best ``k`` chunks of each question per partition, from one pass over the chunk terms."""
    shared = terms.sparkSession.sparkContext.broadcast(block)
    arrays = terms.select("chunk_id", "doc_type", F.col("terms.lexeme").alias("lexemes"), F.col("terms.weight").alias("weights"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = LexemeScorer(shared.value, k)
        for batch in batches:
            scorer.add_blocks(batch)
        yield scorer.batch(arrow_schema(result))

    return arrays.mapInArrow(scan, result)


class LexemeScorer(RunningTopK):
    """Scores chunks by the lexemes they share with each question."""

    def __init__(self, block: pa.Table, k: int) -> None:
        kinds: dict = {}
        names = block["query_id"].to_pylist()
        for name, kind in zip(names, block["wanted_type"].to_pylist()):
            kinds.setdefault(name, kind)
        super().__init__(list(kinds), list(kinds.values()), k)
        places = {name: place for place, name in enumerate(self.ids)}
        asked = block.select(["n", "lexeme"]).to_pandas()
        asked["place"] = np.array([places[name] for name in names], dtype=np.int64)
        asked = asked.sort_values("lexeme", kind="stable")
        vocabulary, self.starts = np.unique(asked["lexeme"].to_numpy(object).astype(str), return_index=True)
        self.vocabulary = pa.array(vocabulary)
        self.starts = np.append(self.starts, len(asked))
        self.askers = asked["place"].to_numpy(np.int64)
        self.shares = 1.0 / asked["n"].to_numpy(np.float64)

    def add_blocks(self, batch: pa.RecordBatch) -> None:
        step = self.rows_per_block()
        for start in range(0, batch.num_rows, step):
            self.add(batch.slice(start, step))

    def add_whole(self, batch: pa.RecordBatch, waiting: pa.RecordBatch | None) -> pa.RecordBatch:
        """Scores the chunks of ``batch``, after ``waiting``, but the last one, which may go on in the next batch and is returned."""
        batch = batch.select(["chunk_id", "doc_type", "lexemes", "weights"])
        if waiting is not None:
            batch = pa.concat_batches([waiting, batch])
        whole, firsts = by_chunk(batch)
        self.add_blocks(whole.slice(0, len(firsts) - 1))
        return batch.slice(firsts[-1])

    def finished(self, waiting: pa.RecordBatch, result: T.StructType) -> pa.RecordBatch:
        self.add_blocks(by_chunk(waiting)[0])
        return self.batch(arrow_schema(result))

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not self.ids:
            return
        lexemes = batch["lexemes"]
        known = pc.index_in(lexemes.flatten(), value_set=self.vocabulary)
        hit = known.is_valid().to_numpy(zero_copy_only=False)
        if not hit.any():
            return
        lexeme = known.drop_null().to_numpy()
        weight = batch["weights"].flatten().to_numpy(zero_copy_only=False)[hit]
        chunk = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lexemes).to_numpy())[hit]
        # Every matched lexeme counts for all questions that ask for it.
        askers = self.starts[lexeme + 1] - self.starts[lexeme]
        first = np.repeat(self.starts[lexeme] - np.cumsum(askers) + askers, askers)
        entry = first + np.arange(askers.sum())
        cells = np.repeat(chunk, askers) * len(self.ids) + self.askers[entry]
        sums = np.bincount(cells, np.repeat(weight, askers) * self.shares[entry], batch.num_rows * len(self.ids))
        scores = np.round(sums.reshape(batch.num_rows, len(self.ids)), SCORE_DIGITS)
        scores[scores <= 0] = -np.inf
        self.offer(as_objects(batch["chunk_id"]), scores, as_objects(batch["doc_type"]))


def term_document_counts(
    questions: DataFrame, frequencies: DataFrame, documents: DataFrame, stemmer: Stemmer = stem.identity
) -> DataFrame:
    """Documents containing each term of a question, 0 if none, and the size of the corpus."""
    terms = questions.select("query_id", F.array_distinct(text.lexemes(F.col("question"))).alias("terms"))
    paired = terms.select("query_id", F.arrays_zip("terms", stemmer(F.col("terms")).alias("stems")).alias("pairs"))
    asked = paired.select("query_id", F.explode("pairs").alias("pair")).select(
        "query_id", F.col("pair.terms").alias("term"), F.col("pair.stems").alias("lexeme")
    )
    total = documents.agg(F.count("*").alias("n")).scalar()
    return asked.join(frequencies, "lexeme", "left").select(
        "query_id", "term", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        total.alias("total_documents"),
    )


def rewrite_query(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``vector_text``, the question without terms of a majority of documents, and ``dropped_terms``."""
    common = (
        counts.where(F.col("documents") > F.col("total_documents") * K.MAX_DOCUMENT_FRACTION)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("term")).alias("common"))
    )
    none = F.array().cast("array<string>")
    joined = questions.join(common, "query_id", "left").withColumn("common", F.coalesce("common", none))
    surviving = F.filter(text.split_terms(F.col("question")), lambda term: ~F.array_contains("common", term))
    rewritten = joined.withColumn("dropped_terms", F.when(F.size(surviving) > 0, F.col("common")).otherwise(none))
    return rewritten.withColumn(
        "vector_text",
        F.when(F.size("dropped_terms") > 0, text.strip_terms(F.col("question"), F.col("dropped_terms"))).otherwise(
            F.col("question")
        ),
    ).drop("common")
