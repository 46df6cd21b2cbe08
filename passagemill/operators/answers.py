"""Answer assembly for a table of questions and their ranked passages.

Passages are ``(query_id, pos, chunk_id, score, content, breadcrumb, …)`` rows, at most a few per
question, so grouping them by question is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text

CITATIONS = (
    "array<struct<marker: int, source_index: int, chunk_id: string, document_id: string, document_title: string, "
    "source_path: string, breadcrumb: string>>"
)


def minimum_fused_score(k: int = K.RRF_K, candidates: int = K.CANDIDATES) -> float:
    """First in one arm and last candidate of the other: both arms agree on some passage."""
    return 1 / (k + 1) + 1 / (k + candidates)


def score_floor(questions: DataFrame, passages: DataFrame, floor: float | None = None) -> DataFrame:
    """Adds ``top_score`` and ``abstain_reason`` to questions; questions without hits abstain too."""
    limit = minimum_fused_score() if floor is None else floor
    top = passages.groupBy("query_id").agg(F.max("score").alias("top_score"))
    below = F.coalesce("top_score", F.lit(0.0)) < limit
    return questions.join(top, "query_id", "left").withColumn(
        "abstain_reason", F.when(F.col("top_score").isNull() | below, "NO_RELEVANT_CONTEXT")
    )


def near_duplicate_suppression(passages: DataFrame) -> DataFrame:
    """Keeps a passage unless it repeats an earlier kept one; adds ``source_no`` among the kept."""
    measured = passages.select(
        "query_id", F.struct("pos", "chunk_id", text.distinct_words(F.col("content")).alias("words")).alias("passage")
    )
    in_order = F.array_sort(F.collect_list("passage"))
    nothing = F.array().cast("array<struct<pos: int, chunk_id: string, words: array<string>>>")

    def keep_first(kept: Column, passage: Column) -> Column:
        repeats = F.exists(
            kept, lambda earlier: text.overlap_ratio(passage["words"], earlier["words"]) >= K.DUPLICATE_OVERLAP
        )
        return F.when(repeats, kept).otherwise(F.array_append(kept, passage))

    kept = measured.groupBy("query_id").agg(in_order.alias("passages")).select(
        "query_id", F.posexplode(F.aggregate("passages", nothing, keep_first)).alias("place", "passage")
    )
    numbered = kept.select("query_id", F.col("passage.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("source_no"))
    return passages.join(numbered, ["query_id", "chunk_id"])


def prompt_table(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """System and user text per question for an external batch model; sources carry ``source_no``."""
    block = F.concat(
        F.lit("["), F.col("source_no").cast("string"), F.lit("] "), F.col("breadcrumb"), F.lit("\n"), F.col("content")
    )
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("source_no", block.alias("block")))), lambda entry: entry["block"]
    )
    listed = sources.groupBy("query_id").agg(F.array_join(blocks, "\n\n---\n\n").alias("sources_text"))
    return questions.join(listed, "query_id", "left").select(
        "query_id",
        F.lit(K.SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(
            F.lit("SOURCES\n"), F.coalesce("sources_text", F.lit("")), F.lit("\n\nQUESTION\n"), F.col("question")
        ).alias("user_prompt"),
    )


def extractive_answers(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Answer text from the sentences that share most content words with the question, or the sentinel."""
    words = questions.select("query_id", text.content_words(F.col("question")).alias("keywords"))
    found = sources.select(
        "query_id", "source_no", F.posexplode(text.sentences(F.col("content"))).alias("place", "sentence")
    )
    score = F.size(F.array_intersect(text.content_words(F.col("sentence")), F.col("keywords")))
    scored = (
        found.join(words, "query_id")
        .withColumn("score", score)
        .where(F.col("score") >= K.MIN_SENTENCE_OVERLAP)
        .withColumn("key", F.regexp_replace(F.lower("sentence"), r"[^A-Za-z0-9_]+", ""))
    )
    best = [F.desc("score"), F.asc("source_no"), F.asc("place")]
    first = scored.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*best)))
    chosen = (
        first.where(F.col("copy") == 1)
        .withColumn("choice", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
        .where(F.col("choice") <= K.MAX_SENTENCES)
    )
    line = F.concat(F.col("sentence"), F.lit(" ["), F.col("source_no").cast("string"), F.lit("]"))
    reading_order = F.array_sort(F.collect_list(F.struct("source_no", "choice", line.alias("line"))))
    answers = chosen.groupBy("query_id").agg(
        F.array_join(F.transform(reading_order, lambda entry: entry["line"]), " ").alias("answer")
    )
    return questions.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(K.NO_ANSWER)).alias("answer")
    )


def is_abstention(answer: Column) -> Column:
    """True for the bare sentinel, also inside a code fence; a sentinel within prose is no refusal."""
    unfenced = F.regexp_replace(text.trim_space(answer), r"(?i)^```[a-z]*\s*|\s*```$", "")
    return F.upper(F.regexp_replace(unfenced, r"[.*_`\s]", "")) == K.NO_ANSWER.replace("_", "")


def detect_abstention(answers: DataFrame) -> DataFrame:
    return answers.withColumn("declined", is_abstention(F.col("answer")))


def validate_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolves ``[n]`` markers against the numbered sources.

    Adds ``citations`` (first appearance first), ``dropped_markers`` and ``text`` without the
    dropped markers. Unknown markers, zero included, are dropped.
    """
    digits = F.regexp_extract_all("answer", F.lit(r"\[(\d{1,3})\]"), 1)
    first_places = (
        answers.select("query_id", F.posexplode(digits).alias("place", "digits"))
        .groupBy("query_id", F.col("digits").cast("int").alias("marker"))
        .agg(F.min("place").alias("place"))
    )
    known = sources.select(
        "query_id", F.col("source_no").alias("marker"),
        F.struct(
            (F.col("source_no") - 1).alias("source_index"), "chunk_id", "document_id", F.col("title").alias("document_title"),
            "source_path", "breadcrumb",
        ).alias("source"),
    )
    citation = F.when(F.col("source").isNotNull(), F.struct("place", "marker", "source"))
    unknown = F.when(F.col("source").isNull(), F.col("marker"))
    resolved = (
        first_places.join(known, ["query_id", "marker"], "left")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(citation)).alias("cited"), F.array_sort(F.collect_list(unknown)).alias("dropped"))
    )
    no_numbers = F.array().cast("array<int>")
    joined = answers.join(resolved, "query_id", "left").withColumn(
        "dropped_markers", F.coalesce("dropped", no_numbers)
    )
    # Leading zeros name the same marker; a marker has at most three digits.
    pattern = F.concat(F.lit(r"\[(?=\d{1,3}\])0*(?:"), F.array_join(F.col("dropped_markers").cast("array<string>"), "|"), F.lit(r")\]"))
    bare = F.regexp_replace(F.col("answer"), pattern, F.lit(""))
    tidy = F.regexp_replace(F.regexp_replace(bare, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " ")
    return joined.select(
        *answers.columns,
        F.coalesce(
            F.transform(
                "cited",
                lambda entry: F.struct(
                    entry["marker"].alias("marker"), entry["source"]["source_index"].alias("source_index"),
                    entry["source"]["chunk_id"].alias("chunk_id"), entry["source"]["document_id"].alias("document_id"),
                    entry["source"]["document_title"].alias("document_title"),
                    entry["source"]["source_path"].alias("source_path"), entry["source"]["breadcrumb"].alias("breadcrumb"),
                ),
            ),
            F.array().cast(CITATIONS),
        ).alias("citations"),
        "dropped_markers",
        F.when(F.size("dropped_markers") > 0, F.regexp_replace(tidy, r"\s+$", "")).otherwise(F.col("answer")).alias("text"),
    )
