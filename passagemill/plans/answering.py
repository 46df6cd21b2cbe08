"""Grounded, cited, abstaining answers for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.operators import answers as A
from passagemill.plans.retrieval import Index, hybrid_search
from passagemill.session import persist_table


def source_struct():
    return F.struct(
        F.col("source_no").alias("source_no"), "chunk_id", "document_id", "title", "source_path", "breadcrumb",
        "score", "vector_rank", "keyword_rank",
    )


def answer_passages(
    questions: DataFrame, passages: DataFrame, model_answers: DataFrame | None = None, floor: float | None = None
) -> DataFrame:
    """One answer row per question from ranked passages.

    ``model_answers`` is an optional ``(query_id, answer)`` table of external output; without it the
    extractive answers are used. Questions under the score floor never reach either; a question without a row among
    the model's answers is reported as such and not as answered.
    """
    # Both are read several times below and hold a few rows per question.
    floored = persist_table(A.score_floor(questions.select("query_id", "question"), passages, floor), "floored")
    answerable = floored.where(F.col("abstain_reason").isNull()).select("query_id", "question")
    relevant = passages.join(answerable.select("query_id"), "query_id", "left_semi")
    sources = persist_table(A.near_duplicate_suppression(relevant), "sources")
    if model_answers is None:
        raw, mode = A.extractive_answers(answerable, sources), "extractive"
    else:
        raw, mode = answerable.select("query_id").join(model_answers, "query_id", "left"), "model"
    judged = A.detect_abstention(raw.withColumn("answer", A.text.trim_space(F.col("answer"))))
    cited = A.validate_citations(judged, sources)
    # Floored questions report what was retrieved, the others the sources their markers refer to.
    plain = passages.join(answerable.select("query_id"), "query_id", "left_anti").withColumn("source_no", F.col("pos"))
    reported = sources.unionByName(plain).groupBy("query_id").agg(
        F.array_sort(F.collect_list(source_struct())).alias("sources")
    )
    declined = F.coalesce("declined", F.lit(False))
    floor_hit = F.col("abstain_reason").isNotNull()
    missing = ~floor_hit & F.col("text").isNull()
    answered = ~(floor_hit | declined | missing)
    return (
        floored.join(cited, "query_id", "left")
        .join(reported, "query_id", "left")
        .select(
            "query_id", "question", answered.alias("answered"),
            F.when(answered, F.col("text")).otherwise(K.ABSTENTION_TEXT).alias("text"),
            F.when(answered, F.col("citations")).otherwise(F.array().cast(A.CITATIONS)).alias("citations"),
            F.coalesce("abstain_reason", F.when(declined, "MODEL_DECLINED"), F.when(missing, "NO_MODEL_ANSWER")).alias("abstain_reason"),
            F.when(answered, F.col("dropped_markers")).otherwise(F.array().cast("array<int>")).alias("dropped_markers"),
            "sources", F.lit(mode).alias("answer_mode"), "top_score",
        )
    )


def answer_batch(
    questions: DataFrame, index: Index, top_k: int = K.DEFAULT_TOP_K, model_answers: DataFrame | None = None
) -> DataFrame:
    """Retrieval, floor, duplicate suppression, answer text, refusal check and citation check."""
    passages = persist_table(hybrid_search(questions, index, top_k), "passages")
    return answer_passages(questions, passages, model_answers)
