"""The three retrieval modes over one evaluation suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.operators import fusion
from passagemill.plans.retrieval import Index, keyword_arm, rewritten_questions, vector_arm
from passagemill.session import persist_table


MODES = ("hybrid", "keyword", "vector")


def mode_hits(suite: DataFrame, index: Index, top_k: int = K.DEFAULT_TOP_K) -> DataFrame:
    """``(mode, query_id, pos, source_path)`` of the answerable queries.

    Every mode has the same candidate budget, and the vector mode the same rewrite as the hybrid.
    """
    questions = suite.where(F.col("type") == "answerable").select("query_id", "question")
    vector = persist_table(vector_arm(rewritten_questions(questions, index), index), "vector-arm")
    keyword = persist_table(keyword_arm(questions, index), "keyword-arm")
    fused = fusion.rrf_fusion(vector, keyword)
    ranked = [("hybrid", fused, "pos"), ("vector", vector, "rank"), ("keyword", keyword, "rank")]
    parts = [
        hits.select(F.lit(mode).alias("mode"), "query_id", F.col(place).alias("pos"), "chunk_id").where(
            F.col(place) <= top_k
        )
        for mode, hits, place in ranked
    ]
    hits = persist_table(parts[0].unionByName(parts[1]).unionByName(parts[2]), "mode-hits")
    return hits.join(index.chunks.select("chunk_id", "source_path"), "chunk_id").drop("chunk_id")
