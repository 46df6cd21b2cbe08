"""Hybrid retrieval for a table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import stem, text
from passagemill.operators import embed, fusion, keyword, postings, prepare, vector
from passagemill.session import persist_table


@dataclass(frozen=True)
class Index:
    """What a search reads. ``documents`` counts every known document, failed ones included.

    A stored index has ``postings`` by lexeme, and ``gone``: the ``(document_id, layer)`` that later layers replaced.
    """

    documents: DataFrame
    chunks: DataFrame
    terms: DataFrame
    frequencies: DataFrame
    dimensions: int
    stemmer: keyword.Stemmer = stem.identity
    provider: embed.Provider | None = None
    postings: DataFrame | None = None
    gone: DataFrame | None = None


def build_index(
    corpus: DataFrame, dimensions: int = 64, stemmer: keyword.Stemmer = stem.identity, whole_texts: bool = False,
    provider: embed.Provider | None = None,
) -> Index:
    """Chunks, vectors, terms and term frequencies of a corpus, written once to the scratch folder.

    Only the term frequencies are shuffled. Without a ``provider`` the vectors are hashed words. A text over the provider's
    input limit fails the job and is named; ``run_ingest`` quarantines such documents instead.
    """
    rows = prepare.whole_text_chunks(corpus) if whole_texts else prepare.chunk_corpus(corpus)
    chunks = persist_table(embed.embed_all(rows, "embedded_text", "source_path", provider or embed.hash_provider(dimensions)), "chunks")
    terms = persist_table(keyword.chunk_terms(chunks, stemmer), "terms")
    frequencies = persist_table(keyword.lexeme_frequencies(terms), "frequencies")
    documents = persist_table(corpus.select("source_path"), "documents")
    return Index(documents, chunks, terms, frequencies, provider.dimensions if provider else dimensions, stemmer, provider)


def rewritten_questions(questions: DataFrame, index: Index) -> DataFrame:
    counts = keyword.term_document_counts(questions, index.frequencies, index.documents, index.stemmer)
    return keyword.rewrite_query(questions, counts)


def question_vectors(rewritten: DataFrame, index: Index) -> DataFrame:
    """Question vectors from what the index's own vectors come from. They are asked for once and written."""
    if index.provider is None or index.provider.name == embed.HASHED_WORDS:
        return embed.hash_embedding(rewritten, "query_id", "vector_text", index.dimensions)
    asked = rewritten.select("query_id", "vector_text", text.token_count(F.col("vector_text")).alias("token_count"))
    made = embed.embed_all(asked, "vector_text", "query_id", index.provider).select("query_id", "embedding")
    return persist_table(made, "question-vectors")


def vector_arm(rewritten: DataFrame, index: Index, k: int = K.CANDIDATES) -> DataFrame:
    vectors = question_vectors(rewritten, index)
    kind = [name for name in ("doc_type",) if name in rewritten.columns]
    asked = vectors.join(rewritten.select("query_id", *kind), "query_id") if kind else vectors
    return vector.vector_topk(asked, index.chunks, index.dimensions, k)


def keyword_arm(questions: DataFrame, index: Index, k: int = K.CANDIDATES) -> DataFrame:
    """From the stored postings of the questions' lexemes, or a scan of the terms of an index that has none."""
    if index.postings is not None:
        return postings.stored_topk(questions, index.postings, k, index.stemmer, index.gone)
    return keyword.keyword_topk(questions, index.terms, k, index.stemmer)


def fused_hits(questions: DataFrame, index: Index) -> DataFrame:
    """Fused candidates of both arms: the rewritten text feeds the vectors, the original the keywords."""
    vector_hits = vector_arm(rewritten_questions(questions, index), index)
    return fusion.rrf_fusion(vector_hits, keyword_arm(questions, index))


def top_hits(fused: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    if "top_k" in questions.columns:
        wanted = fused.join(questions.select("query_id", "top_k"), "query_id")
        return wanted.where(F.col("pos") <= F.coalesce("top_k", F.lit(top_k))).drop("top_k")
    return fused.where(F.col("pos") <= top_k)


def hybrid_search(questions: DataFrame, index: Index, top_k: int = K.DEFAULT_TOP_K) -> DataFrame:
    """Best passages per question with scores, arm ranks and chunk attributes.

    The few hits are written before the join, so Catalyst knows their size and, while it is
    small, looks them up in the chunk table without shuffling that table.
    """
    hits = persist_table(top_hits(fused_hits(questions, index), questions, top_k), "hits")
    chunks = index.chunks
    if index.postings is not None:  # stored chunks are sorted by id
        wanted = [row.chunk_id for row in hits.select("chunk_id").distinct().limit(postings.PUSHED_VALUES + 1).collect()]
        chunks = postings.having(chunks, "chunk_id", wanted) if len(wanted) <= postings.PUSHED_VALUES else chunks
    return fusion.passage_join(hits, chunks)
