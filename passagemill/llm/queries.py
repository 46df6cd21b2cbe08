"""One query per operator, with its production parameters over its whole table, and the pipeline."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import (
    bpe_automaton, circulant, conversations, exact_dedup, hard_negatives, language_id, line_dedup, packing, quality, simhash, substring_dedup, token_counts, warc,
)
from passagemill.session import scratch_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prepare(spark: SparkSession) -> None:
    """Kernels are found by the workers; a batch holds whole texts, so it has few rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(function)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = prepared
    return prepared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark, sf_dir):
    folder = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder)


@query
def op2_line_dedup(spark, sf_dir):
    return line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark, sf_dir):
    """The lower half of the id range is the snapshot, the upper half the batch that comes in."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    new = F.coalesce(F.col("doc_id") > F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    return exact_dedup.deduplicated(docs.where(~new), docs.where(new))


@query
def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.deduplicated_substrings(table(spark, sf_dir, "documents"))


@query
def op8_bpe_automaton(spark, sf_dir):
    return bpe_automaton.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def text_model(spark: SparkSession, sf_dir: str) -> language_id.TextModel:
    return language_id.TextModel.fit(table(spark, sf_dir, "documents"), "text", "lang", F.col("doc_id"))


@query
def op10_language_id(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return language_id.identify_pages(pages, text_model(spark, sf_dir)).drop("_mark").withColumnRenamed("_id", "page_id")


@query
def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mined_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op12_conversation_repair(spark, sf_dir):
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


@query
def op13_minhash(spark, sf_dir):
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
