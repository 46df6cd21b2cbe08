"""Substring dedup: word runs that repeat an earlier one are removed, found by seeding on winnowed anchors and extending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.winnowing import without_repeats


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20, gram: int = 4, carry: bool = False) -> DataFrame:
    """Removes every word covered by ``words`` consecutive words that also start earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged; maximal repeats of at least ``words`` words go whole. Earlier:
    smaller id (nulls first), or the same document and an earlier word. Windows are judged on the input.

    Returns ``_id``, ``_mark``, ``_text``, ``kept_text`` (with its own white space), ``n_units`` and ``n_removed`` per row.
    Null and empty texts have no words and stay empty; rows equal in id and text are one document, so neither loses words
    to the other; an empty table gives an empty table; other columns are ignored, or with ``carry`` kept in
    ``_row``.
    """
    return without_repeats(docs, id_col, text_col, "words", words, gram, carry)


def deduplicated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20) -> DataFrame:
    """``substring_dedup`` as a digest: id, ``n_words``, ``n_removed`` and the SHA-256 of the kept words joined by a space."""
    plain = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return substring_dedup(docs, id_col, text_col, words).select(
        F.col("_id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed",
        F.sha2(plain.cast("binary"), 256).alias("kept_sha256"),
    )
