"""Line dedup: later repeats of runs of lines are removed, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.winnowing import without_repeats


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, gram: int = 1, carry: bool = False) -> DataFrame:
    """Removes every line covered by ``run`` consecutive lines that also start earlier.

    Lines are split at ``\\n`` and compared byte by byte; lines without a word do not count and go only inside a removed
    run. Earlier: smaller id (nulls first), or the same document and an earlier line. Windows are judged on the input.

    Returns ``_id``, ``_mark``, ``_text``, ``kept_text``, ``n_units`` (lines with a word) and ``n_removed`` per row.
    Null and empty texts have no lines and stay empty; rows equal in id and text are one document, so neither loses a
    line to the other; an empty table gives an empty table; other columns are ignored, or with ``carry`` kept in
    ``_row``.
    """
    return without_repeats(docs, id_col, text_col, "lines", run, gram, carry)


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3) -> DataFrame:
    """``line_dedup`` as a digest: id, ``n_lines``, ``n_removed`` and the SHA-256 of the kept lines joined by ``\\n``."""
    lines = F.filter(F.split("kept_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return line_dedup(docs, id_col, text_col, run).select(
        F.col("_id").alias(id_col), F.col("n_units").alias("n_lines"), "n_removed",
        F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("kept_sha256"),
    )
