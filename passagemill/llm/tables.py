"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.session import forget  # noqa: F401


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_mark(column: str) -> Column:
    """With the id, tells documents apart: rows equal in id and text are the same document."""
    return F.hash(F.coalesce(F.col(column), F.lit("")))


def drop_documents(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the documents in ``dropped`` (``_id``, ``_mark``)."""
    key = fresh(docs, "_mark_of_text")
    marked = docs.withColumn(key, text_mark(text_col))
    gone = dropped.select(F.col("_id").alias("_gone_id"), F.col("_mark").alias("_gone_mark")).distinct()
    same = marked[id_col].eqNullSafe(gone["_gone_id"]) & (marked[key] == gone["_gone_mark"])
    return marked.join(gone, same, "left_anti").select(*docs.columns)


def hashed_share(key: Column, rows: int, wanted: int) -> Column:
    """True for a share of ``rows`` rows, chosen by the hash of their key alone, so alike on every run.

    Fewer than ``2 * wanted`` rows are all taken; of more, between ``wanted`` and twice as many are expected.
    """
    return F.pmod(F.xxhash64(key), F.lit(max(1, rows // wanted))) == 0


def apart(table: DataFrame, *key: str) -> DataFrame:
    """Deals an aggregate out anew, so that both sides of the join on ``key`` are dealt for it and a hot key can be split."""
    return table.repartition(F.xxhash64(*key))
