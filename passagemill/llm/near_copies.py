"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked.

A text's set is cut into ``BANDS`` keys of ``ROWS`` minhashes each. Two texts of similarity ``s`` share one with probability
``1 - (1 - s ** ROWS) ** BANDS``: all but three in a million at 0.8, fewer above. What shares a key is linked exactly, whatever
the size of the class (``set_links``). The pipeline's stage links texts by SimHash as well (``simhash``: fingerprints of 64 bits that differ in
at most two): alone it would miss most of these pairs, since fingerprints differ in ten bits on average at 0.8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import set_links
from passagemill.llm.arrow import mix
from passagemill.llm.components import components
from passagemill.llm.simhash import shingle_hashes, simhash_components
from passagemill.llm.tables import apart, drop_documents
from passagemill.session import persist_table

SIZE = 5
BANDS, ROWS = 32, 5
BOUND = set_links.Bound(5, 4)
BLOCK = 1 << 11
_SEEDS, _FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS = _FACTORS << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), SIZE))


def band_keys(held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(held), BLOCK):
        least = np.minimum(least, ((held[begin : begin + BLOCK, None] ^ _SEEDS) * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix((key ^ row) + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_mark`` and ``component_id`` (the smallest id reachable over links) of each row.

    Words are those of ``simhash_components``; a text of fewer than five words has one shingle, texts without words (or null)
    are equal. Repeated rows share a component; null ids count only where a component has no other id, its ``component_id``
    is then null. An empty table gives an empty table; other columns are ignored.
    """
    return set_links.set_components(docs, id_col, text_col, shingle_set, band_keys, BOUND, empty_alike=True).select("_id", "_mark", "component_id")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_copy_components``, over the links of near copies and those of SimHash fingerprints together."""
    prints = simhash_components(docs, id_col, text_col).select("_id", "_mark", F.col("root").alias("print")).distinct()
    copies = set_links.set_components(docs, id_col, text_col, shingle_set, band_keys, BOUND, empty_alike=True).select("_id", "_mark", "root").distinct()
    either = copies.withColumnsRenamed({"_id": "_copy_id", "_mark": "_copy_mark"})
    same = F.col("_id").eqNullSafe(F.col("_copy_id")) & (F.col("_mark") == F.col("_copy_mark"))
    rows = persist_table(prints.join(either, same).select("_id", "_mark", "print", "root"), "linked")
    # Components of fingerprints that reach over several components of near copies make them one.
    over = rows.groupBy("print").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("print", "a")
    edges = rows.join(over, "print").where("root <> a").select("a", F.col("root").alias("b"))
    joined = components(edges).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    named = persist_table(rows.join(joined, "root", "left").select("_id", "_mark", F.coalesce("whole", "root").alias("whole")), "named")
    return named.join(apart(named.groupBy("whole").agg(F.min("_id").alias("component_id")), "whole"), "whole").select("_id", "_mark", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. With ``fingerprints``, over both kinds of links.

    Rows that share that id stay together; rows without an id stay only where the component has no id at all.
    """
    found = (linked_components if fingerprints else near_copy_components)(docs, id_col, text_col)
    return drop_documents(docs, id_col, text_col, found.where(~F.col("_id").eqNullSafe(F.col("component_id"))))
