"""MinHash near-duplicates with circulant coordinates: two permutations give the whole signature.

The first permutation of the 64-bit numbers scatters a shingle's hash once; the second one, shifted by ``k`` in a circle of
2^64, gives coordinate ``k`` (C-MinHash, Li and Li, 2021). The least value over a set is one coordinate, ``ROWS`` of them are a
band. Two sets of similarity 0.85 share one of the 28 bands but for four pairs in a thousand million (calculated for
independent coordinates; circulant ones vary less); ``set_links`` then finds what is linked, on the full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import set_links
from passagemill.llm.arrow import mix
from passagemill.llm.simhash import shingle_hashes

SIZE = 5
BANDS, ROWS = 28, 4
BOUND = set_links.Bound(100, 85)
BLOCK = 512
#: Odd multipliers and the step between two shifts.
_FIRST, _SECOND, _STEP = (np.uint64(value) for value in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint64) * _STEP


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingles as sorted hashes."""
    return np.unique(shingle_hashes((text or "").encode(), SIZE))


def scattered(held: np.ndarray) -> np.ndarray:
    """The first permutation."""
    return mix(held + _FIRST)


def shifted(values: np.ndarray) -> np.ndarray:
    """The second permutation, of values that were shifted before: an odd product, folded, and an odd product again."""
    values = values * _SECOND
    values ^= values >> np.uint64(32)
    values *= _FIRST
    return values


def coordinates(held: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(held), BLOCK):
        least = np.minimum(least, shifted(scattered(held[begin : begin + BLOCK])[:, None] + _SHIFTS).min(axis=0))
    return least


def band_keys(held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(0, dtype=np.int64)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in coordinates(held).reshape(BANDS, ROWS).T:
        key = mix((key ^ row) + _FIRST)
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` and ``kept`` (the id is the component's) of each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than five words has one shingle, one without words
    (or null) none and is linked with nothing. Repeated rows share a component. A row without an id is kept if nothing in its
    component has one. An empty table gives an empty table; other columns are ignored.
    """
    found = set_links.set_components(docs, id_col, text_col, shingle_set, band_keys, BOUND)
    return found.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
