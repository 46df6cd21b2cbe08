"""Packing: padded batches of a token budget, formed inside length buckets that minimise the padding of the whole corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 1024  # lengths up to here have a cell of their own
STEPS = 128  # above, every doubling is cut into so many cells
SLICE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Tokens as white-space separated words; nulls have none."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " "))).cast("bigint")


def cell_of(length: Column) -> Column:
    """A cell of the histogram: the length itself, or a step of under one per cent; at most a few thousand cells exist."""
    return F.when(length <= EXACT, length.cast("bigint")).otherwise(
        F.lit(EXACT) + F.floor(F.log2(length / F.lit(float(EXACT))) * STEPS).cast("bigint") + 1
    )


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets so that padding each text to its bucket's length costs least.

    ``lengths`` are distinct and rising. ``cost[j]`` is the least number of padded tokens of the first ``j`` lengths.
    """
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    chosen = []
    for _ in range(min(buckets, n)):
        following, cut = cost.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            total = cost[:j] + lengths[j - 1] * (below[j] - below[:j])
            i = int(np.argmin(total))
            if total[i] < following[j]:
                following[j], cut[j] = total[i], i
        chosen.append(cut)
        cost = following
    bounds, at = [], n
    for cut in reversed(chosen):
        if at and cut[at] != at:
            bounds.append(int(lengths[at - 1]))
            at = int(cut[at])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Assigns each row to a batch of one length bucket with at most ``budget`` padded tokens.

    The histogram counts all rows; only its cells (a few thousand, whatever the input) reach the driver, where dynamic
    programming picks the bounds among the largest real lengths of the cells. Rows of a bucket are dealt by the hash of
    their id and text into slices of about ``SLICE_ROWS`` rows, which are cut into batches independently, so no bucket is
    one task; only the last batch of a slice can be short. A text longer than the budget is a batch of its own.

    Returns the id, ``n_tokens``, ``bucket``, ``bucket_tokens`` (the padded length), ``batch_id`` (``bucket-slice-number``) and
    ``place`` per row. Null and empty texts have no tokens and are packed like others; repeated rows are packed each; null
    ids are rows like others; an empty table gives an empty table; other columns are ignored.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget must be positive")
    sized = docs.select(
        F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_deal"),
    )
    cells = sized.groupBy(cell_of(F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("rows")).orderBy("cell").collect()
    tops, rows = np.array([c.top for c in cells], dtype=np.int64), np.array([c.rows for c in cells], dtype=np.int64)
    bounds = best_bounds(tops, rows, buckets)
    shape = [
        (number, bound, max(1, budget // max(1, bound)), max(1, -(-int(rows[(tops <= bound) & (tops > before)].sum()) // SLICE_ROWS)))
        for number, (before, bound) in enumerate(zip([-1, *bounds], bounds))
    ]
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= bound, F.lit(number)) for number, bound, _, _ in shape], F.lit(0)) if shape else F.lit(0)

    def of(place: int) -> Column:
        return F.element_at(F.array(*[F.lit(int(s[place])) for s in shape] or [F.lit(1)]), F.col("bucket") + 1).cast("bigint")

    slices_ = sized.withColumn("bucket", bucket).withColumn("slice", F.pmod("_deal", of(3)))
    order = Window.partitionBy("bucket", "slice").orderBy("_deal", "_id", "n_tokens")
    number = F.row_number().over(order) - 1
    return (
        slices_.withColumn("bucket_tokens", of(1)).withColumn("per_batch", of(2)).withColumn("number", number)
        .select(
            F.col("_id").alias(id_col), "n_tokens", "bucket", "bucket_tokens",
            F.format_string("%d-%d-%d", "bucket", "slice", F.floor(F.col("number") / F.col("per_batch"))).alias("batch_id"),
            F.pmod("number", "per_batch").alias("place"),
        )
    )
