"""Greedy embedding requests over a whole table, the same whatever its partitions.

In the order of the key a request takes texts until the next one would break its token or count cap. Where a request ends
depends on where it began, so a slice of the order cannot be cut alone; but no request is longer than the count cap, so only
that many places of a slice can be the first one where a request begins. A slice tells, for each of them, how many requests
begin in it and where the first one of the next slice does. These maps are chained over groups of slices, the groups over each
other, and every slice is then cut from its one true beginning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.embed import Provider
from passagemill.session import persist_table

SLICE_ROWS = 65_536
GROUP_SLICES = 256
MAP = "slice bigint, entry int, leaves int, begins bigint"


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, from 0 in the order of the columns: one range shuffle, and one number a partition to the driver."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = persist_table(sorted_rows.withColumn("part", F.spark_partition_id()).withColumn("local", local), "ordered")
    counts = held.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([row.n for row in counts])])[:-1].tolist() if counts else []
    offsets = df.sparkSession.createDataFrame([(row.part, start) for row, start in zip(counts, starts)], "part int, start bigint")
    return held.join(F.broadcast(offsets), "part").withColumn("place", F.col("local") + F.col("start")).drop("part", "local", "start")


def next_begin(sizes: np.ndarray, most_tokens: int, most_texts: int) -> np.ndarray:
    """For each place, where the request after the one that begins there begins. A text over the token cap is alone."""
    ends = np.cumsum(sizes)
    before = ends - sizes
    fits = np.searchsorted(ends, before + most_tokens, side="right")
    places = np.arange(len(sizes))
    return np.minimum(np.maximum(fits, places + 1), places + most_texts)


def slice_map(rows: pd.DataFrame, provider: Provider, slice_rows: int) -> pd.DataFrame:
    """Of one slice, whose rows are followed by the first ones of the next: from each entry, where it is left and how many begin."""
    rows = rows.sort_values("place")
    own = int((rows["place"] // slice_rows == rows["slice"]).sum())
    after = next_begin(rows["token_count"].to_numpy(np.int64), provider.max_request_tokens, provider.max_batch_size)[:own].tolist()
    leaves, begins = [0] * own, [1] * own
    for place in range(own - 1, -1, -1):
        if after[place] >= own:
            leaves[place] = after[place] - own
        else:
            leaves[place], begins[place] = leaves[after[place]], begins[after[place]] + 1
    entries = min(own, provider.max_batch_size)
    return pd.DataFrame({"slice": rows["slice"].iloc[0], "entry": range(entries), "leaves": leaves[:entries], "begins": begins[:entries]})


def followed(maps: pd.DataFrame, entry: int) -> list[tuple[int, int, int]]:
    """(slice, its entry, requests that began before it) along the slices of ``maps``; an entry beyond a slice passes it."""
    out, begun = [], 0
    for name, own in maps.sort_values(["slice", "entry"]).groupby("slice", sort=True):
        out.append((name, entry, begun))
        if entry < len(own):
            row = own.iloc[entry]
            entry, begun = int(row["leaves"]), begun + int(row["begins"])
        else:
            entry -= len(own)
    return [*out, (-1, entry, begun)]


def token_budget_batches(df: DataFrame, key: str, token_count: str, provider: Provider, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Assigns texts to requests: ``(key, token_count, request_id, oversize)``, requests numbered in the order of the key.

    Texts over the input cap belong to no request. Missing counts are zero; equal keys follow their counts.
    """
    slice_rows = max(slice_rows, provider.max_batch_size)
    sized = df.select(F.col(key).alias("key"), F.coalesce(F.col(token_count), F.lit(0)).cast("bigint").alias("token_count"))
    sized = sized.withColumn("oversize", F.col("token_count") > provider.max_input_tokens)
    placed = persist_table(in_order(sized.where(~F.col("oversize")), "key", "token_count"), "placed")
    own = F.floor(F.col("place") / slice_rows).cast("bigint")
    # The first rows of a slice also follow the one before it: a request that begins there may end here.
    ahead = F.array_compact(F.array(own, F.when((F.col("place") % slice_rows < provider.max_batch_size) & (own > 0), own - 1)))
    rows = placed.select("place", "token_count", F.explode(ahead).alias("slice"))
    maps = persist_table(rows.groupBy("slice").applyInPandas(lambda part: slice_map(part, provider, slice_rows), MAP), "slice-maps")

    group = F.floor(F.col("slice") / GROUP_SLICES).cast("bigint")
    grouped = maps.withColumn("group", group)

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        first = part["slice"].min()
        ends = [followed(part, int(entry))[-1] for entry in sorted(part.loc[part["slice"] == first, "entry"])]
        return pd.DataFrame({"slice": part["group"].iloc[0], "entry": range(len(ends)), "leaves": [e[1] for e in ends], "begins": [e[2] for e in ends]})

    groups = grouped.groupBy("group").applyInPandas(chained, MAP).toPandas()
    begun, entry, rows_of_groups = 0, 0, []
    for name, at, before in followed(groups, 0)[:-1] if len(groups) else []:
        rows_of_groups.append((int(name), int(at), int(before)))
    starts = df.sparkSession.createDataFrame(rows_of_groups, "group bigint, group_entry int, group_before bigint")

    def entered(part: pd.DataFrame) -> pd.DataFrame:
        before = part["group_before"].iloc[0]
        steps = followed(part, int(part["group_entry"].iloc[0]))[:-1]
        return pd.DataFrame([(name, at, before + begun) for name, at, begun in steps], columns=["slice", "entry", "before"])

    entries = grouped.join(F.broadcast(starts), "group").groupBy("group").applyInPandas(entered, "slice bigint, entry int, before bigint")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        after = next_begin(part["token_count"].to_numpy(np.int64), provider.max_request_tokens, provider.max_batch_size).tolist()
        begins, at = np.zeros(len(part), dtype=np.int64), int(part["entry"].iloc[0])
        while at < len(part):
            begins[at] = 1
            at = after[at]
        number = part["before"].iloc[0] - 1 + np.cumsum(begins)
        return pd.DataFrame({"place": part["place"], "request_id": number})

    sliced = placed.select("place", "token_count", own.alias("slice")).join(entries, "slice")
    numbers = sliced.groupBy("slice").applyInPandas(cut, "place bigint, request_id bigint")
    batched = placed.join(numbers, "place").select("key", "token_count", "request_id", F.lit(False).alias("oversize"))
    left_out = sized.where("oversize").select("key", "token_count", F.lit(None).cast("bigint").alias("request_id"), "oversize")
    return batched.unionByName(left_out).withColumnRenamed("key", key)


def request_totals(batches: DataFrame) -> DataFrame:
    """Texts and tokens per request."""
    return batches.where(~F.col("oversize")).groupBy("request_id").agg(
        F.count("*").alias("texts"), F.sum("token_count").cast("bigint").alias("tokens")
    )
