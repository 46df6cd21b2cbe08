"""Hard negatives: for an anchor and each of its nearest rows of the same label, the best rows of other labels within a score window.

Rows are dealt by range (label, first coordinate, id) into tiles of bounded size; a tile's rows of one label are packed into
one tree of bounding boxes (``box_tree``). Anchors stream past the trees of a tile, each with its own best-first search, and
only ``k`` rows per anchor, window and tile leave it. First the positives are searched among the tiles that hold the anchor's
label; their scores give the windows in which all tiles are then searched for negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.box_tree import BoxTree
from passagemill.session import persist_table

#: Rows of a tile: at most 1/200 of all rows, so anchors (1 in 100) travel at most 200 times, and within a task's memory.
SHARE, LEAST, MOST = 200, 8_192, 262_144
#: Up to here products of points and queries add up exactly as floats.
EXACT = 1 << 20


def tile_rows(rows: int) -> int:
    return min(MOST, max(LEAST, rows // SHARE))


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """``id``, ``label`` and ``vector`` (each component ``floor(scale * x)``) of the rows that take part, equal rows once."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = rows.where(label.isNotNull() & F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & whole)
    return usable.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"),
    ).distinct()


def tiled(points: DataFrame) -> DataFrame:
    """``points`` with ``tile``, written: runs of the order by label, first coordinate and id."""
    held = persist_table(points, "vectors")
    rows = held.count()
    first = F.when(F.size("vector") > 0, F.col("vector")[0])
    dealt = held.repartitionByRange(max(1, -(-rows // tile_rows(rows))), F.col("label"), first, F.col("id"))
    return persist_table(dealt.withColumn("tile", F.spark_partition_id()), "tiles")


class Tile:
    """The trees of one tile, by label and number of coordinates."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        held = pa.Table.from_batches(pieces).combine_chunks()
        labels, ids = held["label"].to_numpy(), held["id"].to_numpy()
        vectors = held["vector"].combine_chunks()
        sizes = pc.list_value_length(vectors).to_numpy()
        self.groups: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.trees: dict[tuple, BoxTree] = {}
        for label, size in np.unique(np.stack([labels, sizes], axis=1), axis=0).tolist():
            mine = np.flatnonzero((labels == label) & (sizes == size))
            points = vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), size)
            self.groups[label, size] = ids[mine], points

    def tree(self, label: int, size: int, exact: bool) -> BoxTree:
        ids, points = self.groups[label, size]
        small = exact and (not points.size or int(np.abs(points).max()) < EXACT)
        key = label, size, small
        if key not in self.trees:
            self.trees[key] = BoxTree(ids, points.astype(np.float64) if small else points)
        return self.trees[key]

    def search(self, query: np.ndarray, label: int, same: bool, windows: list, k: int, without: int) -> list[list[tuple[int, int]]]:
        """The best ``k`` of each window over the trees of the label, or of all others; queries of another size meet nothing."""
        exact = not len(query) or (int(np.abs(query).max()) < EXACT and len(query) <= 4096)
        found: list[list] = [[] for _ in windows]
        for other, size in self.groups:
            if size != len(query) or (other == label) is not same:
                continue
            tree = self.tree(other, size, exact)
            asked = [
                (low if len(hits) < k else max(low, hits[-1][0]), high) for (low, high), hits in zip(windows, found)
            ]
            hits = tree.search(query.astype(tree.points.dtype), asked, k, without)
            found = [sorted(old + new, key=lambda pair: (-pair[0], pair[1]))[:k] if new else old for old, new in zip(found, hits)]
        return found


def searched(points: DataFrame, asked: DataFrame, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """``id``, ``mark``, ``window``, ``other`` and ``score``: the best ``k`` of each tile.

    ``asked``: ``tile``, ``id``, ``mark``, ``label``, ``vector`` and ``scores``, of which each opens a window from ``low`` to
    ``high`` per cent; null is one window that is open to both sides.
    """
    rows = points.select(
        "tile", F.lit(0).alias("kind"), "id", F.lit(0).cast("bigint").alias("mark"), "label", "vector", F.lit(None).cast("array<bigint>").alias("scores")
    )
    tagged = rows.unionByName(asked.select("tile", F.lit(1).alias("kind"), "id", "mark", "label", "vector", "scores"))
    tiles = tagged.repartition("tile").sortWithinPartitions("tile", "kind")

    def answers(tile: Tile, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for row in batch.to_pylist():
            query = np.array(row["vector"], dtype=np.int64)
            windows = [(-np.inf, np.inf)]
            if row["scores"] is not None:
                windows = [(-(-low * score // 100), high * score // 100) for score in row["scores"]]
            for place, hits in enumerate(tile.search(query, row["label"], same, windows, k, row["id"])):
                out += [(row["id"], row["mark"], place, other, score) for score, other in hits]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(column), pa.int64()) for column in columns], ["id", "mark", "window", "other", "score"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, tile = None, [], None
        for batch in batches:
            tiles, kinds = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)]):
                if begin == end:
                    continue
                if tiles[begin] != current:
                    current, pieces, tile = tiles[begin], [], None
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    pieces.append(part.select(["id", "label", "vector"]))
                    continue
                if tile is None and pieces:
                    tile, pieces = Tile(pieces), []
                if tile is not None:
                    yield answers(tile, part)

    return tiles.mapInArrow(kernel, "id bigint, mark bigint, window bigint, other bigint, score bigint")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` over all tiles, with ``rank`` from 1."""
    order = Window.partitionBy("id", "mark", "window").orderBy(F.desc("score"), "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    points: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``points``: ``id``, ``label`` and ``vector`` (whole numbers whose products and sums fit a long). Positives of an anchor are
    its best rows of the same label and another id, negatives the best rows of other labels whose score is within ``low`` and
    ``high`` per cent of the positive's; ties go to the smaller id. Rows that share an id but differ otherwise are rows of
    their own; vectors of different lengths never meet. An empty table, or one without anchors, gives an empty result.
    """
    tiles = tiled(points)
    mark = F.xxhash64("label", "vector")
    anchors = persist_table(tiles.where(anchor(F.col("id"))).select("id", mark.alias("mark"), "label", "vector"), "anchors")
    holds = tiles.select("tile", "label").distinct()
    asked = anchors.join(holds, "label").withColumn("scores", F.lit(None).cast("array<bigint>"))
    near = persist_table(best(searched(tiles, asked, True, positives), positives), "positives")

    # A window's place in the array is the positive's rank less one.
    listed = near.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("positives"))
    scores = listed.select("id", "mark", F.col("positives.score").alias("scores"))
    last = tiles.agg(F.max("tile")).first()[0] or 0
    wanted = anchors.join(scores, ["id", "mark"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(last))))
    far = best(searched(tiles, wanted, False, negatives, low, high), negatives)
    of = near.select("id", "mark", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(of, ["id", "mark", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (``vec_id``, ``embedding``, ``label``; other columns are ignored).

    Where ``vec_id`` is divisible by 7 the label first becomes ``(label + 1) % 10``; anchors are the ids divisible by 100.
    Rows with a null label, id or vector, or a component that is null or not finite, take no part.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable_vectors(embeddings, "vec_id", "embedding", label, 256), lambda name: name % 100 == 0)
