"""Vector arm: exact and approximate nearest chunks for a table of questions.

Questions of checked size go to every task, and each scans its chunks once with a running top-k;
only ``k`` rows per question and partition are shuffled. Larger question tables are cut into rows of a grid, as many
as memory asks for, that meet slices of the chunks; a task holds one row and streams its slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import constants as K
from passagemill.functions import text
from passagemill.session import persist_table

# Scores are compared after rounding, so equal vectors tie whatever the order of summation.
SCORE_DIGITS = 9
# Vector values (8 bytes each) that may be sent to every task: 64 MB.
BROADCAST_VALUES = 8_000_000
BROADCAST_QUESTIONS = 20_000
# Vector values of the questions that a task of the grid holds, and tasks for each core.
ROW_VALUES, GRID_TASKS = 4_000_000, 4
# Vector values of the questions scored at once, scores computed at once, and chunk values that wait to be scored.
BLOCK_VALUES = 32_768
BLOCK_SCORES = 2_000_000
WAITING_VALUES = 1_000_000
# Single precision screens the scores: unit vectors of up to a few thousand values differ by less than this.
SCREEN_ERROR = 1e-4
# Stands for a null among whole-number ids; nulls come first, as in Spark.
NULL_KEY = np.iinfo(np.int64).min
# Approximate search: rounds of training and rows of a cell in it, questions that the number of probes is fitted on, its
# recall, files that a crowded cell is dealt to, and centres taken from an order.
ROUNDS, TRAINED_ROWS, PROBED_QUESTIONS, RECALL, CELL_FILES, FIRST_CELLS = 6, 256, 500, 0.92, 8, 32


class RunningTopK:
    """Best ``k`` chunks of every question over the score blocks seen so far."""

    def __init__(self, ids: list, doc_types: list, k: int) -> None:
        self.ids, self.doc_types, self.k = ids, doc_types, k
        self.floors = np.full(len(ids), -np.inf)
        self.scores: list[np.ndarray] = [np.empty(0)] * len(ids)
        self.chunks: list[np.ndarray] = [np.empty(0, dtype=object)] * len(ids)

    def offer(self, chunk_ids: np.ndarray, scores: np.ndarray, doc_types: np.ndarray, places: np.ndarray | None = None) -> None:
        """Takes a chunk-by-question block of scores; minus infinity is no match. ``places``: the questions, if not all."""
        places = np.arange(len(self.ids)) if places is None else places
        for kind in set(self.doc_types) - {None}:
            asking = [at for at, place in enumerate(places) if self.doc_types[place] == kind]
            scores[np.ix_(doc_types != kind, asking)] = -np.inf
        best = scores.max(axis=0)
        # A tie with the last kept score may still win by its id.
        for at in np.flatnonzero((best >= self.floors[places]) & (best > -np.inf)):
            question = places[at]
            floor, column = self.floors[question], scores[:, at]
            if len(column) > self.k:
                floor = max(floor, np.partition(column, -self.k)[-self.k])
            found = np.flatnonzero((column >= floor) & (column > -np.inf))
            merged = np.concatenate([self.scores[question], column[found]])
            names = np.concatenate([self.chunks[question], chunk_ids[found]])
            order = np.lexsort((*nulls_first(names), -merged))[: self.k]
            self.scores[question], self.chunks[question] = merged[order], names[order]
            if len(order) == self.k:
                self.floors[question] = merged[order[-1]]

    def rows_per_block(self) -> int:
        """Chunks to score at once, so that a block of scores stays small whatever the questions."""
        return max(1, BLOCK_SCORES // max(1, len(self.ids)))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        counts = [len(scores) for scores in self.scores]
        names = [name for name, count in zip(self.ids, counts) for _ in range(count)]
        chunks = np.concatenate(self.chunks) if self.chunks else np.empty(0, dtype=object)
        scores = np.concatenate(self.scores) if self.scores else np.empty(0)
        columns = [pa.array(names, schema.field(0).type), pa.array(chunks, schema.field(1).type), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class NearestChunks:
    """Best ``k`` chunks of every question by cosine; vectors that are zero or not finite match nothing.

    Products in single precision rule out what cannot reach a question's last kept score; the rest is scored in double precision.
    """

    def __init__(
        self, ids: pa.Array, vectors: np.ndarray, doc_types: list, k: int, probes: pa.Array | None = None, block_values: int = BLOCK_VALUES
    ) -> None:
        self.unit, usable = unit_vectors(vectors)
        self.ids, self.k, count = ids.filter(pa.array(usable)), k, len(self.unit)
        self.screen = self.unit.astype(np.float32)
        self.kinds = {kind: code for code, kind in enumerate(sorted({kind for kind in doc_types if kind is not None}))}
        self.wanted = np.array([self.kinds.get(kind, -1) for kind in doc_types], dtype=np.int64)[usable]
        self.scores = np.full((count, k), -np.inf)
        self.chunks: np.ndarray | None = None
        self.step = max(1, block_values // max(1, vectors.shape[1]))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.by_cell: dict[int, np.ndarray] | None = None
        if probes is not None:
            probes = probes.filter(pa.array(usable))
            places = np.repeat(np.arange(count), pc.list_value_length(probes).fill_null(0).to_numpy())
            cells = probes.flatten().to_numpy()
            order = np.argsort(cells, kind="stable")
            edges = np.flatnonzero(np.diff(cells[order], prepend=-1))
            self.by_cell = {int(cells[part[0]]): places[part] for part in np.split(order, edges[1:]) if len(part)}

    def add(self, chunk_ids: np.ndarray, vectors: np.ndarray, doc_types: np.ndarray, cells: np.ndarray) -> None:
        self.waiting.append((chunk_ids, vectors, doc_types, cells))
        self.held += vectors.size
        if self.held >= WAITING_VALUES:
            self.flush()

    def flush(self) -> None:
        """Scores the waiting chunks."""
        if not self.waiting:
            return
        names, vectors, doc_types, cells = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting, self.held = [], 0
        if self.chunks is None:
            self.chunks = np.full(self.scores.shape, NULL_KEY if names.dtype == np.int64 else "", dtype=names.dtype)
        unit, usable = unit_vectors(vectors)
        names, cells = names[usable], cells[usable]
        kinds = np.array([self.kinds.get(kind, -2) for kind in doc_types[usable]], dtype=np.int64) if self.kinds else None
        if self.by_cell is None:
            self.meet(names, unit, kinds, np.arange(len(self.unit)))
            return
        # The chunks of a cell meet only the questions that look into it.
        order = np.argsort(cells, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            if len(part) and (places := self.by_cell.get(int(cells[part[0]]))) is not None:
                self.meet(names[part], unit[part], None if kinds is None else kinds[part], places)

    def meet(self, names: np.ndarray, unit: np.ndarray, kinds: np.ndarray | None, places: np.ndarray) -> None:
        screen = unit.astype(np.float32)
        for begin in range(0, len(places), self.step):
            asked = places[begin : begin + self.step]
            rows = max(1, BLOCK_SCORES // len(asked))
            for start in range(0, len(names), rows):
                part = slice(start, start + rows)
                self.offer(asked, names[part], unit[part], screen[part], None if kinds is None else kinds[part])

    def offer(self, asked: np.ndarray, names: np.ndarray, unit: np.ndarray, screen: np.ndarray, kinds: np.ndarray | None) -> None:
        rough = self.screen[asked] @ screen.T
        if kinds is not None:
            wanted = self.wanted[asked, None]
            rough[(wanted >= 0) & (wanted != kinds)] = -np.inf
        bound = self.scores[asked, -1]
        short = np.flatnonzero(bound == -np.inf)
        if len(short) and len(names) > self.k:
            bound[short] = np.partition(rough[short], -self.k, axis=1)[:, -self.k]
        question, chunk = np.divmod(np.flatnonzero(rough >= (bound - SCREEN_ERROR).astype(np.float32)[:, None]), len(names))
        # Many copies may tie; they are scored in bounded pieces.
        for start in range(0, len(question), self.k + WAITING_VALUES // unit.shape[1]):
            piece = slice(start, start + self.k + WAITING_VALUES // unit.shape[1])
            self.keep(asked, question[piece], chunk[piece], names, unit, rough)

    def keep(
        self, asked: np.ndarray, question: np.ndarray, chunk: np.ndarray, names: np.ndarray, unit: np.ndarray, rough: np.ndarray
    ) -> None:
        place = asked[question]
        scores = np.round(np.einsum("ij,ij->i", self.unit[place], unit[chunk]), SCORE_DIGITS)
        # A tie with the last kept score may still win by its id.
        able = (scores >= self.scores[place, -1]) & (rough[question, chunk] > -np.inf)
        if not able.any():
            return
        place, scores, found = place[able], scores[able], names[chunk[able]]
        again = np.unique(place)
        place = np.concatenate([np.repeat(again, self.k), place])
        scores = np.concatenate([self.scores[again].ravel(), scores])
        found = np.concatenate([self.chunks[again].ravel(), found])
        order = np.lexsort((*(nulls_first(found) if found.dtype == object else (found,)), -scores, place))
        first = np.searchsorted(place[order], again)
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[again], self.chunks[again] = scores[best], found[best]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        self.flush()
        place, at = np.nonzero(self.scores > -np.inf)
        names = self.ids.take(pa.array(place)).cast(schema.field(0).type)
        chunks = [] if self.chunks is None else self.chunks[place, at]
        gone = chunks == NULL_KEY if len(chunks) and chunks.dtype == np.int64 else None
        columns = [names, pa.array(chunks, schema.field(1).type, mask=gone), pa.array(self.scores[place, at])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def unit_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have a direction, scaled to length one, and which ones they are."""
    norms = np.linalg.norm(vectors, axis=1)
    usable = (norms > 0) & np.isfinite(norms)
    return vectors[usable] / norms[usable, None], usable


def nulls_first(names: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys for ``lexsort`` that put nulls first, as Spark does."""
    known = ~np.equal(names, None).astype(bool)
    return (names,) if known.all() else (np.where(known, names, names[known][0] if known.any() else 0), known)


def as_matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def as_objects(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(object)


def as_keys(column: pa.Array) -> np.ndarray:
    """Ids as numbers if they are whole numbers, else as objects."""
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
    return as_objects(column)


def prepared_chunks(chunks: DataFrame, chunk_key: str) -> DataFrame:
    kind = F.col("doc_type") if "doc_type" in chunks.columns else F.lit(None).cast("string")
    cell = F.col("cell") if "cell" in chunks.columns else F.lit(0)
    return chunks.where(F.col("embedding").isNotNull()).select(
        F.col(chunk_key).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        kind.alias("doc_type"), cell.alias("cell"),
    )


def prepared_questions(questions: DataFrame) -> DataFrame:
    kind = F.col("doc_type") if "doc_type" in questions.columns else F.lit(None).cast("string")
    probes = F.col("probes") if "probes" in questions.columns else F.lit(None).cast("array<int>")
    return questions.where(F.col("embedding").isNotNull()).select(
        "query_id", F.col("embedding").cast("array<double>").alias("embedding"), kind.alias("doc_type"),
        probes.alias("probes"),
    )


def vector_topk(
    questions: DataFrame, chunks: DataFrame, dimensions: int, k: int = K.CANDIDATES, chunk_key: str = "chunk_id",
    broadcast_values: int = BROADCAST_VALUES, block_values: int = BLOCK_VALUES, row_values: int = ROW_VALUES,
) -> DataFrame:
    """``(query_id, chunk_id, raw_score, rank)`` of the ``k`` nearest chunks by cosine.

    Chunks without a vector and zero vectors match nothing. A question's ``doc_type``, if any,
    limits its chunks before ranking. A task scores questions of ``block_values`` values at once; beyond the broadcast bound it
    holds questions of about ``row_values`` values.
    """
    asked, offered = prepared_questions(questions), prepared_chunks(chunks, chunk_key)
    result = T.StructType(
        [asked.schema["query_id"], offered.schema["chunk_id"], T.StructField("raw_score", T.DoubleType())]
    )
    bound = min(broadcast_values // dimensions, BROADCAST_QUESTIONS)
    block = asked.limit(bound + 1).toArrow()
    if block.num_rows <= bound:
        partial = broadcast_topk(block, offered, result, k, block_values)
    else:
        asked = persist_table(asked, "questions")
        partial = grid_topk(asked, offered, result, k, block_values, max(1, row_values // dimensions))
    return ranked(partial, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """Rank within a question; Spark limits each partition before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def arrow_schema(result: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(result)


def top_from(block: pa.Table, k: int, block_values: int) -> NearestChunks:
    block = block.combine_chunks()
    ids, vectors, probes = (one_array(block[name]) for name in ("query_id", "embedding", "probes"))
    return NearestChunks(
        ids, as_matrix(vectors) if block.num_rows else np.zeros((0, 1)), block["doc_type"].to_pylist(), k,
        None if probes.null_count == len(probes) else probes, block_values,
    )


def one_array(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined


def offer_batch(top: NearestChunks, batch: pa.RecordBatch | pa.Table) -> None:
    columns = [batch[name] for name in ("chunk_id", "embedding", "doc_type", "cell")]
    names, vectors, kinds, cells = (one_array(column) if isinstance(column, pa.ChunkedArray) else column for column in columns)
    if len(names):
        top.add(as_keys(names), as_matrix(vectors), as_objects(kinds), cells.to_numpy(zero_copy_only=False))


def broadcast_topk(block: pa.Table, offered: DataFrame, result: T.StructType, k: int, block_values: int) -> DataFrame:
    shared = offered.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = top_from(shared.value, k, block_values)
        for batch in batches:
            offer_batch(top, batch)
        yield top.batch(arrow_schema(result))

    return offered.mapInArrow(scan, result)


def grid_rows(asked: DataFrame, offered: DataFrame, result: T.StructType, row_questions: int) -> DataFrame:
    """Questions (``kind`` 0) and chunks (1) dealt to the cells ``(row, slice)`` of the grid, one partition each.

    A chunk is copied once a row, and there are no more rows than the memory of a task asks for; a question once a slice,
    and there are no more slices than keep the cores busy.
    """
    spark = asked.sparkSession
    rows = max(1, -(-asked.count() // row_questions))
    slices = max(1, -(-GRID_TASKS * spark.sparkContext.defaultParallelism // rows))
    q_type, c_type = (result[name].dataType.simpleString() for name in ("query_id", "chunk_id"))
    nulls = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = asked.select(
        F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("kind"), "query_id", nulls(c_type, "chunk_id"), "embedding", "doc_type", "probes",
        F.lit(0).alias("cell"),
    )
    right = offered.select(
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"),
        F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(1).alias("kind"), nulls(q_type, "query_id"), "chunk_id", "embedding", "doc_type",
        nulls("array<int>", "probes"), F.col("cell").cast("int").alias("cell"),
    )
    # Each (row, slice) group arrives with its questions first, then streams its chunks.
    dealt = left.unionByName(right).repartitionById(rows * slices, (F.col("row") * slices + F.col("slice")).cast("int"))
    return dealt.sortWithinPartitions("row", "slice", "kind")


def grid_topk(asked: DataFrame, offered: DataFrame, result: T.StructType, k: int, block_values: int, row_questions: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, top = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[name].to_numpy() for name in ("row", "slice", "kind")], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges], [*edges, len(marks)]):
                if start == end:
                    continue
                group, kind = tuple(marks[start, :2]), marks[start, 2]
                part = table.slice(start, end - start)
                if group != current:
                    if top is not None:
                        yield top.batch(arrow_schema(result))
                    current, held, top = group, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if top is None:
                    if not held:
                        continue
                    top = top_from(pa.concat_tables(held), k, block_values)
                offer_batch(top, part)
        if top is not None:
            yield top.batch(arrow_schema(result))

    return grid_rows(asked, offered, result, row_questions).mapInArrow(scan, result)


def cell_centres(chunks: DataFrame, cells: int, chunk_key: str, order: Column | None = None) -> np.ndarray:
    """Unit vectors of the ``cells`` chunks that come first in ``order``, by default the hash of their id."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, value: total + value * value)
    filled = chunks.where(F.col("embedding").isNotNull()).select(
        (F.xxhash64(chunk_key) if order is None else order).alias("place"), F.col(chunk_key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    chosen = filled.where(norm > 0).orderBy("place", "key").limit(cells).toArrow()
    centres = as_matrix(chosen.combine_chunks()["embedding"].combine_chunks())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def near_cells(vectors: pd.Series, centres: np.ndarray, count: int) -> np.ndarray:
    """The nearest centres of each vector, best first; ties go to the lower cell."""
    matrix = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    scores = np.round(matrix @ centres.T, SCORE_DIGITS)
    return np.argsort(-scores, axis=1, kind="stable")[:, :count]


def assign_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cell``; written partitioned by it, a search reads only probed cells."""

    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(near_cells(vectors, centres, 1)[:, 0])

    return chunks.where(F.col("embedding").isNotNull()).withColumn("cell", F.pandas_udf(nearest, "int")("embedding"))


def probe_cells(questions: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Adds ``probes``: the cells whose centres are nearest to a question."""

    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(near_cells(vectors, centres, probes).tolist())

    return questions.where(F.col("embedding").isNotNull()).withColumn(
        "probes", F.pandas_udf(nearest, "array<int>")("embedding")
    )


def trained_centres(
    chunks: DataFrame, chunk_key: str = "chunk_id", cells: int | None = None, rounds: int = ROUNDS, per_cell: int = TRAINED_ROWS
) -> np.ndarray:
    """Centres by Lloyd rounds in Spark; their number grows with the root of the chunks.

    They are trained on a share of the chunks, chosen by the hash of their key: of the order of ``per_cell`` a cell. A round
    brings one sum per cell and dimension to the driver. A centre that attracts nothing stays where it is.
    """
    filled = chunks.where(F.col("embedding").isNotNull()).select(chunk_key, F.col("embedding").cast("array<double>").alias("embedding"))
    rows = filled.count()
    cells = cells or max(1, round(rows**0.5))
    share = F.pmod(F.xxhash64(chunk_key), F.lit(max(1, rows // (cells * per_cell)))) == 0
    sample = persist_table(filled.where(share).withColumn("embedding", text.normalise(F.col("embedding"))), "training")
    centres = cell_centres(filled, cells, chunk_key)
    for _ in range(rounds):
        values = assign_cells(sample, centres).select("cell", F.posexplode("embedding").alias("place", "value"))
        sums = values.groupBy("cell", "place").agg(F.sum("value").alias("total")).toPandas()
        moved = np.zeros_like(centres)
        moved[sums["cell"], sums["place"]] = sums["total"]
        norms = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(norms > 0, np.divide(moved, norms, out=np.zeros_like(moved), where=norms > 0), centres)
    return centres


def probes_for_recall(
    questions: DataFrame, celled: DataFrame, centres: np.ndarray, recall: float, k: int = K.CANDIDATES,
    chunk_key: str = "chunk_id", sample: int = PROBED_QUESTIONS,
) -> int:
    """The fewest nearest cells that hold the wanted share of the exact hits of a bounded sample of ``questions``."""
    asked = persist_table(
        questions.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "probing"
    )
    exact = vector_topk(asked, celled.drop("cell"), centres.shape[1], k, chunk_key).select("query_id", "chunk_id")
    order = probe_cells(asked, centres, len(centres)).select("query_id", "probes")
    hits = exact.join(celled.select(F.col(chunk_key).alias("chunk_id"), "cell"), "chunk_id").join(order, "query_id")
    counts = hits.groupBy(F.array_position("probes", F.col("cell")).alias("place")).count().orderBy("place").collect()
    total, seen = sum(row["count"] for row in counts), 0
    for row in counts:
        seen += row["count"]
        if seen >= recall * total:
            return int(row["place"])
    return len(centres)


def write_cells(chunks: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """``chunks`` with their cell, written partitioned by it, so that a search opens the files of its cells only."""
    celled = assign_cells(chunks, centres)
    salt = F.pmod(F.xxhash64(*[name for name in chunks.columns if name != "embedding"]), F.lit(CELL_FILES))
    celled.repartition("cell", salt).write.partitionBy("cell").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def probed_topk(
    questions: DataFrame, celled: DataFrame, centres: np.ndarray, probes: int, k: int = K.CANDIDATES, chunk_key: str = "chunk_id"
) -> DataFrame:
    """``vector_topk`` over the ``probes`` nearest cells of each question; cells that no question looks into are not read."""
    asked = persist_table(probe_cells(questions, centres, probes), "probing")
    wanted = [row.cell for row in asked.select(F.explode("probes").alias("cell")).distinct().collect()]
    return vector_topk(asked, celled.where(F.col("cell").isin(wanted)), centres.shape[1], k, chunk_key)


def vector_topk_ann(
    questions: DataFrame, chunks: DataFrame, dimensions: int, cells: int | None = None, probes: int | None = None,
    k: int = K.CANDIDATES, chunk_key: str = "chunk_id", order: Column | None = None, recall: float = RECALL,
) -> DataFrame:
    """Approximate ``vector_topk``: each question looks into its nearest cells only.

    A chunk lies in one cell, so no candidate appears twice and a crowded cell is read by many tasks. Scores of the found
    chunks are exact. Centres are trained, or with ``order`` the first chunks in it. Without ``probes``, as many cells are
    probed as a sample of the questions needs for ``recall``: few if the vectors lie in groups, most cells if they do not.
    """
    centres = trained_centres(chunks, chunk_key, cells) if order is None else cell_centres(chunks, cells or FIRST_CELLS, chunk_key, order)
    celled = assign_cells(chunks, centres)
    if probes is None:
        celled = persist_table(celled, "celled")
        probes = probes_for_recall(questions, celled, centres, recall, k, chunk_key)
    return probed_topk(questions, celled, centres, probes, k, chunk_key)


def recall_against(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").agg(
        F.count("*").alias("exact_hits"), F.count("hit").alias("found_hits"),
        F.round(F.count("hit") / F.count("*"), 6).alias("recall"),
    )
