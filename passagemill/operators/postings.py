"""Postings stored by lexeme: blocks of one lexeme over a piece of the documents, each with its largest weight.

A search reads the blocks of its own lexemes: each piece is sorted by lexeme, so the lexemes pushed to the scan skip row groups
and pages. Of these, blocks that cannot lift any passage to a question's last wanted score are left out before their postings
are opened. A common lexeme has many blocks, which lie in several files and are read by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import constants as K
from passagemill.functions import stem
from passagemill.operators import keyword
from passagemill.operators.vector import SCORE_DIGITS, ranked
from passagemill.session import persist_table

BLOCK = 512
#: Postings of a piece, rows that are added to it at once, and postings that leave the task at once.
PIECE, ROWS, SENT_POSTINGS = 400_000, 200, 50_000
#: Blocks whose postings a search puts together at once.
GROUPED_BLOCKS = 1_000
#: Small row groups, so that one lexeme's neighbours are not read with it.
ROW_GROUP_BYTES = 4 << 20
STORED = {"parquet.block.size": ROW_GROUP_BYTES}
#: Values of a column that are pushed to a scan; more of them are joined. They are pushed in lists of a few.
PUSHED_VALUES, LISTED_VALUES = 2_000, 50
#: From so many matched postings on, one more pass over block heads finds the blocks that can be left out.
PRUNED_POSTINGS = 2_000_000

ENTRY = "struct<chunk_id: string, document_id: string, doc_type: string, weight: double>"
PART_SCHEMA = "layer string, document_id string, chunk_id string, doc_type string, terms array<struct<lexeme: string, weight: double>>"
BLOCK_SCHEMA = f"lexeme string, documents bigint, postings int, most double, entries array<{ENTRY}>"


def posting_blocks(terms: DataFrame, size: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Blocks of up to ``size`` postings of ``terms`` (see ``keyword.chunk_terms``), sorted by lexeme and document in each piece.

    Whole chunks are shuffled by document, not their postings. A task turns its chunks in pieces of about ``piece`` postings, cut
    between documents: a chunk id occurs many times in a piece but is stored once for it, in the dictionary of its column, and
    all postings of a chunk lie side by side for a search. A common lexeme has blocks in every piece; ``documents`` counts the
    documents that begin in a block, and its sums are the documents of a lexeme.
    """
    names = ["chunk_id", "document_id", "doc_type", "weight"]
    dealt = terms.select(*names[:3], "terms").repartition("document_id").sortWithinPartitions("document_id", "chunk_id")

    def document_starts(table: pa.Table) -> np.ndarray:
        """Whether a row has another document than the one before; rows without an id are documents of their own."""
        ids = table["document_id"].combine_chunks().dictionary_encode().indices
        codes = ids.fill_null(-1).to_numpy()
        return (np.diff(codes, prepend=-2) != 0) | (codes == -1)

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = table["terms"].combine_chunks()
        entries = lists.flatten()
        if not len(entries):
            return
        words = entries.field("lexeme").dictionary_encode()
        alphabet = pc.sort_indices(words.dictionary)
        place = np.empty(len(alphabet), dtype=np.int64)
        place[alphabet.to_numpy()] = np.arange(len(alphabet))
        lexeme = place[words.indices.to_numpy()]
        order = np.argsort(lexeme, kind="stable")
        lexeme = lexeme[order]
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())[order]
        document = np.cumsum(document_starts(table))[row]
        cut = np.flatnonzero(np.diff(lexeme, prepend=-1))
        starts = np.concatenate([np.arange(low, high, size) for low, high in zip(cut, np.append(cut[1:], len(lexeme)))])
        begins = np.diff(document, prepend=-1) != 0
        begins[cut] = True
        documents = np.add.reduceat(begins.astype(np.int64), starts)
        weight = entries.field("weight").to_numpy(zero_copy_only=False)[order]
        most = np.maximum.reduceat(weight, starts)
        bounds = np.append(starts, len(lexeme))
        named = words.dictionary.take(alphabet)
        ids = {name: table[name].combine_chunks() for name in names[:3]}
        low = 0
        while low < len(starts):
            # Some blocks at a time: their ids are repeated here.
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SENT_POSTINGS)))
            high = min(high, len(starts))
            held = slice(bounds[low], bounds[high])
            taken = [column.take(pa.array(row[held])) for column in ids.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    named.take(pa.array(lexeme[starts[low:high]])), pa.array(documents[low:high]),
                    pa.array(np.diff(bounds[low : high + 1]), pa.int32()), pa.array(most[low:high]),
                    pa.ListArray.from_arrays(
                        pa.array(bounds[low : high + 1] - bounds[low], pa.int32()), pa.StructArray.from_arrays([*taken, pa.array(weight[held])], names)
                    ),
                ],
                ["lexeme", "documents", "postings", "most", "entries"],
            )
            low = high

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                held.append(part)
                count += pc.sum(pc.list_value_length(part["terms"])).as_py() or 0
                if count < piece:
                    continue
                table = pa.Table.from_batches(held)
                # The last document may go on.
                last = int(np.flatnonzero(document_starts(table))[-1])
                if last:
                    yield from blocks(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
                    count = sum(pc.sum(pc.list_value_length(rest["terms"])).as_py() or 0 for rest in held)
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return dealt.mapInArrow(kernel, BLOCK_SCHEMA)


def lexeme_documents(blocks: DataFrame) -> DataFrame:
    """Documents per lexeme, from block heads only."""
    return blocks.groupBy("lexeme").agg(F.sum("documents").alias("documents"))


def having(rows: DataFrame, column: str, values: list) -> DataFrame:
    """The rows with one of ``values``. The list is pushed to the scan, where sorted files skip row groups and pages."""
    spark = rows.sparkSession
    if len(values) > PUSHED_VALUES:
        wanted = spark.createDataFrame([(value,) for value in values], T.StructType([rows.schema[column]]))
        # The list came from the driver; without the hint the rows would be shuffled with all that they hold.
        return rows.join(F.broadcast(wanted), column, "left_semi")
    # Without this setting, more than ten values are pushed as one range from the least to the largest.
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LISTED_VALUES))
    # A list is pushed as a chain of alternatives that its readers descend, so a long one would overflow their stack: short ones meet in a tree.
    lists = [F.col(column).isin(values[start : start + LISTED_VALUES]) for start in range(0, len(values), LISTED_VALUES)] or [F.col(column).isin([])]
    while len(lists) > 1:
        lists = [reduce(or_, lists[start : start + 2]) for start in range(0, len(lists), 2)]
    return rows.where(lists[0])


def chunk_parts(blocks: DataFrame) -> DataFrame:
    """The postings of some blocks at a time, put together by chunk and layer: ``terms`` of lexeme and weight.

    A piece has all postings of its chunks, so a row holds many of them, and ids are not moved once for each posting.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, GROUPED_BLOCKS):
                part = batch.slice(begin, GROUPED_BLOCKS)
                entries = part["entries"].flatten()
                if not len(entries):
                    continue
                block = np.repeat(np.arange(part.num_rows), pc.list_value_length(part["entries"]).fill_null(0).to_numpy())
                layers = part["layer"].dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
                chunks = entries.field("chunk_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
                documents = entries.field("document_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
                order = np.lexsort((documents, chunks, layers[block]))
                keys = np.stack([layers[block], chunks, documents])[:, order]
                starts = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(axis=0)))
                first, rows = pa.array(order[starts]), pa.array(block[order])
                terms = pa.StructArray.from_arrays(
                    [part["lexeme"].take(rows), entries.field("weight").take(pa.array(order))], ["lexeme", "weight"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part["layer"].take(pa.array(block[order[starts]])), *(entries.field(name).take(first) for name in ("document_id", "chunk_id", "doc_type")),
                        pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), terms),
                    ],
                    ["layer", "document_id", "chunk_id", "doc_type", "terms"],
                )

    return blocks.select("layer", "lexeme", "entries").mapInArrow(kernel, PART_SCHEMA)


def entries_of(blocks: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Chunks with their matched ``terms``, without the documents that have left the block's layer (``gone``)."""
    rows = chunk_parts(blocks)
    if gone is not None:
        rows = rows.join(gone, ["document_id", "layer"], "left_anti")
    return rows.groupBy("chunk_id").agg(F.first("doc_type").alias("doc_type"), F.flatten(F.collect_list("terms")).alias("terms"))


def needed_weights(asked: pa.Table, matched: DataFrame, gone: DataFrame | None, result: T.StructType, k: int) -> DataFrame:
    """``lexeme`` and ``need``: blocks with a lower largest weight cannot lift a passage to the last wanted score of any question.

    The best blocks of each lexeme give passages whose scores so far bound that score from below; the other lexemes of a
    question count with their largest weight anywhere.
    """
    spark = matched.sparkSession
    # One best block of each lexeme is enough for a bound. Its first chunk names it, so no other block is moved.
    named = matched.withColumn("opens", F.col("entries")[0]["chunk_id"])
    heads = named.groupBy("lexeme").agg(F.max(F.struct("most", "layer", "opens")).alias("head")).select("lexeme", "head.*")
    best = persist_table(heads, "best-weights")
    same = F.col("block.lexeme").eqNullSafe(F.col("best.lexeme"))
    for name in ("most", "layer", "opens"):
        same &= F.col(f"block.{name}").eqNullSafe(F.col(f"best.{name}"))
    first = named.alias("block").join(F.broadcast(best).alias("best"), same, "left_semi").dropDuplicates(["lexeme"])
    known = ranked(keyword.scanned_scores(asked, entries_of(first, gone), result, k), k)
    floors = {row["query_id"]: row["raw_score"] for row in known.where(F.col("rank") == k).toLocalIterator()}
    most = {row["lexeme"]: row["most"] for row in best.toLocalIterator()}
    rows, total, need = asked.select(["query_id", "lexeme", "n"]).to_pylist(), {}, {}
    for row in rows:
        total[row["query_id"]] = total.get(row["query_id"], 0.0) + most.get(row["lexeme"], 0.0)
    for row in rows:
        name, floor = row["lexeme"], floors.get(row["query_id"])
        others = total[row["query_id"]] - most.get(name, 0.0)
        own = 0.0 if floor is None else (floor - 2 * 10.0**-SCORE_DIGITS) * row["n"] - others
        need[name] = min(need.get(name, np.inf), own)
    return spark.createDataFrame(list(need.items()), "lexeme string, need double")


def stored_topk(
    questions: DataFrame, blocks: DataFrame, k: int = K.CANDIDATES, stemmer: keyword.Stemmer = stem.identity,
    gone: DataFrame | None = None, pruned_from: int = PRUNED_POSTINGS, broadcast_rows: int = keyword.BROADCAST_ROWS,
) -> DataFrame:
    """``keyword_topk`` over stored ``blocks`` (with their ``layer``): the same rows, from the blocks of the questions' lexemes only.

    ``gone``: ``(document_id, layer)`` that a later layer has replaced. More question lexemes than ``broadcast_rows`` are
    dealt to a grid with the postings.
    """
    wanted = keyword.question_lexemes(questions, stemmer)
    asked = wanted.limit(broadcast_rows + 1).toArrow()
    if asked.num_rows > broadcast_rows:
        return ranked(keyword.grid_scores(wanted, entries_of(blocks, gone), k), k)
    result = T.StructType([wanted.schema["query_id"], T.StructField("chunk_id", T.StringType()), T.StructField("raw_score", T.DoubleType())])
    matched = having(blocks, "lexeme", sorted(pc.unique(asked["lexeme"]).to_pylist()))
    if (matched.agg(F.sum("postings")).first()[0] or 0) >= pruned_from:
        need = needed_weights(asked, matched, gone, result, k)
        matched = matched.join(F.broadcast(need), "lexeme").where(F.col("most") >= F.col("need"))
    return ranked(keyword.scanned_scores(asked, entries_of(matched, gone), result, k), k)
