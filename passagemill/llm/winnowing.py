"""Repeated runs of units (words or lines) across and inside documents, found from winnowed anchors.

A *window* is ``length`` consecutive units of one document. Every window selects the smallest of its gram hashes (the
rightmost of equals) as its *anchor*; this depends on the window's own units only, so equal windows always have equal
anchors at equal places. Consecutive windows that select the same anchor form its *span*: the anchor extended both ways
over all the text that it alone guards.

1. Anchors are joined on the hash of the span: an anchor whose whole span also occurs earlier is settled, and all its
   windows are repeats. This is what the inside of a repeated run looks like.
2. The first anchor of each span is contested if its gram also anchors another span (at the ends of runs, where the
   neighbouring text differs, or by chance). Only contested spans are opened into single windows, which are joined on the
   window's hash. The earliest of equal windows lies in a first anchor, so no repeat is lost, and no pairs are formed.

Anchors whose gram occurs once leave first, by a count that is combined before the shuffle. Both joins are
against one earliest row per hash: a passage in a third of all documents costs one row per document. Spans and windows
are known by 96 bits of all their units; the gram only says which spans may meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagemill.llm.arrow import Spans, Units, mix, slices
from passagemill.llm.tables import apart, fresh, text_mark
from passagemill.session import persist_table

MARK = "_mark"  # tells apart rows that share an id


def marked(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``_id``, ``_mark`` and ``_text`` of each row: rows equal in id and text are one document, others are different ones.

    With ``carry``, ``_row`` holds the row's other columns, and whether its text is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(text_col).isNull().alias(fresh(docs, "no_text")), *(docs[name] for name in docs.columns if name not in (id_col, text_col))]
    return docs.select(
        F.col(id_col).alias("_id"), text_mark(text_col).alias(MARK), text.alias("_text"), *([F.struct(*rest).alias("_row")] if carry else [])
    )


def select_anchors(hashes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each span: its text's index, its first and last window's start, and the anchor's gram hash."""
    n, width = len(hashes), length - gram + 1
    if n < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, np.zeros(0, dtype=np.uint64)
    grams = hashes[: n - gram + 1].copy()
    for step in range(1, gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[step : n - gram + 1 + step]
    grams = mix(grams)
    value, place, reach = grams, np.arange(len(grams)), 1
    while reach * 2 <= width:
        right = value[reach:] <= value[:-reach]
        value, place = (np.where(right, x[reach:], x[:-reach]) for x in (value, place))
        reach *= 2
    shift = width - reach
    if shift:
        right = value[shift:] <= value[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(np.arange(n) + length <= first[text + 1])
    chosen = place[starts]
    opens = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(starts) else starts
    closes = np.concatenate([opens[1:], [len(starts)]])[: len(opens)] - 1
    return text[starts[opens]], starts[opens], starts[closes], grams[chosen[opens]]


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two small numbers in one, ordered by the first and then the second: fewer fields make smaller shuffles."""
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def high_of(column: str) -> Column:
    return F.shiftright(column, 32).cast("int")


def low_of(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _anchors(kind: str, length: int, gram: int, schema: pa.Schema):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                units = Units(part.column("_text"), kind)
                hashes = units.hashes()
                text, low, last, grams = select_anchors(hashes, units.first, length, gram)
                if len(text):
                    span, tail = Spans(hashes).of(low, last + length)
                    marks = part.column(MARK).to_numpy()[text]
                    columns = (packed(marks, low - units.first[text]), grams.view(np.int64), span, packed(tail, last - low))
                    yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(text)), *map(pa.array, columns)], schema=schema)

    return kernel


def _windows(kind: str, length: int, schema: pa.Schema):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                units = Units(part.column("_text"), kind)
                spans, opened, marks = Spans(units.hashes()), part.column("_spans"), part.column(MARK).to_numpy()
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(opened).to_numpy())
                low, last = (opened.flatten().field(name).to_numpy() for name in ("low", "last"))
                count = (last - low + 1).astype(np.int64)
                row = np.repeat(np.arange(len(low)), count)
                place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = place + units.first[text[row]]
                for begin in range(0, len(at), 200_000):
                    some = slice(begin, begin + 200_000)
                    one, two = spans.of(at[some], at[some] + length)
                    owner = text[row[some]]
                    columns = (packed(marks[owner], place[some]), one, two)
                    yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(owner)), *map(pa.array, columns)], schema=schema)

    return kernel


def repeated_ranges(texts: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """Unit ranges ``low .. high`` (exclusive) of ``texts`` (see ``marked``) that equal an earlier window of ``length`` units.

    Earlier: smaller ``_id`` (nulls first), then smaller ``_mark``, then an earlier start. Rows equal in id and text share
    their places, so neither is earlier than the other. The ranges of one document overlap.
    """
    if not 0 < gram <= length:
        raise ValueError("the gram must fit into the window")
    id_type, arrow_id = texts.schema["_id"].dataType.simpleString(), ("_id", pa_type(texts))
    # ``pos`` is the mark and the first unit of an anchor's span or of a window, ``span`` and the upper half of
    # ``tail`` the span's hash, the lower half its further windows.
    anchors = texts.mapInArrow(
        _anchors(kind, length, gram, pa.schema([arrow_id, ("pos", pa.int64()), ("gram", pa.int64()), ("span", pa.int64()), ("tail", pa.int64())])),
        f"_id {id_type}, pos bigint, gram bigint, span bigint, tail bigint",
    )
    # Most anchors are alone with their gram; all further steps see the others only.
    shared = anchors.groupBy("gram").count().where("count > 1").select("gram")
    met = persist_table(anchors.join(apart(shared, "gram"), "gram", "left_semi"), "anchors")
    place = F.struct("_id", "pos")
    firsts = persist_table(met.groupBy("gram", "span", "tail").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "firsts")
    settled = (
        met.join(firsts.where("copies > 1").select("gram", "span", "tail", "first"), ["gram", "span", "tail"])
        .where(place > F.col("first"))
        .select("_id", high_of("pos").alias(MARK), low_of("pos").alias("low"), (low_of("pos") + low_of("tail") + length).alias("high"))
    )
    several = firsts.groupBy("gram").count().where("count > 1").select("gram")
    low = low_of("first.pos")
    contested = (
        firsts.join(apart(several, "gram"), "gram", "left_semi")
        .groupBy(*document_key("first._id"), high_of("first.pos").alias(MARK))
        .agg(F.collect_list(F.struct(low.alias("low"), (low + low_of("tail")).alias("last"))).alias("_spans"))
    )
    windows = with_rows(texts, contested, "inner").mapInArrow(
        _windows(kind, length, pa.schema([arrow_id, ("pos", pa.int64()), ("one", pa.int64()), ("two", pa.int32())])),
        f"_id {id_type}, pos bigint, one bigint, two int",
    )
    earliest = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    opened = (
        windows.join(apart(earliest.select("one", "two", "first"), "one", "two"), ["one", "two"])
        .where(place > F.col("first"))
        .select("_id", high_of("pos").alias(MARK), low_of("pos").alias("low"), (low_of("pos") + length).alias("high"))
    )
    return settled.unionByName(opened)


def document_key(id_col: str) -> list[Column]:
    """An id, null or not, as two columns that plain equality compares, so that a table grouped by them is joined in place."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col(id_col).isNull().alias("_none")]


def with_rows(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with ``rows``, one per document, grouped by ``document_key`` and mark."""
    rows = rows.withColumnRenamed(MARK, "_mark2")
    key, none = document_key("_id")
    same = (key == F.col("_key")) & (none == F.col("_none")) & (F.col(MARK) == F.col("_mark2"))
    return texts.join(rows, same, how).drop("_key", "_none", "_mark2")


def pa_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(texts.schema["_id"].dataType)


def without_repeats(docs: DataFrame, id_col: str, text_col: str, kind: str, length: int, gram: int, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: ``_id``, ``_mark``, ``_text``, with ``carry`` ``_row`` (see ``marked``), ``kept_text``, ``n_units``, ``n_removed``.

    ``kept_text`` lacks the repeated units and the white space (or line ends and blank lines) that follows them.
    """
    texts = marked(docs, id_col, text_col, carry)
    names = texts.columns
    ranges = (
        repeated_ranges(texts, kind, length, gram)
        .groupBy(*document_key("_id"), MARK)
        .agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                units = Units(part.column("_text"), kind)
                kept, removed = [], []
                texts_, ranges_ = part.column("_text"), part.column("_ranges")
                low, high = (ranges_.flatten().field(name).to_numpy() for name in ("low", "high"))
                sizes = pc.fill_null(pc.list_value_length(ranges_), 0).to_numpy(zero_copy_only=False)
                at = 0
                for row, size in enumerate(sizes):
                    if not size:
                        kept.append(texts_[row].as_py())
                        removed.append(0)
                        continue
                    begin, end = units.first[row], units.first[row + 1]
                    depth = np.zeros(end - begin + 1, dtype=np.int64)
                    np.add.at(depth, low[at : at + size], 1)
                    np.add.at(depth, high[at : at + size], -1)
                    at += size
                    gone = np.cumsum(depth[:-1]) > 0
                    text_start, text_end = units.texts[row], units.texts[row + 1]
                    # A unit owns the bytes up to the next unit; those before the first one stay.
                    bounds = np.concatenate([units.start[begin:end], [text_end]])
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], ~gone, [False]]).astype(np.int8)))
                    cuts = [text_start, *bounds[edges]]
                    data = units.data
                    kept.append(b"".join(data[a:b].tobytes() for a, b in zip(cuts[::2], cuts[1::2])).decode())
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in names), pa.array(kept, pa.string()),
                     pa.array(np.diff(units.first)), pa.array(removed, pa.int64())],
                    [*names, "kept_text", "n_units", "n_removed"],
                )

    schema = StructType([*texts.schema, *StructType.fromDDL("kept_text string, n_units bigint, n_removed bigint")])
    return with_rows(texts, ranges, "left").mapInArrow(kernel, schema)


def with_kept_text(docs: DataFrame, id_col: str, text_col: str, size_col: str, dedup) -> DataFrame:
    """``docs`` with the texts that ``dedup`` leaves and their size in characters, without those that lost all their units.

    The other columns travel with the text, so it is shuffled once.
    """
    found = dedup(docs, id_col, text_col, carry=True).where("n_removed = 0 OR n_removed < n_units")
    text = F.when(~F.col("_row").getField(fresh(docs, "no_text")), F.col("kept_text"))

    def column(name: str):
        if name == text_col:
            return text.alias(name)
        if name == id_col:
            return F.col("_id").alias(name)
        held = F.col("_row").getField(name)
        if name == size_col:
            held = F.when(F.col("n_removed") == 0, held).otherwise(F.char_length("kept_text").cast(docs.schema[name].dataType))
        return held.alias(name)

    return found.select(*(column(name) for name in docs.columns))
