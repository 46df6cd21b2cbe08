"""SimHash near-duplicates: fingerprints that differ in at most two bits are linked, found by deletion variants.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of some half. So every distinct
fingerprint is indexed under 64 keys, a half with one bit taken out, and an equality join on the keys meets all links;
each meeting is verified. A key's class is searched inside one task up to ``CLASS`` fingerprints and sends on a spanning
forest of its links, not its pairs. Fingerprints of larger classes are indexed again under all 2,016 keys with two bits
taken out of the whole: those that share such a key are linked to its smallest, which is exact and needs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.components import components
from passagemill.llm.tables import drop_documents, text_mark
from passagemill.session import persist_table

CLASS = 4096
DISTANCE = 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words of the lower-cased text, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    plain = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(plain[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())),
        dtype=np.uint64, count=len(words) - size + 1,
    )


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[begin : begin + (1 << 16)].astype(">u8"))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``_id``, ``_mark`` and ``fp`` (the fingerprint as a signed long) of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), text_mark(text_col).alias("_mark"), F.col(text_col).alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(
                [simhash(shingle_hashes((text.as_py() or "").encode(), size)) for text in batch.column("_text")], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_mark"), pa.array(values.view(np.int64))], ["_id", "_mark", "fp"]
            )

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"_id {id_type}, _mark int, fp bigint")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(64, dtype=np.uint64)
    shift = np.where(place < 32, 0, 32).astype(np.uint64)
    keep = ~(np.uint64(1) << (place - shift)) & np.uint64(0xFFFFFFFF)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys = (((fp[:, None] >> shift) & keep) | (place << np.uint64(32))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], ["key", "fp"])


def _two_bit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right = np.triu_indices(64, 1)
    one = np.uint64(1)
    keep = ~((one << left.astype(np.uint64)) | (one << right.astype(np.uint64)))
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for begin in range(0, len(fp), 100):
            some = fp[begin : begin + 100]
            pair = np.tile(np.arange(len(keep), dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair), pa.array((some[:, None] & keep).ravel().view(np.int64)), pa.array(np.repeat(some, len(keep)).view(np.int64))],
                ["pair", "rest", "fp"],
            )


def _forest(members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of linked members: its first one and the others."""
    left = np.sort(members)
    while len(left) > 1:
        root, found, front = left[0], [], left[:1]
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for begin in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[begin : begin + 256, None] ^ left[None, :]) <= DISTANCE).any(axis=0)
            front, left = left[hit], left[~hit]
            found.append(front)
        if found and sum(map(len, found)):
            yield root, np.concatenate(found)


def _class_links(limit: int):
    def links(keys: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        sizes = np.diff(bounds)
        few = np.repeat((sizes > 1) & (sizes <= 16), sizes)
        key, value = keys[few], fp[few]
        for step in range(1, 16):
            near = (key[step:] == key[:-step]) & (np.bitwise_count(value[step:] ^ value[:-step]) <= DISTANCE)
            if near.any():
                yield value[:-step][near], value[step:][near]
        for group in np.flatnonzero(sizes > 16):
            members = fp[bounds[group] : bounds[group + 1]]
            for root, others in _forest(members):
                yield np.full(len(others), root, dtype=np.uint64), others

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by key. A class over ``limit`` is passed on as rows (fp, fp)."""

        def out(pairs):
            for a, b in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        none = np.zeros(0, dtype=np.uint64)
        held_key, held, large = none, none, None
        for batch in batches:
            keys = np.concatenate([held_key, batch.column("key").to_numpy().view(np.uint64)])
            fp = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if large is not None:  # the class that began before is over the limit
                more = int(np.searchsorted(keys != large, True))
                yield from out([(fp[:more], fp[:more])] if more else [])
                keys, fp = keys[more:], fp[more:]
                large = large if not len(keys) else None
            if not len(keys):
                held_key, held = none, none
                continue
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            over = np.repeat(np.diff(bounds) > limit, np.diff(bounds))
            if over.any():
                yield from out([(fp[over], fp[over])])
                large = keys[-1] if over[-1] else None
            cut = len(keys) if over[-1] else bounds[-2]
            done = ~over[:cut]
            yield from out(links(keys[:cut][done], fp[:cut][done]) if done.any() else [])
            held_key, held = keys[cut:], fp[cut:]
        if len(held):
            yield from out(links(held_key, held))

    return kernel


def linked_fingerprints(distinct: DataFrame, limit: int = CLASS) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what links of at most two bits connect among ``distinct`` (``fp``)."""
    met = persist_table(
        distinct.mapInArrow(_variants, "key bigint, fp bigint")
        .repartition("key").sortWithinPartitions("key").mapInArrow(_class_links(limit), "a bigint, b bigint"),
        "links",
    )
    wide = met.where("a = b").select(F.col("a").alias("fp")).distinct().mapInArrow(_two_bit_variants, "pair int, rest bigint, fp bigint")
    least = wide.groupBy("pair", "rest").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    opened = wide.join(least, ["pair", "rest"]).where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return met.where("a <> b").unionByName(opened)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, limit: int = CLASS) -> DataFrame:
    """``_id``, ``_mark``, ``fp``, ``component_id`` (the smallest id reachable over links of two bits) and ``root`` (a name of the
    component that no other has) of each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer than ``size`` words has one shingle,
    one without words (or null) the fingerprint zero, linked like any other. Repeated rows share a fingerprint and a
    component; null ids count only where a component has no other id, its ``component_id`` is then null. An empty table
    gives an empty table; other columns are ignored.
    """
    rows = persist_table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = persist_table(rows.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    roots = components(linked_fingerprints(distinct.select("fp"), limit))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("_id", "_mark", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of each row; see ``simhash_components``."""
    return simhash_components(docs, id_col, text_col).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows that share that id stay together; rows without an id stay only where the component has no id at all.
    """
    found = simhash_components(docs, id_col, text_col)
    return drop_documents(docs, id_col, text_col, found.where(~F.col("_id").eqNullSafe(F.col("component_id"))))
