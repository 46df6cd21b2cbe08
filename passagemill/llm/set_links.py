"""Connected components of sets under a bound on their Jaccard similarity, from keys that similar sets share.

Sets that share a key meet. No pairs of a class (the sets under one key) are formed; instead

1. every member of a class is compared with the first one of it. Similar ones are linked, and the links give components;
2. a class whose members now lie in one component has nothing left to say. The members of all other classes, whatever their
   size, go into an exact join: two sets of different components that reach the bound must share one of their first few
   hashes, counted from the rarest, and where it lies bounds what they can have in common (prefix and position filters).
   There again the first set under each hash meets the others before all that are still apart do; what remains is compared.

So two similar sets that share any key end in one component: either their class is settled, or both are in the exact join.
Hashes that lie in one component only are no keys of that join, so a group of copies of any size meets nothing there, and
pages that share a template just below the bound meet by their own words only. Sets travel as sorted hashes, never as texts.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.components import components
from passagemill.llm.tables import apart, forget, text_mark
from passagemill.session import persist_table


@dataclass(frozen=True)
class Bound:
    """``above * intersection >= below * union``: 5 and 4 for a similarity of at least 0.8."""

    above: int
    below: int

    def reached(self, one: np.ndarray, two: np.ndarray) -> bool:
        both = len(np.intersect1d(one, two, assume_unique=True))
        return self.above * both >= self.below * (len(one) + len(two) - both)

    def least_size(self, n: Column) -> Column:
        """The fewest elements that a similar set can have."""
        return self._up(n * self.below, self.above)

    def least_shared(self, sizes: Column) -> Column:
        """What two sets must have in common, from the sum of their sizes."""
        return self._up(sizes * self.below, self.above + self.below)

    @staticmethod
    def _up(value: Column, by: int) -> Column:
        return ((value + F.pmod(-value, F.lit(by))) / by).cast("int")


#: Longs of a set's sketch: the parity of its hashes in each of 64 cells a long. Where two sketches differ, so do the sets.
SKETCH = [f"sketch{i}" for i in range(16)]


def sketch(held: np.ndarray) -> np.ndarray:
    cells = np.bincount((held & np.uint64(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(cells.astype(bool)).view(np.int64)


def set_name(held: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(held.tobytes())


def signatures(
    docs: DataFrame, id_col: str, text_col: str, hashes: Callable[[str | None], np.ndarray], keys: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """``_id``, ``_mark``, ``set`` (128 bits of the sorted hashes), ``n`` (their number) and ``keys`` of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), text_mark(text_col).alias("_mark"), F.col(text_col).alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, found = [], [], []
            for text in batch.column("_text"):
                held = hashes(text.as_py())
                names.append(set_name(held))
                sizes.append(len(held))
                found.append(keys(held))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_mark"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["_id", "_mark", "set", "n", "keys"],
            )

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"_id {id_type}, _mark int, set binary, n bigint, keys array<bigint>")


def hashed_sets(texts: DataFrame, hashes: Callable[[str | None], np.ndarray]) -> DataFrame:
    """``set``, ``hashes`` and the sketch of ``texts`` (``set``, ``_text``)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [hashes(text.as_py()) for text in batch.column("_text")]
            drawn = np.array([sketch(one) for one in held], dtype=np.int64).reshape(len(held), len(SKETCH))
            lists = pa.array([one.view(np.int64) for one in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("set"), lists, *map(pa.array, drawn.T.copy())], ["set", "hashes", *SKETCH])

    return texts.mapInArrow(kernel, "set binary, hashes array<bigint>, " + ", ".join(f"{name} bigint" for name in SKETCH))


def verified(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that reach the bound, written. ``sets`` is a written table, so the joins can split it as it is."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # View the flat values: a set's hashes lie in one slice of them.
            sides = []
            for name in ("one", "two"):
                column = batch.column(name)
                sides.append((column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()))
            (left, at_left), (right, at_right) = sides
            near = [
                bound.reached(left[at_left[i] : at_left[i + 1]], right[at_right[i] : at_right[i + 1]]) for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (sets.select(F.col("set").alias(key), F.col("hashes").alias(name)) for key, name in (("a", "one"), ("b", "two")))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return persist_table(met.mapInArrow(kernel, "a binary, b binary"), "set-links")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (``set``, ...) with ``root`` (see ``components``); a set without links is its own."""
    return rows.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def postings(sets: DataFrame, bound: Bound) -> DataFrame:
    """``hash``, ``set``, ``root``, ``n`` and ``place``: the first hashes of ``sets`` (``set``, ``root``, ``hashes``), rarest first.

    A set gives as many as hold one of those that it shares with a similar set that is not longer. Hashes of one set or of one
    root only take a place but are left out; those of one set come first and are not moved.
    """
    n = F.col("n")
    # Of the roots under a hash it matters only whether they differ, so 64 bits of each are enough.
    rooted_words = sets.select(F.xxhash64("root").alias("root"), F.explode("hashes").alias("hash"))
    common = rooted_words.groupBy("hash").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("df > 1")
    common = common.select("hash", "df", (F.col("low") != F.col("high")).alias("mixed"))
    entry = F.struct("df", "hash", "mixed")
    words = sets.select("set", F.explode("hashes").alias("hash")).join(apart(common, "hash"), "hash")
    ranked = words.groupBy("set").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    sizes = sets.select("set", "root", F.size("hashes").cast("bigint").alias("n"))
    single = n - F.size("ranked")
    first = F.slice("ranked", F.lit(1), F.greatest(n - bound.least_size(n) + 1 - single, F.lit(0)).cast("int"))
    placed = ranked.join(apart(sizes, "set"), "set").select("set", "root", "n", single.alias("single"), F.posexplode(first).alias("later", "at"))
    entries = placed.where("at.mixed").select(F.col("at.hash").alias("hash"), "set", "root", "n", (F.col("later") + F.col("single")).alias("place"))
    return persist_table(entries, "postings")


def sketched(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """``posted`` with the sketches, which are wide and so join it only where pairs are formed."""
    return posted.join(sets.select("set", *SKETCH), "set")


def candidates(posted: DataFrame, short: DataFrame, bound: Bound) -> DataFrame:
    """Pairs ``a``, ``b`` of different roots ``root_a``, ``root_b`` that share a hash where it leaves enough to share.

    Of two similar sets the shorter one has the first hash that they share among its first ``n - s + 1``, where ``s`` is what
    it shares with a set of its size; at that hash, no more than what follows in either can be shared. Sketches that differ
    in more bits than similar sets have different hashes rule a pair out; they are exact for that.
    """
    n, place = F.col("n"), F.col("place")
    meets = short.select("hash", *(F.col(name).alias(f"short_{name}") for name in ("set", "root", "n", "place", *SKETCH)))
    fits = F.col("short_root") != F.col("root")
    fits &= (F.col("short_n") < n) | ((F.col("short_n") == n) & (F.col("short_set") != F.col("set")))
    fits &= F.col("short_n") >= bound.least_size(n)
    needed = bound.least_shared(n + F.col("short_n"))
    fits &= F.least(n - place, F.col("short_n") - F.col("short_place")) >= needed
    differ = (F.bit_count(F.col(name).bitwiseXOR(F.col(f"short_{name}"))) for name in SKETCH)
    fits &= functools.reduce(operator.add, differ) <= n + F.col("short_n") - needed * 2
    pairs = posted.join(meets, "hash").where(fits)
    one, two = F.struct("set", "root"), F.struct(F.col("short_set").alias("set"), F.col("short_root").alias("root"))
    met = pairs.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two"))
    return met.select(*(F.col(f"{side}.set").alias(name) for side, name in (("one", "a"), ("two", "b"))), F.col("one.root").alias("root_a"), F.col("two.root").alias("root_b")).distinct()


def still_mixed(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """``posted`` (see ``postings``) with the roots of its roots (``node``, ``root``), under hashes that lie in several; written."""
    now = roots.select(F.col("node").alias("root"), F.col("root").alias("now"))
    again = persist_table(posted.join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now"), "postings")
    mixed = again.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high"))
    rest = persist_table(again.join(apart(mixed.select("hash"), "hash"), "hash"), "postings")
    forget(again)
    return rest


def exact_links(sets: DataFrame, roots: DataFrame, bound: Bound) -> DataFrame:
    """Links that join what is similar among ``sets`` (``set``, ``hashes``, sketch) but of different ``roots``."""
    shorter = F.col("place") <= F.col("n") - bound.least_shared(F.col("n") * 2)
    posted = postings(rooted(sets, roots), bound)
    # The first set of each hash links a crowd that has it in common, so that only few meet below.
    least = posted.where(shorter).groupBy("hash").agg(F.min_by(F.struct("set", "root", "n", "place"), "set").alias("one")).select("hash", "one.*")
    links = verified(candidates(sketched(posted, sets), sketched(least, sets), bound), sets, bound)
    joined = rooted(links.withColumnRenamed("a", "set"), roots).select(F.col("root").alias("a"), "b")
    joined = rooted(joined.withColumnRenamed("b", "set"), roots).select("a", F.col("root").alias("b"))
    rest = still_mixed(posted, components(joined))
    # All pairs of two components would say the same, and a pair meets under each hash that it shares. So one set of each component
    # stands for it under a hash, one pair of two components is compared, and only what is still apart then forms all its pairs.
    stand = rest.groupBy("hash", "root").agg(F.min(F.struct("place", "n", "set")).alias("one")).select("hash", "root", "one.*")
    drawn = persist_table(sketched(stand, sets), "postings")
    pairs = persist_table(candidates(drawn, drawn.where(shorter), bound), "set-pairs")
    near = compared(pairs, pairs.groupBy(*ends()).agg(F.min(F.struct("a", "b")).alias("one")).select("one.*"), sets, bound)
    left = still_mixed(rest, components(near))
    full = persist_table(sketched(left, sets), "postings")
    every = persist_table(candidates(full, full.where(shorter), bound), "set-pairs")
    far = compared(every, every.select("a", "b"), sets, bound)
    forget(posted, rest, drawn, pairs, left, full, every)
    return links.unionByName(near).unionByName(far)


def ends() -> tuple[Column, Column]:
    return F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")


def compared(pairs: DataFrame, asked: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """``a`` and ``b``: the roots of those of the ``pairs`` (see ``candidates``) that are ``asked`` for and reach the bound; written."""
    found = pairs.join(apart(verified(asked, sets, bound), "a", "b"), ["a", "b"])
    return persist_table(found.select(*ends()).distinct().toDF("a", "b"), "set-edges")


def linked_sets(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], bound: Bound) -> DataFrame:
    """``node`` and ``root`` of the sets that are linked to another one.

    ``nodes``: ``set`` and ``keys``, one row per set; ``fetch`` returns ``set`` and ``hashes`` of the sets asked for (``set``).
    """
    keyed = persist_table(nodes.select(F.explode("keys").alias("key"), "set"), "keys")
    classes = keyed.groupBy("key").agg(F.min("set").alias("first"), F.max("set").alias("last")).where(F.col("first") != F.col("last"))
    members = persist_table(keyed.join(apart(classes.select("key", "first"), "key"), "key"), "classes")
    sets = persist_table(fetch(members.select("set").distinct()), "hashes")

    firsts = members.where(F.col("set") != F.col("first")).groupBy("set").agg(F.min("first").alias("a"))
    links = verified(firsts.select("a", F.col("set").alias("b")), sets, bound)
    roots = components(links)

    placed = rooted(members, roots)
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high"))
    open_sets = placed.join(apart(mixed.select("key"), "key"), "key").select("set").distinct()
    rest = persist_table(sets.join(apart(open_sets, "set"), "set"), "open-sets")
    linked = components(links.unionByName(exact_links(rest, roots, bound)))
    forget(keyed, members, sets, rest)
    return linked


def set_components(
    docs: DataFrame, id_col: str, text_col: str, hashes: Callable[[str | None], np.ndarray], keys: Callable[[np.ndarray], np.ndarray],
    bound: Bound, empty_alike: bool = False,
) -> DataFrame:
    """``_id``, ``_mark``, ``n``, ``component_id`` (the smallest id reachable over links) and ``root`` (the component's name) of each row.

    Rows of equal sets are one node; a set without keys is linked with nothing but rows of the same set, and empty sets only
    with each other, if ``empty_alike``. Null ids count only where a component has no other id, its ``component_id`` is then
    null. Repeated rows share a component, an empty table gives an empty table, and other columns are ignored.
    """
    rows = persist_table(signatures(docs, id_col, text_col, hashes, keys), "signatures")
    filled = rows if empty_alike else rows.where("n > 0")
    nodes = persist_table(
        filled.groupBy("set").agg(F.min("_id").alias("least"), F.min(F.struct("_id", "_mark")).alias("one"), F.first("keys").alias("keys")), "sets"
    )

    def fetch(asked: DataFrame) -> DataFrame:
        wanted = nodes.join(asked, "set", "left_semi").select("set", F.col("one._id").alias("_one_id"), F.col("one._mark").alias("_one_mark"))
        marked = docs.select(F.col(id_col).alias("_id"), text_mark(text_col).alias("_mark"), F.col(text_col).alias("_text"))
        same = F.col("_id").eqNullSafe(F.col("_one_id")) & (F.col("_mark") == F.col("_one_mark"))
        return hashed_sets(marked.join(wanted, same).select("set", "_text"), hashes).dropDuplicates(["set"])

    roots = linked_sets(nodes.select("set", "keys"), fetch, bound)
    classes = rooted(nodes.select("set", "least"), roots)
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id", "root")
    found = filled.select("_id", "_mark", "n", "set").join(named, "set").select("_id", "_mark", "n", "component_id", "root")
    return found if empty_alike else found.unionByName(rows.where("n = 0").select("_id", "_mark", "n", F.col("_id").alias("component_id"), F.col("set").alias("root")))
