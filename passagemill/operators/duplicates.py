"""Near duplicates across the whole corpus, by the word overlap used for passages.

Every document gets at most one ``repeat_of``: the document with the lowest id, below its own, whose
words overlap by the bound. The result grows with the documents, not with the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text
from passagemill.session import forget, persist_table

SKETCH_LONGS = 16
#: Postings of leaders that are sent to every task at once (at most 60 MB), and how often that is done before they are shuffled.
BROADCAST_POSTINGS = 200_000
BROADCASTS = 16
#: Postings of a slice of the words, which is what a shuffled join moves at once; each has a sketch (about 170 bytes).
SLICE_POSTINGS = 10_000_000
#: Words of the leaders that are sent to every task at once to compare pairs: 32 MB.
SENT_WORDS = 4_000_000
#: Leaders that a document meets at once.
MET_LEADERS = 256
SKETCHES = [f"sketch_{number}" for number in range(SKETCH_LONGS)]


def order_share(document_id: Column) -> Column:
    """Place of a hexadecimal id in id order, as a share of all ids."""
    return F.conv(F.substring(document_id, 1, 12), 16, 10).cast("bigint") / float(16**12)


def word_sets(documents: DataFrame) -> DataFrame:
    """Words as 64-bit hashes; two sets of 10,000 words confuse one with a probability of five in 10^12."""
    words = F.array_sort(text.distinct_words(F.col("content")))
    return documents.select("document_id", words.alias("words")).select(
        "document_id", F.transform("words", lambda word: F.xxhash64(word)).alias("words"),
        F.sha2(F.array_join("words", " "), 256).alias("signature"),
    )


def shared_words(sets: DataFrame, overlap: float) -> DataFrame:
    """What the search needs of each set: the words that it shares with any other, the rarest first.

    ``need`` words must be common with a larger set; ``spare`` of the shared words may be missing there, so the first
    common one is among the first ``spare + 1``. The sketches hold one bit for each shared word.
    """
    words = sets.select("document_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") > 1)
    # The place of a word's bit: four bits choose the long, six the bit in it.
    lane, bit = F.col("word").bitwiseAND(SKETCH_LONGS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("word", 8).bitwiseAND(63).cast("int"))
    sketches = [F.bit_or(F.when(lane == number, bit).otherwise(F.lit(0).cast("bigint"))).alias(name) for number, name in enumerate(SKETCHES)]
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("frequency", "word"))), lambda entry: entry["word"])
    need = F.ceil(F.col("n") * overlap - 1e-9).cast("int")
    return (
        words.join(frequency, "word")
        .groupBy("document_id", "n")
        .agg(rarest.alias("words"), *sketches)
        .withColumn("need", need)
        .withColumn("spare", F.size("words") - F.col("need"))
    )


def in_slice(postings: DataFrame, part: int, parts: int) -> DataFrame:
    """The postings of one of ``parts`` slices of the words."""
    return postings if parts == 1 else postings.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)


def candidates(small: DataFrame, large: DataFrame, sent: str = "", part: int = 0, parts: int = 1) -> DataFrame:
    """``(document_id, leader)`` of sets that meet in a word that may be their first common one, and pass the bounds.

    Both tables have the columns of ``shared_words`` and two flags: ``leads`` (may be a leader) and ``open`` (seeks one); the
    one named by ``sent`` goes to every task. Sets meet in the words of slice ``part`` of ``parts``. The larger set of a pair must hold ``need`` words from the common one on. Each bit that only the smaller one has is a word that the larger
    one lacks; more than ``spare`` of them rule the pair out. All are conditions of the join, so only what they leave becomes a row.
    """
    opening = F.slice("words", F.lit(1), F.greatest(F.col("spare") + 1, F.lit(0)))
    left = small.where(F.col("spare") >= 0).select(
        F.col("document_id").alias("smaller"), "n", "need", "spare", "leads", "open", *SKETCHES, F.explode(opening).alias("word")
    )
    right = large.select(
        F.col("document_id").alias("larger"), F.col("n").alias("larger_n"), F.size("words").alias("held"),
        F.col("leads").alias("larger_leads"), F.col("open").alias("larger_open"),
        *[F.col(name).alias(f"larger_{name}") for name in SKETCHES], F.posexplode("words").alias("place", "word"),
    )
    left, right = (in_slice(side, part, parts) for side in (left, right))
    left, right = (F.broadcast(side) if sent == name else side for name, side in (("small", left), ("large", right)))
    lacking = reduce(
        lambda total, count: total + count,
        [F.bit_count(F.col(name).bitwiseAND(F.bitwise_not(F.col(f"larger_{name}")))) for name in SKETCHES],
    )
    larger_first = F.col("larger") < F.col("smaller")
    sought = F.when(larger_first, F.col("larger_leads") & F.col("open")).otherwise(F.col("leads") & F.col("larger_open"))
    larger_set = (F.col("larger_n") > F.col("n")) | ((F.col("larger_n") == F.col("n")) & (F.col("larger") != F.col("smaller")))
    return (
        left.join(right, "word")
        .where(larger_set & sought & (F.col("held") - F.col("place") >= F.col("need")) & (lacking <= F.col("spare")))
        .select(F.greatest("smaller", "larger").alias("document_id"), F.least("smaller", "larger").alias("leader"))
    )


def round_candidates(flagged: DataFrame, last: bool) -> DataFrame:
    """The pairs of a round, written slice by slice of the words, so that the disk holds the postings of one slice at a time.

    While the leaders are few, their slices go to the tasks and the postings of all others stay in place.
    """
    leaders, open_sets = flagged.where("leads"), flagged.where("open")
    postings = F.sum(F.size("words"))
    if not last:
        slices = -(-(leaders.agg(postings).first()[0] or 0) // max(BROADCAST_POSTINGS, 1))
        if BROADCAST_POSTINGS and slices <= BROADCASTS:
            return written_pairs([
                candidates(leaders, open_sets, "small", part, slices).unionByName(candidates(open_sets, leaders, "large", part, slices))
                for part in range(slices)
            ], flagged)
    either = flagged.where(F.col("leads") | F.col("open"))
    slices = max(1, -(-(either.agg(postings).first()[0] or 0) // SLICE_POSTINGS))
    return written_pairs([candidates(either, either, part=part, parts=slices) for part in range(slices)], flagged)


def written_pairs(slices: list[DataFrame], flagged: DataFrame) -> DataFrame:
    name = F.col("document_id")
    none = flagged.select(name, name.alias("leader")).limit(0)
    return reduce(DataFrame.unionByName, [persist_table(pairs.distinct(), "pairs") for pairs in slices or [none]])


def partners_below(pairs: DataFrame, sets: DataFrame, leaders: DataFrame, overlap: float) -> DataFrame:
    """The lowest overlapping leader of each document that has one.

    A slice of the ``leaders`` at a time, the lowest first, goes to every task, and a document's words move once for a slice and not
    for a pair. A document leaves with its first partner.
    """
    left = sets.select("document_id", "n", "words")
    right = leaders.select(F.col("document_id").alias("leader"), F.col("n").alias("leader_n"), F.col("words").alias("leader_words"))
    slices = max(1, -(-(leaders.agg(F.sum(F.size("words"))).first()[0] or 0) // SENT_WORDS))
    edges = leaders.approxQuantile("document_id", [part / slices for part in range(1, slices)], 0.1 / slices) if slices > 1 else []
    found: list[DataFrame] = []
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.lit(True) if low is None else F.col("leader") > int(low)
        inside &= F.lit(True) if high is None else F.col("leader") <= int(high)
        some = pairs.where(inside)
        if found:
            some = some.join(reduce(DataFrame.unionByName, found).select("document_id"), "document_id", "left_anti")
        lists = some.groupBy("document_id").agg(F.collect_set("leader").alias("leaders")).join(left, "document_id")
        met = lowest_partners(lists, right.where(inside), overlap)
        found.append(persist_table(met.groupBy("document_id").agg(F.min("repeat_of").alias("repeat_of")), "partners"))
    return reduce(DataFrame.unionByName, found)


def lowest_partners(lists: DataFrame, leaders: DataFrame, overlap: float) -> DataFrame:
    """The lowest of the ``leaders`` of each row of ``lists`` that overlaps with it.

    The words of all leaders go to every task as numbers. A document marks its own, and the marks of its leaders are summed a few
    leaders at a time, the lowest first: no row is made for a pair, and no word is hashed for one.
    """
    sent = leaders.select("leader", "leader_n", F.array_distinct("leader_words").alias("leader_words")).orderBy("leader").toArrow().combine_chunks()
    lengths = pc.list_value_length(sent["leader_words"]).to_numpy()
    vocabulary, codes = np.unique(pc.list_flatten(sent["leader_words"]).to_numpy(), return_inverse=True)
    ids, sizes = sent["leader"].to_numpy(), sent["leader_n"].to_numpy()
    shared = lists.sparkSession.sparkContext.broadcast((ids, sizes, np.append(0, np.cumsum(lengths)), vocabulary, codes.astype(np.int32)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, starts, vocabulary, codes = shared.value
        marks = np.zeros(len(vocabulary), dtype=np.int32)

        def lowest(n: int, words: np.ndarray, asked: np.ndarray) -> int | None:
            # Ids may come twice.
            first, last = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
            places = np.repeat(first, last - first) + ranges(last - first)
            known = np.searchsorted(vocabulary, words)
            inside = known < len(vocabulary)
            known = known[inside][vocabulary[known[inside]] == words[inside]]
            marks[known] = 1
            found = None
            for begin in range(0, len(places), MET_LEADERS):
                some = places[begin : begin + MET_LEADERS]
                held = starts[some + 1] - starts[some]
                sums = np.append(0, np.cumsum(marks[codes[np.repeat(starts[some], held) + ranges(held)]]))
                ends = np.cumsum(held)
                common = sums[ends] - sums[ends - held]
                passed = np.flatnonzero(common / np.minimum(n, sizes[some]) >= overlap)
                if len(passed):
                    found = int(ids[some[passed[0]]])
                    break
            marks[known] = 0
            return found

        for batch in batches:
            words, asked = (split_lists(batch[name]) for name in ("words", "leaders"))
            best = [lowest(n, mine, np.sort(theirs)) for n, mine, theirs in zip(batch["n"].to_pylist(), words, asked)]
            made = pa.RecordBatch.from_arrays([batch["document_id"], pa.array(best, pa.int64())], ["document_id", "repeat_of"])
            yield made.filter(made["repeat_of"].is_valid())

    return lists.select("document_id", "n", "words", "leaders").mapInArrow(kernel, "document_id bigint, repeat_of bigint")


def ranges(counts: np.ndarray) -> np.ndarray:
    """``0 .. count - 1`` for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def split_lists(column: pa.Array) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())[:-1])


def corpus_near_duplicates(
    documents: DataFrame, overlap: float = K.DUPLICATE_OVERLAP, growth: int = 256
) -> DataFrame:
    """``(document_id, repeat_of)`` for every ``(document_id, content)`` row.

    Equal word sets are one entry from the start. The others are searched in rounds over a growing
    share of the id order, and a document leaves once its partner is found: a large group of
    copies meets its first few members while only few leaders are out, so its pairs are never formed.
    """
    sets = persist_table(word_sets(documents), "word-sets")
    distinct = sets.groupBy("signature").agg(F.min(F.struct("document_id", "words")).alias("first")).select(
        "first.document_id", "first.words"
    )
    # The search moves ids often: they become numbers in their order.
    distinct = persist_table(distinct, "distinct-words")
    numbers = persist_table(numbered(distinct.select("document_id").where(F.col("document_id").isNotNull()).distinct()), "numbers")
    entries = distinct.join(numbers, "document_id", "left").select(F.col("number").alias("document_id"), "words")
    entries = persist_table(shared_words(entries, overlap), "distinct-sets")
    rounds = max(1, math.ceil(math.log(max(entries.count(), 2), growth)))
    found: DataFrame | None = None
    place = order_share(F.col("name"))
    lower = 0.0
    for step in range(rounds, 0, -1):
        upper = growth ** (1.0 - step)
        shares = numbers.select(F.col("number").alias("document_id"), F.col("document_id").alias("name"))
        leaders = shares.where((place >= lower) & (place < upper)).agg(F.min("document_id"), F.max("document_id")).first()
        least, most = (0, -1) if leaders[0] is None else leaders
        flagged = entries.withColumn("leads", F.col("document_id").between(least, most))
        if found is None:
            flagged = flagged.withColumn("open", F.lit(True))
        else:
            done = found.select("document_id", F.lit(True).alias("done"))
            flagged = flagged.join(done, "document_id", "left").withColumn("open", F.col("done").isNull()).drop("done")
            flagged = persist_table(flagged, "flagged")
        pairs = round_candidates(flagged, last=step == 1)
        partners = partners_below(pairs, entries, flagged.where("leads"), overlap)
        found = persist_table(partners if found is None else found.unionByName(partners), "partners")
        forget(pairs, *([] if step == rounds else [flagged]))
        lower = upper
    firsts = sets.groupBy("signature").agg(F.min("document_id").alias("first"))
    of, by = (numbers.select(F.col("document_id").alias(name), F.col("number").alias(key)) for name, key in (("first", "document_id"), ("repeat_of", "leader")))
    named = found.withColumnRenamed("repeat_of", "leader").join(of, "document_id").join(by, "leader").select("first", "repeat_of")
    earlier = firsts.join(named, "first", "left")
    own_first = F.when((F.col("first") != F.col("document_id")) & (F.col("n") > 0), F.col("first"))
    return sets.select("document_id", "signature", F.size("words").alias("n")).join(earlier, "signature").select(
        "document_id", F.coalesce("repeat_of", own_first).alias("repeat_of")
    )


def numbered(ids: DataFrame) -> DataFrame:
    """``document_id`` and ``number``, a long, in the order of the ids."""
    return ids.orderBy("document_id").withColumn("number", F.monotonically_increasing_id())


def duplicate_summary(repeats: DataFrame) -> DataFrame:
    """Documents that others repeat, with the number of their direct repeats."""
    return repeats.where(F.col("repeat_of").isNotNull()).groupBy(F.col("repeat_of").alias("document_id")).agg(
        F.count("*").alias("repeats")
    )
