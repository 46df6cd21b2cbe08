"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, found as one integer minimum.

A path through a conversation takes a letter per row (``K`` keep, ``R`` rerole, ``D`` delete) and an ``I`` for each inserted row.
Its weight is one integer: the cost in the high digits, below it a fixed number of three-bit digits, the i-th of them the
code of the i-th letter (``D < I < K < R``), zeros after the last. The smaller integer is the cheaper path or, at equal cost,
the one whose letters come first in ASCII; so a plain minimum over integers, row by row and role by role, decides everything.

Rows come sorted and leave again after ``BLOCK`` of them, so a task holds a block of texts, never a conversation: inserts
count to the row after them, so two paths over the same rows are equal or differ before either ends, and the digits of a
finished block can be replaced by one digit, the rank of its letters among the (at most four) paths that are still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 256
DIGIT = 3
LETTERS = "\0DIKR"
D, I, K, R = range(1, 5)
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: What has been put out: nothing, the system row, a user row, or whole pairs. The next role and where it leads.
START, SYSTEM, USER, PAIRS = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIRS), PAIRS: ("user", USER)}


class Path:
    """The best way to one state: its weight, its number of letters in this block, and what lies before the block."""

    __slots__ = ("weight", "letters", "origin")

    def __init__(self, weight: int, letters: int, origin: int):
        self.weight, self.letters, self.origin = weight, letters, origin


class Repair:
    """One conversation, taken in blocks of rows (role, text, must go)."""

    def __init__(self):
        self.costs: dict[int, int] = {START: 0}
        self.ranks: dict[int, int] = {START: 1}
        self.audits: dict[int, tuple | None] = {START: None}
        self.hashes = {START: hashlib.sha256()}

    def _walk(self, rows: list[tuple[str, str, bool, bool]], width: int) -> dict[int, Path]:
        low = DIGIT * width
        shift = [DIGIT * (width - 1 - place) for place in range(width)]
        paths = {q: Path((self.costs[q] << low) + (self.ranks[q] << shift[0]), 1, q) for q in self.costs}
        for role, _, gone, truncated in rows:
            ways: dict[int, Path] = {}

            def offer(state: int, weight: int, letters: int, origin: int) -> None:
                held = ways.get(state)
                if held is None or weight < held.weight:
                    ways[state] = Path(weight, letters, origin)

            extra = TRUNCATED * truncated
            initial = role[:1]
            for state, path in paths.items():
                # Two inserts in a row never pay: without them the roles still fit, or deleting the system row is cheaper.
                after = NEXT[state][1]
                inserted = path.weight + (INSERT << low) + (I << shift[path.letters])
                for q, weight, letters in ((state, path.weight, path.letters), (after, inserted, path.letters + 1)):
                    digit = shift[letters]
                    offer(q, weight + (DELETE << low) + (D << digit), letters + 1, path.origin)
                    if gone:
                        continue
                    wanted, then = NEXT[q]
                    if initial == wanted[0]:
                        offer(then, weight + (extra << low) + (K << digit), letters + 1, path.origin)
                        continue
                    if initial == "s" and q == START:
                        offer(SYSTEM, weight + (extra << low) + (K << digit), letters + 1, path.origin)
                    offer(then, weight + (REROLE + extra << low) + (R << digit), letters + 1, path.origin)
            paths = ways
        return paths

    def _take(self, state: int, path: Path, rows: list, width: int) -> tuple[int, tuple, object]:
        """Cost, audit and hash of one path after a block."""
        low = path.weight & ((1 << DIGIT * width) - 1)
        letters = [low >> DIGIT * (width - 1 - place) & 7 for place in range(1, path.letters)]
        digest, at, state, lines = self.hashes[path.origin].copy(), iter(rows), path.origin, []
        for letter in letters:
            role, text, *_ = next(at) if letter != I else ("", "")
            if letter == D:
                continue
            first = state == START
            if letter == K and state == START and role[:1] == "s":
                state = SYSTEM
            else:
                wanted, state = NEXT[state]
                role = role if letter == K else wanted
            lines.append(("" if first else "\n") + f"{role}:{text}")
        digest.update("".join(lines).encode())
        return path.weight >> DIGIT * width, (self.audits[path.origin], "".join(LETTERS[letter] for letter in letters)), digest

    def block(self, rows: list[tuple[str, str, bool, bool]]) -> None:
        width = 2 * len(rows) + 2
        paths = self._walk(rows, width)
        letters = {q: path.weight & ((1 << DIGIT * width) - 1) for q, path in paths.items()}
        order = {value: place for place, value in enumerate(sorted(set(letters.values())), 1)}
        taken = {q: self._take(q, path, rows, width) for q, path in paths.items()}
        self.costs = {q: cost for q, (cost, _, _) in taken.items()}
        self.audits = {q: audit for q, (_, audit, _) in taken.items()}
        self.hashes = {q: digest for q, (_, _, digest) in taken.items()}
        self.ranks = {q: order[value] for q, value in letters.items()}

    def finish(self, rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, str]:
        """Cost, audit and the hash of the repaired rows, after the last block."""
        width = 2 * len(rows) + 3
        low = DIGIT * width
        best, ends = None, None
        for state, path in self._walk(rows, width).items():
            weight = path.weight
            if state == SYSTEM:
                continue
            if state == USER:
                weight += (INSERT << low) + (I << DIGIT * (width - 1 - path.letters))
                path.letters += 1
            if best is None or weight < best:
                best, ends = weight, Path(weight, path.letters, path.origin)
        cost, audit, digest = self._take(START, ends, rows, width)
        parts = []
        while audit is not None:
            audit, part = audit
            parts.append(part)
        return cost, "".join(reversed(parts)), digest.hexdigest()


class Conversation:
    """Counts and repair of the rows of one conversation, which come in order."""

    def __init__(self, name):
        self.name, self.repair, self.held = name, Repair(), []
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        ink = text.rstrip(WHITE)
        fault = "blank" if not ink else "duplicate" if again else "truncated" if ink[-1] not in ".!?" else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.held.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        if len(self.held) == BLOCK:
            self.repair.block(self.held)
            self.held = []

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish(self.held)


def damaged(rows: DataFrame) -> DataFrame:
    """``_conv``, ``_turn``, ``_role``, ``_text`` and ``_gone`` of each row after the damage that its key decides.

    Null roles and texts, and nulls in the key, are one space. Dropped rows stay, marked ``_gone``, so that no conversation is lost.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col("conv_id").alias("_conv"), F.col("turn").cast("bigint").alias("_turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("_role"), text.alias("_text"), (kind == 0).alias("_gone"),
        times.alias("_times"),
    ).select("*", F.explode("_times").alias("_copy")).drop("_times", "_copy")


def seen_earlier() -> Column:
    same = Window.partitionBy("_conv", "_gone", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))
    return F.row_number().over(same) > 1


def repaired(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Faults, cost, audit and hash of each conversation of ``rows`` (``_conv``, ``_turn``, ``_role``, ``_text``, ``_gone``).

    One shuffle, by conversation; rows are sorted by turn (nulls first), then role and text, in bytes. Rows marked ``_gone``
    do not count, and a conversation of such rows only has zeros, no letters and the hash of nothing. Null ids are one conversation.
    A row with an empty role has no initial, so it is never kept as it is.
    """
    conv_type = rows.schema["_conv"].dataType
    result = T.StructType(
        [T.StructField(id_col, conv_type)]
        + [T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )
    dealt = rows.repartition("_conv").withColumn("_again", seen_earlier())
    order = [F.asc_nulls_first("_conv"), F.asc_nulls_first("_turn"), "_role", "_text", "_again"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, now, done = to_arrow_schema(result), None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*done), schema.types)], schema=schema)

        for batch in batches:
            names = ("_conv", "_turn", "_role", "_text", "_gone", "_again")
            for conv, turn, role, text, gone, again in zip(*(batch.column(name).to_pylist() for name in names)):
                if now is None or now.name != conv:
                    done += [now.row()] if now is not None else []
                    now = Conversation(conv)
                if not gone:
                    now.add(turn, role, text, again)
            if done:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
            yield out()

    return dealt.sortWithinPartitions(*order).mapInArrow(kernel, result)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of damaged ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored).

    Repeated rows are rows of their own (the later ones duplicates); an empty table gives an empty table.
    """
    return repaired(damaged(conversations))
