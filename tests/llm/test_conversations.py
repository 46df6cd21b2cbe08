"""Conversation repair against every sequence of edits of small conversations, and the defined cases."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def every_repair(rows):
    """(cost, audit, repaired text) of the best of all edits; ``rows``: (role, text, must go, truncated)."""
    best = None
    choices = [[(i, e) for i in ("", "I", "II") for e in ("D" if gone else "DKR")] for _, _, gone, _ in rows]
    for way in itertools.product(*choices, ("", "I", "II")):
        inserts = [step[0] for step in way[:-1]] + [way[-1]]
        cost, audit = 5 * len("".join(inserts)), "".join(i + e for i, e in way[:-1]) + way[-1]
        out = []
        for (before, edit), (role, text, _, cut) in zip(way[:-1], rows):
            out += [("?", "")] * len(before)
            cost += {"D": 2, "R": 1, "K": 0}[edit] + (5 if cut and edit != "D" else 0)
            out += [] if edit == "D" else [(role if edit == "K" else "?", text)]
        out += [("?", "")] * len(way[-1])
        if best is not None and (cost, audit) >= best[:2]:
            continue
        system = bool(out) and out[0][0][:1] == "s"
        wanted = ["s"] * system + ["u" if place % 2 == 0 else "a" for place in range(len(out) - system)]
        named = [(role if role != "?" else {"u": "user", "a": "assistant"}.get(w, ""), text) for (role, text), w in zip(out, wanted)]
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in named)):
            best = cost, audit, "\n".join(f"{role}:{text}" for role, text in named)
    return best


def repair(rows, block):
    made = C.Repair()
    for start in range(0, len(rows) - len(rows) % block, block):
        made.block(rows[start : start + block])
    return made.finish(rows[len(rows) - len(rows) % block :])


def test_every_edit_of_small_conversations():
    pick = random.Random(3)
    for _ in range(100):
        rows = [
            (pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), f"t{place}", pick.random() < 0.15, pick.random() < 0.2)
            for place in range(pick.randrange(5))
        ]
        cost, audit, text = every_repair(rows)
        want = cost, audit, hashlib.sha256(text.encode()).hexdigest()
        for block in (1, 2, 100):
            assert repair(rows, block) == want, rows


def test_blocks_agree_on_long_conversations():
    pick = random.Random(4)
    for size in (50, 700):
        rows = [(pick.choice(["system", "user", "assistant"]), f"t{place}", pick.random() < 0.1, pick.random() < 0.1) for place in range(size)]
        whole = repair(rows, 10_000)
        assert repair(rows, 7) == whole and repair(rows, C.BLOCK) == whole
        assert len(whole[1]) >= size


def expected(rows):
    """The contract, row by row."""
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
        turns, faults, seen = [row[0] for row in kept if row[0] is not None], [], set()
        for _, role, text in kept:
            ink = text.rstrip(WHITE)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, text = every_repair([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(kept, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(name) for name in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({name: F.lit(1) for name in ("_conv", "_again", "_gone", "gaps", "audit")})


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    found = {row["conv_id"]: tuple(row[name] for name in names) for row in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table_against_brute_force(spark, documents):
    pick = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for place in range(pick.randrange(1, 5)):
            turn = pick.choice([place, place, place + 2, None, 1])
            text = pick.choice([None, "", " \t", "One. Two!", "cut off", "yes?", "same.", "x" * 5000 + "."])
            rows.append((conv, turn, pick.choice(["user", "assistant", "system", None, "User", ""]), text))
    rows += rows[:20]
    rows.append((99, next(t for t in range(1000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0), "user", "gone."))
    found, want = result(C.repaired_conversations(table(spark, rows))), expected(rows)
    assert found == want
    assert found[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_one_conversation_of_all_rows(spark, documents):
    assert C.repaired_conversations(table(spark, [])).collect() == []
    rows = [(1, turn, ("user", "assistant")[turn % 2], f"text {turn}.") for turn in range(3000)]
    found = result(C.repaired_conversations(table(spark, rows)))[1]
    assert len(found[6]) >= 2700 and found[5] > 0
