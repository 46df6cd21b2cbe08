"""The pipeline's stages against brute force, each on what the one before it kept."""

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as registered
from tests.llm.test_kernels import WORD
from tests.llm.test_near_copies import firsts
from tests.llm.test_operators import tongue


def small_corpus():
    pick = random.Random(11)
    rows = []
    for i in range(80):
        lang = pick.choice(["xx", "yy"])
        text = "\n".join(tongue(pick, lang, pick.randint(4, 12)) for _ in range(pick.randint(1, 12)))
        if i % 7 == 3:
            text = text + "\n" + "\n".join(rows[i - 1][1].split("\n")[:4])
        if i % 11 == 5:
            text = rows[i - 2][1].replace(" ", "  ").upper()
        if i % 13 == 6:
            text = text + " " + " ".join(rows[i - 3][1].split()[3:40])
        rows.append((i, text, lang, f"src{i % 3}"))
    return rows + [(200, None, "xx", "src0"), (201, "", "yy", None), (202, "12 34", None, "src1"), rows[4]]


def without_windows(rows, units, length, rebuild):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows)):
        own = units(text)
        gone = set()
        for at in range(len(own) - length + 1):
            window = tuple(own[at : at + length])
            if window in seen:
                gone.update(range(at, at + length))
            seen.add(window)
        if not own or len(gone) < len(own):
            out[doc_id] = rebuild([x for i, x in enumerate(own) if i not in gone])
    return out


def test_stages(spark, documents, tmp_path):
    documents(small_corpus(), ("kept", "_id")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, held = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["language_id", "line_dedup", "near_copies", "substring_dedup", "packing"]
    for name, stage in stages.items():
        before = [(r.doc_id, r.text) for r in docs.collect()]
        result = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert result.columns == docs.columns
        path = f"{tmp_path}/{name}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = (before, docs.collect())

    before, after = held["language_id"]
    assert Counter(r.doc_id for r in after) == Counter(i for i, _ in before if i < 200)
    before, after = held["line_dedup"]
    want = without_windows(before, lambda t: [x for x in t.split("\n") if WORD.search(x)], 3, "\n".join)
    assert {r.doc_id: r.text.rstrip("\n") for r in after} == want and all(len(r.text) == r.n_chars for r in after)
    before, after = held["near_copies"]
    assert {r.doc_id for r in after} == firsts(sorted(set(before))) and len(after) < len(before)
    before, after = held["substring_dedup"]
    want = without_windows(before, WORD.findall, 20, " ".join)
    assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in after} == want
    before, after = held["packing"]
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((i, len(WORD.findall(t))) for i, t in before)
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, after))


def test_every_operator_is_registered():
    names = registered.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names
