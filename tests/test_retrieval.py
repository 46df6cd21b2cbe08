import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import text
from passagemill.operators import duplicates, embed, evaluate, fusion, keyword, vector
from passagemill.plans import retrieval


def test_terms(spark):
    cases = {
        "Which Words MUST Ship": ["which", "words", "must", "ship"],
        "kit.track low-light loop_end 4.5": ["kit.track", "low-light", "loop_end", "4.5"],
        "What is it? (really)": ["what", "is", "it", "really"],
        "sound and film not pictures or noise": ["sound", "film", "pictures", "noise"],
        "??? --- ...": [],
        "Über-Größe, naïve": ["über-größe", "naïve"],
    }
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    rows = df.select("question", text.split_terms(F.col("question")).alias("t"), text.keyword_query(F.col("question")).alias("k")).collect()
    assert {r.question: r.t for r in rows} == cases
    assert all(r.k == " or ".join(r.t) for r in rows)


def test_rewrite_drops_majority_terms_only(spark):
    cases = [
        ("low light rule in weekly reports", 100, {"low": 5, "light": 23, "weekly": 89, "reports": 56}, "low light rule in", ["reports", "weekly"]),
        ("What is the rule?", 100, {"rule": 1}, "What is the rule?", []),
        ("sound path", 100, {"sound": 50, "path": 4}, "sound path", []),
        ("weekly reports", 100, {"weekly": 89, "reports": 56}, "weekly reports", []),
        ("anything", 0, {"anything": 0}, "anything", []),
        ("low-light button in reports", 100, {"low-light": 8, "reports": 56}, "low-light button in", ["reports"]),
        ("Why does THE Button show up in weekly reports, and what now?", 100, {"button": 62, "weekly": 89, "reports": 56},
         "Why does THE show up in, and what now?", ["button", "reports", "weekly"]),
        ("see reports/summary (reports) now", 10, {"reports": 9, "summary": 1}, "see () now", ["reports"]),
    ]
    questions = spark.createDataFrame([(n, case[0]) for n, case in enumerate(cases)], "query_id int, question string")
    counts = spark.createDataFrame(
        [(n, term, k, case[1]) for n, case in enumerate(cases) for term, k in case[2].items()],
        "query_id int, term string, documents bigint, total_documents bigint",
    )
    got = keyword.rewrite_query(questions, counts).orderBy("query_id").collect()
    assert [(r.vector_text, r.dropped_terms) for r in got] == [case[3:] for case in cases]


def arm(spark, ids):
    rows = [(1, name, place) for place, name in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")


def fuse(spark, vector_ids, keyword_ids):
    rows = fusion.rrf_fusion(arm(spark, vector_ids), arm(spark, keyword_ids)).orderBy("pos").collect()
    return [(r.chunk_id, r.score, r.vector_rank, r.keyword_rank) for r in rows]


def test_fusion_scores_ties_and_repeats(spark):
    got = fuse(spark, ["a", "x", "b"], ["y", "z", "b"])
    assert got[0][0] == "b" and got[0][1] == pytest.approx(2 / 63)
    assert [row[0] for row in got] == ["b", "a", "y", "x", "z"]
    assert fuse(spark, ["a", "a", "a"], []) == [("a", pytest.approx(1 / 61), 1, None)]
    assert fuse(spark, [], []) == []


def test_vector_search_both_ways_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    chunk_vectors = rng.integers(-3, 4, size=(300, 8)).astype(float)
    chunk_vectors[7] = 0
    chunk_vectors[100:200] = chunk_vectors[3]  # a third of all rows are copies
    questions = rng.integers(-3, 4, size=(40, 8)).astype(float)
    questions[5] = 0
    kinds = [random.Random(3 * n).choice(["x", "y"]) for n in range(300)]
    chunks = spark.createDataFrame(
        [(f"c{n:03d}", None if n == 9 else v.tolist(), kinds[n]) for n, v in enumerate(chunk_vectors)],
        "chunk_id string, embedding array<double>, doc_type string",
    ).repartition(5)
    asked = spark.createDataFrame(
        [(n, v.tolist(), "x" if n % 3 == 0 else None) for n, v in enumerate(questions)],
        "query_id int, embedding array<double>, doc_type string",
    )
    want = {}
    for n, question in enumerate(questions):
        if not question.any():
            continue
        scored = [
            (-round(float(v @ question / np.linalg.norm(v) / np.linalg.norm(question)), 9), f"c{m:03d}")
            for m, v in enumerate(chunk_vectors)
            if v.any() and m != 9 and (n % 3 or kinds[m] == "x")
        ]
        want[n] = [name for _, name in sorted(scored)[:20]]
    for options in ({}, {"broadcast_values": 0, "block_values": 80}):
        hits = vector.vector_topk(asked, chunks, 8, **options).collect()
        got = {}
        for row in sorted(hits, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(row.query_id, []).append(row.chunk_id)
        assert got == want


def test_cell_search_finds_most_neighbours(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(10, 16))
    points = [(n, (centres[n % 10] + 0.3 * rng.normal(size=16)).tolist()) for n in range(600)]
    chunks = spark.createDataFrame(points, "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame(points[:50], "query_id int, embedding array<double>")
    exact = vector.vector_topk(asked, chunks, 16)
    found = vector.vector_topk_ann(asked, chunks, 16, cells=16, probes=4)
    assert vector.recall_against(exact, found).first().recall >= 0.9


def make_index(spark, bodies, **options):
    corpus = spark.createDataFrame(list(bodies.items()), "source_path string, content string")
    return retrieval.build_index(corpus, **options)


def test_keyword_arm_ranks_by_covered_terms(spark):
    index = make_index(spark, {
        "a.md": "apple size limit", "b.md": "size chart", "c.md": "apple apple apple", "d.md": "nothing here",
    })
    asked = spark.createDataFrame([(1, "What is the apple size limit?"), (2, "the of and")], "query_id int, question string")
    for bound in (100, 0):
        found = keyword.keyword_topk(asked, index.terms, broadcast_rows=bound)
        hits = found.join(index.chunks, "chunk_id").orderBy("rank").collect()
        assert [r.source_path for r in hits] == ["a.md", "c.md", "b.md"]
        assert hits[0].raw_score == pytest.approx(3 * 0.1 / 1.64493406685 / 3, abs=1e-9)
        assert hits[1].raw_score == pytest.approx(0.1 * (1 + 1 / 4 + 1 / 9) / 1.64493406685 / 3, abs=1e-9)


def test_keyword_grid_moves_only_the_best(spark):
    """Many rows of the grid give the rows of the scan, and no row for each question and chunk is moved."""
    picker = random.Random(8)
    vocabulary = [f"word{n:02d}" for n in range(30)]
    words = lambda most: " ".join(picker.choices(vocabulary, k=picker.randint(1, most)))
    terms = make_index(spark, {f"{n}.md": words(30) for n in range(400)}).terms
    asked = spark.createDataFrame([(n, words(6)) for n in range(12)] + [(None, "word01")], "query_id int, question string")
    wanted = keyword.question_lexemes(asked)
    found = keyword.grid_scores(wanted, terms, 2, row_lexemes=10)
    cells = 13 * (1 + keyword.GRID_TASKS * spark.sparkContext.defaultParallelism)
    assert found.count() <= 2 * cells * 2 < wanted.count() * 400
    best = {tuple(r) for r in keyword.ranked(found, 2).collect()}
    assert best == {tuple(r) for r in keyword.keyword_topk(asked, terms, 2).collect()}
    twice = keyword.keyword_topk(asked, terms.unionAll(terms), 2, broadcast_rows=0)
    assert {(r.query_id, r.chunk_id): pytest.approx(2 * r.raw_score) for r in found.collect()}.items() >= {
        (r.query_id, r.chunk_id): r.raw_score for r in twice.collect()
    }.items()


def test_keyword_search_puts_chunks_without_an_id_first(spark):
    rows = [(name, "d", None, [("apple", 1, 0.1)]) for name in ("b", None, "a")]
    terms = spark.createDataFrame(rows, f"chunk_id string, document_id string, doc_type string, terms {keyword.TERMS_TYPE}").coalesce(1)
    asked = spark.createDataFrame([(1, "apple")], "query_id int, question string")
    for bound in (100, 0):
        found = keyword.keyword_topk(asked, terms, 2, broadcast_rows=bound).orderBy("rank").collect()
        assert [r.chunk_id for r in found] == [None, "a"]


def test_term_counts_are_by_document_and_stem(spark):
    from passagemill.functions import stem

    index = make_index(spark, {"a.md": "weekly reports", "b.md": "one report. report", "c.md": "other"}, stemmer=stem.english)
    asked = spark.createDataFrame([(1, "the reports unknown")], "query_id int, question string")
    rows = keyword.term_document_counts(asked, index.frequencies, index.documents, stem.english).collect()
    assert {r.term: (r.documents, r.total_documents) for r in rows} == {"reports": (2, 3), "unknown": (0, 3)}


def test_hybrid_search_gives_the_arms_different_texts(spark):
    bodies = {f"logs/{n}.md": f"weekly report number {n} about topic{n}" for n in range(8)}
    bodies["rule.md"] = "contrast rule for buttons"
    index = make_index(spark, bodies)
    asked = spark.createDataFrame([(1, "contrast rule in weekly report", 2)], "query_id int, question string, top_k int")
    rewritten = retrieval.rewritten_questions(asked, index).first()
    assert rewritten.vector_text == "contrast rule in" and rewritten.dropped_terms == ["report", "weekly"]
    hits = retrieval.hybrid_search(asked, index).orderBy("pos").collect()
    assert len(hits) == 2 and hits[0].source_path == "rule.md" and hits[0].vector_rank == 1


def test_request_bounds(spark):
    df = spark.createDataFrame(
        [("  fine ", None), ("", 3), ("   ", 3), ("x" * 501, 3), ("ok", 0), ("ok", 21), (None, 1), ("x" * 500, 20)],
        "question string, top_k int",
    )
    good = fusion.accepted(df).collect()
    assert [(r.question[:4], r.top_k) for r in good] == [("fine", 6), ("xxxx", 20)]
    assert fusion.rejected(df).count() == 6


def test_marks(spark):
    df = spark.createDataFrame(
        [
            ("report low-light", "Reports: low-light, ruler. reporting; low-lights preport"),
            ("the cta", "the cta"),
            ("a.b+c4 wide", "a.b+c4 awide wides"),
        ],
        "question string, content string",
    )
    got = fusion.explain_matches(df).collect()
    assert got[0].marked == "<mark>Reports</mark>: <mark>low-light</mark>, ruler. <mark>reporting</mark>; <mark>low-lights</mark> preport"
    assert (got[1].marks, got[1].semantic_only) == (0, True)
    assert got[2].marks == 1 and "<mark>wides</mark>" in got[2].marked


@pytest.mark.parametrize("sent", [0, duplicates.BROADCAST_POSTINGS])
def test_corpus_near_duplicates_match_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(duplicates, "BROADCAST_POSTINGS", sent)
    picker = random.Random(4)
    vocabulary = [f"word{n:03d}" for n in range(60)]
    docs = []
    template = picker.sample(vocabulary, 20)
    for n in range(90):
        if n % 3 == 0:  # a third of all documents are near copies of one text
            words = template[: picker.randint(17, 20)] + picker.sample(vocabulary, 2)
        elif n % 10 == 1:
            words = picker.sample(vocabulary[:6], 2)
        else:
            words = picker.sample(vocabulary, picker.randint(3, 15))
        docs.append((" ".join(words),))
    docs += [("",), ("a an",), docs[0], docs[0]]
    df = spark.createDataFrame([(n, *d) for n, d in enumerate(docs)], "n int, content string").select(
        F.sha2(F.col("n").cast("string"), 256).alias("document_id"), "content"
    )
    rows = sorted((r.document_id, {w for w in r.content.split() if len(w) > 2}) for r in df.collect())
    want = {}
    for place, (name, words) in enumerate(rows):
        earlier = [
            other for other, mine in rows[:place]
            if mine and words and len(mine & words) / min(len(mine), len(words)) >= 0.8
        ]
        want[name] = earlier[0] if earlier else None
    got = {r.document_id: r.repeat_of for r in duplicates.corpus_near_duplicates(df, growth=4).collect()}
    assert got == want


@pytest.mark.parametrize("sent", [0, 40])
def test_duplicates_found_in_slices_of_the_words(spark, monkeypatch, sent):
    """The pairs of a round are written slice by slice, so no join moves the postings of all words."""
    monkeypatch.setattr(duplicates, "BROADCAST_POSTINGS", sent)
    monkeypatch.setattr(duplicates, "SLICE_POSTINGS", 150)
    monkeypatch.setattr(duplicates, "SENT_WORDS", 100)
    calls = []
    real = duplicates.candidates
    monkeypatch.setattr(duplicates, "candidates", lambda *a, **b: calls.append(b) or real(*a, **b))
    picker = random.Random(5)
    vocabulary = [f"word{n:03d}" for n in range(50)]
    texts = [picker.sample(vocabulary, picker.randint(2, 15)) for _ in range(60)]
    df = spark.createDataFrame([(f"{n * 68:04x}", " ".join(words)) for n, words in enumerate(texts)], "document_id string, content string")
    want = {}
    for n, words in enumerate(map(set, texts)):
        earlier = [m for m in range(n) if len(words & set(texts[m])) >= 0.8 * min(len(words), len(texts[m]))]
        want[f"{n * 68:04x}"] = f"{earlier[0] * 68:04x}" if earlier else None
    assert {r.document_id: r.repeat_of for r in duplicates.corpus_near_duplicates(df, growth=16).collect()} == want
    assert len(calls) > 4


def test_bounds_leave_few_candidates(spark):
    """Sets that share many words but no near copy: the bounds of the join leave next to none of the pairs that meet."""
    picker = random.Random(7)
    vocabulary = [f"word{n:04d}" for n in range(1500)]
    docs = spark.createDataFrame(
        [(f"{n:04x}", " ".join(picker.sample(vocabulary, picker.randint(60, 400)))) for n in range(300)], "document_id string, content string"
    )
    sets = duplicates.shared_words(duplicates.word_sets(docs).drop("signature"), 0.8)
    flagged = sets.withColumn("leads", F.lit(True)).withColumn("open", F.lit(True))
    assert duplicates.candidates(flagged, flagged).count() < 20


def test_metrics(spark):
    suite = spark.createDataFrame(
        [(1, "answerable", "q", ["a", "b"]), (2, "answerable", "q", ["c"]), (3, "answerable", "q", [])],
        "query_id int, type string, question string, expected array<string>",
    )
    hits = spark.createDataFrame(
        [("hybrid", 1, 1, "x"), ("hybrid", 1, 2, "a"), ("hybrid", 1, 3, "a"), ("hybrid", 1, 4, "b"), ("hybrid", 2, 1, "z"), ("vector", 2, 1, "c")],
        "mode string, query_id int, pos int, source_path string",
    )
    outcomes = evaluate.query_outcomes(suite, hits)
    got = {r["mode"]: (r.recall, r.mrr, r.full_hit_rate, r.queries) for r in evaluate.compare_modes(outcomes).collect()}
    assert got["hybrid"] == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(0.5 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 3)
    assert got["vector"] == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 3)
    nothing = evaluate.query_outcomes(suite.where("query_id = 3"), hits)
    assert all(r.recall is None for r in evaluate.recall_at_k(nothing).collect())


def test_modes_without_a_hit_are_judged(spark):
    suite = spark.createDataFrame([(1, "answerable", "q", ["a"])], "query_id int, type string, question string, expected array<string>")
    hits = spark.createDataFrame([("hybrid", 1, 1, "a")], "mode string, query_id int, pos int, source_path string")
    outcomes = evaluate.query_outcomes(suite, hits, ("hybrid", "vector"))
    assert {r["mode"]: (r.recall, r.mrr) for r in evaluate.compare_modes(outcomes).collect()} == {"hybrid": (1.0, 1.0), "vector": (0.0, 0.0)}


def test_white_space_of_any_kind_is_trimmed(spark):
    asked = spark.createDataFrame([("\t\n",), ("  a b ",), (" x ",)], "question string").withColumn("top_k", F.lit(3))
    got = [(r.question, r.problem) for r in fusion.top_k_bounds(asked).collect()]
    assert got == [("", "question is empty"), ("a b", None), ("x", None)]
    assert spark.range(1).select(text.token_count(F.lit("a b c"))).first()[0] == 3


def test_long_texts_keep_their_vector(spark):
    corpus = spark.createDataFrame([("long.md", "word " * 20_000, "h"), ("short.md", "word", "g")], "source_path string, content string, content_hash string")
    index = retrieval.build_index(corpus, 16, whole_texts=True)
    assert index.chunks.where("embedding is null").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_containing_documents(spark, seed):
    from passagemill.sources.eval_suite import containing_documents

    pick = random.Random(seed)
    texts = ["".join(pick.choice(["a", "b", "é", " ", "\n", "word ", "."]) for _ in range(pick.randint(0, 60))) for _ in range(40)]
    items = [(i, t[a : a + pick.randint(0, 12)]) for i, t in enumerate(texts * 2) for a in [pick.randint(0, max(len(t) - 1, 0))]]
    items += [(900, "a"), (901, "zz"), (902, "b\n")]
    corpus = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_path string, content string")
    got = containing_documents(spark.createDataFrame(items, "query_id int, question string"), corpus).collect()
    want = sorted((i, f"d{n}") for i, q in items if q for n, t in enumerate(texts) if q in t)
    assert sorted(map(tuple, got)) == want


def letters(texts):
    """A provider of its own: how often a text has each of eight letters."""
    return [[float(value.lower().count(letter)) for letter in "abcdefgh"] for value in texts]


def test_questions_are_embedded_by_the_provider_of_the_index(spark):
    files = {"a.md": "zzz a a a", "b.md": "zzz b b b", "c.md": "zzz c c c"}
    corpus = spark.createDataFrame(list(files.items()), "source_path string, content string")
    provider = embed.Provider(letters, 8, name="letters")
    index = retrieval.build_index(corpus, whole_texts=True, provider=provider)
    asked = spark.createDataFrame([(1, "bbb bbb"), (2, "ccc")], "query_id int, question string")
    hits = retrieval.vector_arm(retrieval.rewritten_questions(asked, index), index)
    best = hits.where("rank = 1").join(index.chunks, "chunk_id").collect()
    assert index.dimensions == 8 and {r.query_id: r.source_path for r in best} == {1: "b.md", 2: "c.md"}
    narrow = embed.Provider(lambda texts: [[1.0] for _ in texts], 8)
    with pytest.raises(Exception, match="8 dimensions"):
        retrieval.build_index(corpus, whole_texts=True, provider=narrow)


def test_a_log_with_times_can_be_read_by_the_statistics(spark, tmp_path):
    from passagemill.operators import stats
    from passagemill.sources import query_log

    asked = spark.createDataFrame([(1, "one", "u1"), (2, "two", None)], "query_id int, question string, user_id string")
    passages = spark.createDataFrame([(1, 1, "x", 0.5)], "query_id int, pos int, chunk_id string, score double")
    now = F.lit("2024-01-01").cast("timestamp")
    rows = query_log.search_log(asked, passages, now, 6, {"embed_ms": F.lit(3), "retrieve_ms": F.lit(4)})
    query_log.append_query_log(rows, str(tmp_path), "1")
    log = spark.read.schema(rows.schema).parquet(str(tmp_path))
    assert {(r.user_id, r.embed_ms, r.generate_ms, r.total_ms) for r in log.collect()} == {("u1", 3, None, 7), (None, 3, None, 7)}
    found = stats.query_stats(log, now).first()
    assert (found.total, found.p50_total_ms, found.zero_result_count) == (2, 7, 1)
    split = stats.latency_split(log).first()
    assert split.retrieve_p50 == 4 and split.generate_p50 is None
    unmeasured = query_log.search_log(asked.drop("user_id"), passages, now, 6).first()
    assert unmeasured.total_ms is None and unmeasured.user_id is None


def grid_tables(spark):
    rng = np.random.default_rng(23)
    vectors = rng.normal(size=(400, 8))
    vectors[100:200] = vectors[7]  # more copies than hits, so ids decide
    chunks = spark.createDataFrame(
        [(None if n == 399 else n, v.tolist()) for n, v in enumerate(vectors)], "chunk_id bigint, embedding array<double>"
    )
    asked = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors[:60])], "query_id bigint, embedding array<double>")
    return vectors, chunks, asked


def test_grid_copies_no_chunk_for_a_block_of_questions(spark):
    vectors, chunks, asked = grid_tables(spark)
    want = {}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for n in range(60):
        scores = np.round(unit @ unit[n], 9)
        order = sorted(range(400), key=lambda m: (-scores[m], -1 if m == 399 else m))[:20]
        want[n] = [None if m == 399 else m for m in order]
    for row_values, copies in ((vector.ROW_VALUES, 1), (20 * 8, 3)):
        hits = vector.vector_topk(asked, chunks, 8, broadcast_values=0, block_values=8, row_values=row_values).collect()
        got = {}
        for row in sorted(hits, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(row.query_id, []).append(row.chunk_id)
        assert got == want
        questions, offered = vector.prepared_questions(asked), vector.prepared_chunks(chunks, "chunk_id")
        result = T.StructType([questions.schema["query_id"], offered.schema["chunk_id"]])
        dealt = vector.grid_rows(questions, offered, result, row_values // 8)
        assert dealt.where("kind = 1").count() == 400 * copies


def test_vectors_without_a_direction_hide_no_others(spark):
    chunks = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [float("nan"), 1.0]), (4, [0.5, 0.5])], "chunk_id int, embedding array<double>"
    ).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0])], "query_id int, embedding array<double>")
    for options in ({}, {"broadcast_values": 0}):
        hits = vector.vector_topk(asked, chunks, 2, **options).collect()
        assert [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(1, 1, 1), (1, 4, 2)]


def test_pairs_are_compared_without_a_row_for_each(spark, monkeypatch):
    """The lowest overlapping leader of each document, whatever number of leaders is met at once; no join of pairs with words."""
    monkeypatch.setattr(duplicates, "MET_LEADERS", 3)
    picker = random.Random(8)
    sets = [(n, picker.sample(range(-40, 40), picker.randint(1, 20))) for n in range(50)]
    pairs = [(n, m) for n in range(50) for m in range(n) if picker.random() < 0.7]
    entries = spark.createDataFrame([(n, len(words) + n % 2, words) for n, words in sets], "document_id long, n int, words array<long>")
    table = spark.createDataFrame(pairs, "document_id long, leader long")
    want = {}
    for n, m in pairs:
        common = len(set(sets[n][1]) & set(sets[m][1]))
        if common / min(len(sets[n][1]) + n % 2, len(sets[m][1]) + m % 2) >= 0.4:
            want[n] = min(m, want.get(n, m))
    found = duplicates.partners_below(table, entries, entries, 0.4)
    assert {r.document_id: r.repeat_of for r in found.collect()} == want and len(want) > 20
    lists = table.groupBy("document_id").agg(F.collect_set("leader").alias("leaders")).join(entries, "document_id")
    named = entries.select(F.col("document_id").alias("leader"), F.col("n").alias("leader_n"), F.col("words").alias("leader_words"))
    plan = duplicates.lowest_partners(lists, named, 0.4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert duplicates.lowest_partners(lists, named.limit(0), 0.4).count() == 0


@pytest.mark.parametrize("broadcast_values", [0, vector.BROADCAST_VALUES])
def test_chunks_without_an_id_are_found_by_vector(spark, broadcast_values):
    chunks = spark.createDataFrame(
        [(None, [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [0.0, 1.0])], "chunk_id string, embedding array<double>"
    ).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    found = vector.vector_topk(asked, chunks, 2, broadcast_values=broadcast_values).orderBy("rank").collect()
    assert [(r.chunk_id, r.raw_score) for r in found] == [(None, 1.0), ("a", 1.0), ("b", 1.0), (None, 0.0)]
