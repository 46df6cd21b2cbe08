import pytest
from pyspark.sql import functions as F

from passagemill.operators import answers as A
from passagemill.plans.answering import answer_passages

PASSAGE = (
    "query_id int, pos int, chunk_id string, document_id string, title string, source_path string, breadcrumb string, "
    "content string, score double, vector_rank int, keyword_rank int"
)


def passages(spark, contents, query_id=1, score=0.0328):
    rows = [
        (query_id, n, f"c{n}", f"d{n}", f"Title {n}", f"doc-{n}.md", f"Title {n} > Part", content, score, n, n)
        for n, content in enumerate(contents, 1)
    ]
    return spark.createDataFrame(rows, PASSAGE)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, question string")


def test_floor(spark):
    assert A.minimum_fused_score() == pytest.approx(1 / 61 + 1 / 80)
    asked = questions(spark, "a", "b", "c")
    hits = passages(spark, ["x"]).unionByName(passages(spark, ["x"], 2, 1 / 61))
    got = {r.query_id: r.abstain_reason for r in A.score_floor(asked, hits).collect()}
    assert got == {1: None, 2: "NO_RELEVANT_CONTEXT", 3: "NO_RELEVANT_CONTEXT"}


def test_suppression_keeps_the_first_and_compares_with_kept_only(spark):
    base = [f"word{n}" for n in range(10)]
    contents = [
        " ".join(base),
        " ".join(base[:8] + ["new1", "new2"]),  # repeats the first
        " ".join(base[4:8] + ["new1", "new2", "more1", "more2"]),  # repeats only the dropped one
        "an it", "an it",  # without counted words nothing repeats
    ]
    rows = A.near_duplicate_suppression(passages(spark, contents)).orderBy("pos").collect()
    assert [(r.chunk_id, r.source_no) for r in rows] == [("c1", 1), ("c3", 2), ("c4", 3), ("c5", 4)]


def test_citations(spark):
    texts = [
        "The bound is 5 [1] and inline [2].", "Known [1] but made up [7].", "Ships inline [9].", "One [2]. Two [2].",
        "Both [1][3].", "Later [3], then [1].", "Zero [0] is none.", "No marker.", "Same [01] and [1].",
        "Kept  spaces [1234] .", "Gone [5] [1]  and [4] , [4][5]  ",
    ]
    given = spark.createDataFrame([(n + 1, t) for n, t in enumerate(texts)], "query_id int, answer string")
    sources = passages(spark, ["a", "b", "c"]).withColumn("source_no", F.col("pos")).drop("query_id")
    sources = given.select("query_id").join(sources)
    rows = A.validate_citations(given, sources).orderBy("query_id").collect()
    cited = [[c.marker for c in r.citations] for r in rows]
    assert cited == [[1, 2], [1], [], [2], [1, 3], [3, 1], [], [], [1], [], [1]]
    assert [r.dropped_markers for r in rows] == [[], [7], [9], [], [], [], [0], [], [], [], [4, 5]]
    assert rows[0].citations[0].source_path == "doc-1.md" and rows[0].citations[0].source_index == 0
    assert rows[1].text == "Known [1] but made up." and rows[2].text == "Ships inline."
    assert rows[9].text == "Kept  spaces [1234] ." and rows[10].text == "Gone [1] and,"
    none = A.validate_citations(given.limit(1), sources.limit(0)).first()
    assert none.citations == [] and none.dropped_markers == [1, 2]


def test_refusals(spark):
    texts = ["NO_ANSWER", " **no_answer**. \n", "```text\nNO_ANSWER\n```", "`NO ANSWER`", "I say NO_ANSWER here", "NO_ANSWERS", ""]
    df = spark.createDataFrame([(t,) for t in texts], "answer string")
    assert [r.declined for r in A.detect_abstention(df).collect()] == [True, True, True, True, False, False, False]


def test_extracts(spark):
    asked = questions(spark, "How large may a playable banner file become?", "unrelated query words")
    hits = passages(spark, [
        "- A playable banner file may reach five megabytes. Short. Banner texts differ.\nThe playable banner FILE is large.",
        "The playable banner file is large!\nAnother file sentence with banner inside it.",
    ])
    sources = hits.withColumn("source_no", F.col("pos"))
    got = {r.query_id: r.answer for r in A.extractive_answers(asked, sources).collect()}
    assert got[1] == (
        # A word keeps its final dot, so the copy in the second source scores higher.
        "A playable banner file may reach five megabytes. [1] The playable banner file is large! [2] "
        "Another file sentence with banner inside it. [2]"
    )
    assert got[2] == "NO_ANSWER"


def test_prompts(spark):
    sources = passages(spark, ["First.", "Second."]).withColumn("source_no", F.col("pos"))
    row = A.prompt_table(questions(spark, "Why?"), sources).first()
    assert row.user_prompt == (
        "SOURCES\n[1] Title 1 > Part\nFirst.\n\n---\n\n[2] Title 2 > Part\nSecond.\n\nQUESTION\nWhy?"
    )
    assert "NO_ANSWER" in row.system_prompt


def test_markers_follow_the_reduced_sources(spark):
    first = "Turning the device during the popup moved the retry button away."
    hits = passages(spark, [first, first + " ", "Korean lines broke inside words on the last card."])
    model = spark.createDataFrame([(1, " Lines were fixed [2] and [9]. ")], "query_id int, answer string")
    row = answer_passages(questions(spark, "What was fixed?"), hits, model).first()
    assert row.answered and row.answer_mode == "model" and row.text == "Lines were fixed [2] and."
    assert [s.source_path for s in row.sources] == ["doc-1.md", "doc-3.md"]
    assert [(c.marker, c.source_path) for c in row.citations] == [(2, "doc-3.md")] and row.dropped_markers == [9]


def test_abstentions_have_no_citations(spark):
    asked = questions(spark, "floor", "declined", "no hits")
    hits = passages(spark, ["some text"], 1, 1 / 61).unionByName(passages(spark, ["other text"], 2))
    model = spark.createDataFrame([(1, "Wrong [1]."), (2, "NO_ANSWER")], "query_id int, answer string")
    got = {r.query_id: r for r in answer_passages(asked, hits, model).collect()}
    assert [got[n].abstain_reason for n in (1, 2, 3)] == ["NO_RELEVANT_CONTEXT", "MODEL_DECLINED", "NO_RELEVANT_CONTEXT"]
    assert all(not r.answered and r.citations == [] and r.dropped_markers == [] for r in got.values())
    assert [s.chunk_id for s in got[1].sources] == ["c1"] and got[3].sources is None


def test_a_missing_model_answer_is_not_answered(spark):
    hits = passages(spark, ["x"]).unionByName(passages(spark, ["x"], 2))
    model = spark.createDataFrame([(1, "yes [1]")], "query_id int, answer string")
    got = {r.query_id: (r.answered, r.abstain_reason) for r in answer_passages(questions(spark, "a", "b"), hits, model).collect()}
    assert got == {1: (True, None), 2: (False, "NO_MODEL_ANSWER")}


def test_only_markers_of_up_to_three_digits_are_stripped(spark):
    answers = spark.createDataFrame([(1, "a [12] b [012] c [0012] d [1]")], "query_id int, answer string")
    row = A.validate_citations(answers, passages(spark, ["x"]).withColumn("source_no", F.col("pos"))).first()
    assert row.text == "a b c [0012] d [1]" and row.dropped_markers == [12]
