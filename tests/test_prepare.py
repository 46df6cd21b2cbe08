import re

from pyspark.sql import functions as F

from passagemill.functions import markdown as M
from passagemill.functions import text
from passagemill.functions.stem import english_stem
from passagemill.operators import changes, embed, prepare


def sections(body):
    return M.read_sections(body)


def chunk(body, **limits):
    title, found = M.read_sections(body)
    pieces = M.chunk_pieces(found, 0, M.ChunkLimits(**limits), M.whitespace_tokens)
    return title, pieces


def test_title_leaves_the_path():
    title, found = sections("# Guide\n\nOpening.\n\n## Setup\n\nSteps.\n\n### Tools\n\nHammer.\n\n## End\n\nBye.")
    assert title == "Guide"
    assert found == [([], "Opening."), (["Setup"], "Steps."), (["Setup", "Tools"], "Hammer."), (["End"], "Bye.")]


def test_fences_hide_headings_and_close_with_their_own_mark():
    _, found = sections("# T\n\n~~~\n```\n## hidden\n~~~\n\n## Shown\n\n```sh\n# comment\n```\n")
    assert [path for path, _ in found] == [[], ["Shown"]]
    assert "## hidden" in found[0][1] and "# comment" in found[1][1]


def test_second_title_is_a_section_and_empty_sections_vanish():
    title, found = sections("# One\n\n## Empty\n\n# Two #\r\n\r\nBody.\n   \n")
    assert title == "One" and found == [(["Two"], "Body.")]
    assert sections("") == (None, [])
    assert sections("    - indented bullet") == (None, [([], "    - indented bullet")])


def test_short_documents_become_one_chunk_with_their_headings():
    _, pieces = chunk("# R\n\nIntro.\n\n## Tests\n\n### Sound\n\nLoud.\n\n## Close\n\nSigned.")
    assert [piece.content for piece in pieces] == ["Intro.\n\n## Tests\n\n### Sound\n\nLoud.\n\n## Close\n\nSigned."]
    assert pieces[0].path == []


def test_shared_heading_moves_to_the_path():
    _, pieces = chunk("# R\n\n## Tests\n\nA.\n\n### Sound\n\nB.")
    assert pieces[0].path == ["Tests"] and pieces[0].content == "A.\n\n### Sound\n\nB."


def test_long_sections_split_between_sentences_with_overlap():
    words = [f"Step {n} goes here now." for n in range(12)]
    _, pieces = chunk("# L\n\n## B\n\n" + " ".join(words), budget=20, overlap=5, minimum=0)
    assert len(pieces) > 1
    for before, after in zip(pieces, pieces[1:]):
        assert after.content.startswith(re.split(r"(?<=\.)\s+", before.content)[-1])
    _, pieces = chunk("# L\n\n## B\n\n" + " ".join(words), budget=20, overlap=0, minimum=0)
    assert [piece.tokens for piece in pieces] == [20, 20, 20]
    assert " ".join(re.sub(r"\s+", " ", piece.content) for piece in pieces) == " ".join(words)


def test_a_fence_is_one_unit():
    fence = "```py\na = 1\nb = 2\n```"
    filler = " ".join(["pad"] * 30)
    _, pieces = chunk(f"# C\n\n## E\n\n{filler}\n\n{fence}\n\n{filler}", budget=40, overlap=0, minimum=0)
    assert sum("```py" in piece.content and "b = 2\n```" in piece.content for piece in pieces) == 1


def test_small_pieces_are_absorbed_backwards_then_forwards():
    long = " ".join(["word"] * 30)
    _, pieces = chunk(f"# C\n\n## R\n\n{long}\n\n## N\n\nTiny.", budget=35, overlap=0, minimum=10)
    assert len(pieces) == 1 and "## N\n\nTiny." in pieces[0].content
    _, pieces = chunk(f"# C\n\n## N\n\nTiny.\n\n## R\n\n{long}\n\n## S\n\n{long}", budget=31, overlap=0, minimum=10)
    assert len(pieces) == 2 and pieces[0].content.startswith("## N\n\nTiny.\n\n## R")


def test_an_oversize_sentence_stays_whole():
    _, pieces = chunk("# C\n\n" + " ".join(["w"] * 50) + ".", budget=20, overlap=5, minimum=0)
    assert len(pieces) == 1 and pieces[0].tokens == 50


def test_path_rules(spark):
    cases = {
        "reports/2025-05-blue-cake.md": ("report", "2025-05", "blue-cake"),
        "notes/2025-03-03-weekly.md": ("note", "2025-03-03", "weekly"),
        "kit-v3.md": (None, None, "kit-v3"),
        "logs/tool-4.2.md": ("log", None, "tool-4.2"),
        "notes/2025-03-03.md": ("note", "2025-03-03", "2025-03-03"),
        "a/b/2024-01_x.markdown": ("b", "2024-01", "x"),
        "a/2024-011.md": ("a", None, "2024-011"),
    }
    df = spark.createDataFrame([(path,) for path in cases], "source_path string")
    got = {r.source_path: (r.doc_type, r.date_text, r.subject) for r in prepare.path_metadata(df).collect()}
    assert got == cases


def test_attributes_and_dates(spark):
    rows = [
        ("tool-4.2", "2025-05", "\n\nStatus: Deprecated since June\nx", "4.2", "deprecated", "2025-05-01"),
        ("kit-V3", "2025-05-09", "one\ntwo\nCURRENT kit", "3", "current", "2025-05-09"),
        ("plain", None, "a\nb\nc\nsuperseded", None, None, None),
        ("x-2", "2025-13", "superseded and current", None, "deprecated", None),
    ]
    df = spark.createDataFrame([row[:3] for row in rows], "subject string, date_text string, body string")
    got = prepare.doc_date(prepare.document_attributes(df)).collect()
    assert [(r.version, r.lifecycle, r.doc_date and str(r.doc_date)) for r in got] == [row[3:] for row in rows]


def test_front_matter(spark):
    cases = [
        ("---\nby: Ana\ntitle: \"In Quotes\"\n---\n# D\n\nB.", {"by": "Ana", "title": "In Quotes"}, "# D\n\nB.", []),
        ("# D\n\nB with --- inside.", {}, "# D\n\nB with --- inside.", []),
        ("---\nby: Ana\n# D", {}, "---\nby: Ana\n# D", []),
        ("---\nby: Ana\ntags:\n  - one\n---\nB.", {"by": "Ana", "tags": ""}, "B.", ["  - one"]),
        ("---\n---\nB.", {}, "B.", []),
        ("---  \r\nk: 'a'\r\nk: b:c\r\n# note\r\n\r\n--- \r\nB\r\nC", {"k": "b:c"}, "B\nC", []),
    ]
    df = spark.createDataFrame([(n, case[0]) for n, case in enumerate(cases)], "n int, content string")
    got = prepare.front_matter(df).orderBy("n").collect()
    assert [(r.content, r.metadata, r.body, r.unsupported_lines) for r in got] == cases


def test_chunk_rows_carry_breadcrumbs(spark):
    corpus = spark.createDataFrame(
        [
            ("reports/2025-05-blue-cake.md", "# Blue Cake\n\n## Sign-off\n\nSigned."),
            ("guides/naming.md", "No heading at all."),
            ("empty.md", ""),
        ],
        "source_path string, content string",
    )
    got = {r.source_path: r for r in prepare.chunk_corpus(corpus).collect()}
    assert set(got) == {"reports/2025-05-blue-cake.md", "guides/naming.md"}
    first = got["reports/2025-05-blue-cake.md"]
    assert first.breadcrumb == "Blue Cake [report · 2025-05 · blue-cake] > Sign-off"
    assert first.embedded_text == first.breadcrumb + "\n\nSigned." and first.token_count == 10
    assert got["guides/naming.md"].breadcrumb == "naming [guide · naming]"


def test_chunk_kernel_runs_once_per_document(spark):
    corpus = spark.createDataFrame([("a.md", "text")], "source_path string, content string")
    plan = prepare.chunk_corpus(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_redaction(spark):
    df = spark.createDataFrame([("key sk-or-v1***abcd and bearer abcdefghij, task-force sk-short",)], "content string")
    row = prepare.redact_secrets(df).first()
    assert row.content == "key sk-<redacted> and Bearer <redacted>, task-force sk-short" and row.secrets == 2


def test_requests_follow_the_caps(spark):
    assert list(embed.request_ranges([3, 3, 3], embed.Provider(list, 4, max_request_tokens=6))) == [(0, 2), (2, 3)]
    assert list(embed.request_ranges([1, 1, 1], embed.Provider(list, 4, max_batch_size=1))) == [(0, 1), (1, 2), (2, 3)]
    df = spark.createDataFrame([(1, "a b", 2), (2, "c", 1), (3, "a b c d", 4)], "id int, t string, token_count int")
    provider = embed.Provider(lambda texts: [[float(len(t))] for t in texts], 1, max_input_tokens=3)
    got = {r.id: r.embedding for r in embed.embed_with_provider(df, "t", provider).collect()}
    assert got == {1: [3.0], 2: [1.0], 3: None}


def test_hash_vectors_agree_and_empty_text_is_zero(spark):
    texts = ["Alpha beta, alpha!", "", "été Ünï 42 x_y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    native = {r.id: r.embedding for r in embed.hash_embedding(df, "id", "t", 32).collect()}
    made = embed.hash_provider(32).embed([t or "" for t in texts])
    assert set(native) == {0, 1, 2, 3}
    for place, vector in enumerate(made):
        assert all(abs(a - b) < 1e-12 for a, b in zip(native[place], vector))
    assert native[1] == [0.0] * 32
    # FNV-1a of the empty string and of "a" are published values.
    row = df.limit(1).select(text.hash_token(F.lit("a")).alias("h")).first()
    assert row.h == 0xE40C292C


def test_failures_are_quarantined_by_phase(spark):
    df = spark.createDataFrame(
        [("a", "x", None, 5), ("b", None, None, 0), ("c", "x", "boom", 0), ("d", "x", None, 9000)],
        "source_path string, content string, chunk_error string, largest_chunk int",
    )
    got = {r.source_path: (r.phase, r.error) for r in changes.quarantine(df).collect()}
    assert got["a"] == (None, None) and got["b"][0] == "PARSE" and got["c"] == ("CHUNK", "boom") and got["d"][0] == "EMBED"


def test_english_stems():
    cases = {
        "reports": "report", "delivery": "deliveri", "vacation": "vacat", "running": "run", "hoping": "hope", "flies": "fli",
        "caresses": "caress", "generously": "generous", "relational": "relat", "happily": "happili", "news": "news",
        "falling": "fall", "employees": "employe", "controlled": "control", "ties": "tie", "gas": "gas", "by": "by",
    }
    assert {word: english_stem(word) for word in cases} == cases
