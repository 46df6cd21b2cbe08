"""A language with few rows in a table over the bound of the labelled sample."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill.llm import language_id
from tests.llm.test_operators import tongue


@pytest.mark.parametrize("rare", [1, 3])
def test_rare_language_is_in_the_model(documents, rare):
    pick = random.Random(rare)
    rows = [(i, tongue(pick, ("xx", "yy")[i % 2], 20), ("xx", "yy")[i % 2]) for i in range(3000)]
    rows += [(5000 + i, tongue(pick, "zz", 60), "zz") for i in range(rare)]
    model = language_id.TextModel.fit(documents(rows), "text", "lang", F.col("doc_id"), most=20)
    assert model.languages == ["xx", "yy", "zz", "und"]
    tests = documents([(i, tongue(pick, "zz", 60), "zz") for i in range(50)])
    found = language_id.identify(tests, model, "doc_id", "text").collect()
    assert sum(row.language == "zz" for row in found) == 50


def test_rows_of_one_key_are_not_missed(documents):
    """Rows without an id have one hash, which may be outside of the share."""
    rows = [(i, "ba ki", "xx") for i in range(500)] + [(None, "le mo", "yy")] * 500
    model = language_id.TextModel.fit(documents(rows), "text", "lang", F.col("doc_id"), most=7)
    assert model.languages == ["xx", "yy", "und"]
