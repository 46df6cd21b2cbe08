import pytest
from pyspark.sql import types as T

from passagemill.llm.queries import prepare

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""
    prepare(spark)

    def build(rows, extra=()):
        whole = [(row[0], row[1], row[2] if len(row) > 2 else "en", row[3] if len(row) > 3 else "s", len(row[1] or "")) for row in rows]
        df = spark.createDataFrame(whole, DOCUMENT).repartition(3)
        from pyspark.sql import functions as F

        return df.withColumns({name: F.lit("x") for name in extra})

    return build


CLASHING = ("_id", "_mark", "_text", "_mark_of_text", "gram", "kept_text", "fp", "root", "bucket", "one", "low", "sha256", "members", "n_words")
